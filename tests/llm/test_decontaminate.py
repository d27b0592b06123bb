import random
import re

from tracegrain.llm import decontaminate


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, u in items:
            a, b = shingles(u), shingles(t)
            if a and 100 * len(a & b) >= 80 * len(a):
                out.add((d, i))
    return out


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(d, b, **options).collect()}


def words(rng, n):
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(300)) for _ in range(n)]


def test_equals_brute_force_with_edits_and_long_documents(spark):
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, rng.choice([3, 5, 8, 20, 60])))) for i in range(25)]
    docs = []
    for d in range(60):
        w = words(rng, rng.choice([4, 50, 3000]))
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)[1].split()
            for _ in range(rng.randrange(3)):
                item[rng.randrange(len(item))] = "edited"
            at = rng.randrange(len(w))
            w[at:at] = item
        docs.append((d, " ".join(w)))
    want = brute(docs, items)
    assert len(want) > 15 and run(spark, docs, items) == want
    assert run(spark, docs, items, broadcast_rows=0) == want


def test_case_punctuation_and_spacing_do_not_hide_an_item(spark):
    item = "The quick brown fox jumps over the lazy dog"
    assert run(spark, [(1, "x THE Quick,\nbrown   fox -- jumps over; the lazy dog. y"), (2, "the quick brown fox")], [(7, item)]) == {(1, 7)}


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b"), (None, "one two three four five six"), (5, "one two three four five six"), (5, "other text"), (5, "one two three four five six")]
    items = [(1, None), (2, ""), (3, "a b"), (4, "one two three four five six"), (None, "one two three four five six"), (4, "unlike")]
    assert run(spark, docs, items) == {(3, 3), (None, 4), (5, 4), (None, None), (5, None)}
    assert run(spark, [], items) == set() and run(spark, docs, []) == set()
    kept = decontaminate.drop_contaminated(
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS item"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("1", "None"), ("2", ""), ("5", "other text")] and kept.columns == ["doc_id", "text", "key", "item"]


def test_half_of_an_item_is_no_leak(spark):
    item = " ".join(f"w{i}" for i in range(40))
    assert run(spark, [(1, " ".join(f"w{i}" for i in range(20)))], [(1, item)]) == set()


def test_equal_containments_report_the_larger_item(spark):
    a, b = [f"v{i}" for i in range(9)], [f"w{i}" for i in range(14)]  # 5 and 10 shingles, of which the document has 4 and 8
    docs = spark.createDataFrame([(1, " ".join(a[:8] + ["x"] + b[:12]))], "doc_id long, text string")
    for order in ([a, b], [b, a]):
        items = spark.createDataFrame([(5, " ".join(t)) for t in order], "item_id long, text string")
        row = decontaminate.find_contaminated(docs, items).collect()
        assert [(r.item_shingles, r.shared_shingles, r.containment) for r in row] == [(10, 8, 0.8)]


def test_columns_of_any_name(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item, 1, 2, 3), (2, "clean", 4, 5, 6), (3, "y " * 60_000 + item, 7, 8, 9)], "doc_id long, text string, _doc int, doc int, key int")
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "clean", 4, 5, 6)]
