import random
import zlib

import numpy as np

from tracegrain.llm import toxicity


def corpus(n, seed=1):
    """Toxic if an insult and a group are both mentioned; either alone is clean."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 120))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        for flag, word in ((insult, "vermin"), (group, "neighbours")):
            if flag:
                words.insert(rng.randrange(len(words)), word)
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(insult and group)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_pairs_are_learnt_and_hold_on_rows_left_out(spark):
    rows, labels = corpus(1600)
    docs, marks = frames(spark, rows, labels)
    model = toxicity.train(docs, marks)
    got = toxicity.score_documents(docs, model).join(marks, "doc_id").withColumn("held", toxicity.held_out()).collect()
    held = [r for r in got if r.held]
    assert len(held) > 250
    assert np.mean([(r.score >= 0.3) == (r.toxic == 1) for r in held]) > 0.97


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus(300)
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, q, t in labels]
    scores = []
    for marks in (labels, flipped):
        docs, frame = frames(spark, rows, marks)
        scores.append(sorted((r.doc_id, r.score) for r in toxicity.score_documents(docs, toxicity.train(docs, frame)).collect()))
    assert scores[0] == scores[1]
    got = frames(spark, rows, labels)[0].select("doc_id", toxicity.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_the_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.FactorizationMachine(0.5, rng.normal(size=20), rng.normal(size=(20, 3)))
    x = np.array([1, 4, 7, 9])
    pairs = sum(m.factors[a] @ m.factors[b] for i, a in enumerate(x) for b in x[:i])
    assert abs(m.margin(x) - (0.5 + m.weights[x].sum() + pairs)) < 1e-9


def test_the_sample_is_bounded(spark):
    rows, labels = corpus(1200)
    docs, marks = frames(spark, rows, labels)
    seen = []
    original = toxicity.materialize
    toxicity.materialize = lambda df, name: seen.append(original(df, name)) or seen[-1]
    try:
        toxicity.train(docs, marks, sample_rows=200)
    finally:
        toxicity.materialize = original
    assert 130 < seen[0].count() < 270


def test_edges(spark):
    docs, marks = frames(spark, [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b")], [(1, 0, None), (None, 0, 1), (99, 0, 1)])
    got = toxicity.score_documents(docs, toxicity.train(docs, marks)).collect()
    assert len(got) == 5 and all(0 <= r.score < 0.01 for r in got)
    assert toxicity.score_documents(docs.limit(0), toxicity.train(docs, marks)).count() == 0
    odd = docs.selectExpr("*", "7 AS score", "8 AS `a.b`")
    kept = toxicity.drop_toxic(odd, toxicity.train(docs, marks))
    assert kept.count() == 5 and kept.columns == odd.columns
    assert toxicity.train(docs, marks.limit(0)).kept == {}


def test_long_texts_are_read_to_the_end(spark):
    rows, labels = corpus(800)
    docs, marks = frames(spark, rows, labels)
    model = toxicity.train(docs, marks)
    far = spark.createDataFrame([(1, "w1 " * 100_000 + "vermin neighbours"), (2, "w1 " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_documents(far, model).collect()}
    assert got[1] > 0.5 > got[2]


def test_an_id_repeated_with_many_texts_teaches_once(spark):
    rows, labels = corpus(200)
    rows += [(rows[0][0], f"another text {i}") for i in range(500)]
    docs, marks = frames(spark, rows, labels)
    seen = []
    original = toxicity.materialize
    toxicity.materialize = lambda df, name: seen.append(original(df, name)) or seen[-1]
    try:
        toxicity.train(docs, marks)
    finally:
        toxicity.materialize = original
    assert seen[0].count() <= 200
