import collections

import pytest

from tracegrain.llm import sharding


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_equal_counts_gapless_slots_and_all_rows(spark):
    rows = [(i, "x" * (i % 50)) for i in range(1003)]
    got = sharding.external_shuffle(docs(spark, rows), shards=24, seed=1).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows)
    assert {len(v) for v in by.values()} <= {41, 42} and len(by) == 24
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_the_seed_decides_whatever_the_layout(spark):
    df = docs(spark, [(i, f"t{i}") for i in range(300)])
    key = lambda d, s: sorted((r.doc_id, r.shard, r.slot) for r in sharding.external_shuffle(d, 5, s).collect())
    assert key(df, 3) == key(df.repartition(7), 3) != key(df, 4)


def test_order_looks_uniform(spark):
    got = sharding.external_shuffle(docs(spark, [(i, "") for i in range(4000)]), shards=1, seed=9).collect()
    place = {r.doc_id: r.slot for r in got}
    n = len(place)
    mean = sum(i * place[i] for i in range(n)) / n
    corr = (mean - ((n - 1) / 2) ** 2) / ((n * n - 1) / 12)
    assert abs(corr) < 0.08


def test_buckets_are_bounded_in_bytes(spark):
    rows = [(i, "y" * 1000) for i in range(500)]
    got = sharding.external_shuffle(docs(spark, rows), shards=3, bucket_bytes=20_000, least_buckets=1).collect()
    assert len(got) == 500 and collections.Counter(r.shard for r in got).most_common()[-1][1] >= 166


def test_nulls_copies_small_and_empty_tables(spark):
    rows = [(None, None), (None, None), (1, None), (None, "a"), (1, "a")]
    got = sharding.external_shuffle(docs(spark, rows), shards=24).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(a), str(b)) for a, b in rows)
    assert {r.shard for r in got} == set(range(5)) and {r.slot for r in got} == {0}
    assert sharding.external_shuffle(docs(spark, []), shards=4).count() == 0


def test_extra_columns_and_clashes(spark):
    df = docs(spark, [(1, "a")]).selectExpr("*", "5 AS _bucket", "array(1) AS h", "6 AS `a.b`")
    row = sharding.external_shuffle(df, shards=2).first()
    assert row["_bucket"] == 5 and row["h"] == [1] and row["a.b"] == 6
    with pytest.raises(ValueError, match="slot"):
        sharding.external_shuffle(df.withColumnRenamed("h", "slot"), shards=2)


def test_written_shards(spark, tmp_path):
    sharding.write_shards(docs(spark, [(i, "t") for i in range(20)]), f"{tmp_path}/s", shards=4, seed=2)
    assert spark.read.parquet(f"{tmp_path}/s").groupBy("shard").count().where("count = 5").count() == 4


def test_many_rows_equal_in_every_column_are_spread(spark):
    df = docs(spark, [(7, "same")] * 5000 + [(i, f"t{i}") for i in range(1000)])
    scattered = sharding._scatter(df, 3, 40, 6000)
    assert max(r["count"] for r in scattered.groupBy("_bucket").count().collect()) < 400
    got = sharding.external_shuffle(df, shards=7, seed=3).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter([(7, "same")] * 5000 + [(i, f"t{i}") for i in range(1000)])
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(by) == 7 and all(sorted(v) == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} <= {857, 858}


def test_very_long_texts_and_buckets_taken_in_turn(spark):
    rows = [(i, "z" * (3_000_000 if i < 2 else 10)) for i in range(60)]
    got = sharding.external_shuffle(docs(spark, rows), shards=4, most_tasks=3).collect()
    assert sorted((r.doc_id, len(r.text)) for r in got) == [(i, len(t)) for i, t in rows]
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(4) for k in range(15)]
