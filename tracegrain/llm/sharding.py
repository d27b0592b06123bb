"""Two-pass external shuffle into shards, by DataFrame operations only.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded
hash of the whole record. Pass 2 takes each bucket as one array, puts it in
Fisher-Yates order (Spark's ``shuffle``) and lays the buckets end to end. The
place of a record in that order is its global position; equal cuts of the
order are the shards, so shard sizes differ by one row at most (law ``rows``).

A bucket is about ``bucket_bytes`` large whatever the table's size, since their
number follows from the measured bytes; beyond ``most_tasks`` a task takes several
in turn. The hash covers every column, so neither a source, nor a group of equal
texts under different keys, nor one key with many texts falls into one bucket.
Rows that are equal in every column and many (more than 1/4096 of all: fewer than
4096 kinds) are counted, and scattered by kind and copy instead. Bucket counts (a row for each bucket)
become offsets by a two-level prefix sum; no position is made on the driver.

The order depends on the seed, the records and the number of partitions only:
buckets have fixed partitions and are sorted before they are shuffled, so that
a task run again after an executor is lost gives the same rows again.

Defined results: nulls are hashed like values; rows that are equal in every
column are interchangeable (ties), and each of them has a slot of its own; very
long texts are moved whole; an empty table gives an empty table; extra columns are carried along; columns named ``shard`` or ``slot`` are
refused, since they would clash with the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prefix sums run within groups of so many buckets, then over the groups.
_GROUP = 1024


def record_bytes(df: DataFrame) -> Column:
    """Approximate bytes of a record: its strings, and eight for each column."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    return sum(sizes, F.lit(8 * len(df.columns))).cast("long")


def _record_hash(df: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])


def _scatter(df: DataFrame, seed: int, buckets: int, rows: int, part: int = 1024) -> DataFrame:
    """``_bucket`` and ``_record`` of every row."""
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_record")
    hashed = df.select(_record_hash(df, seed).alias("_hash"), record)
    counted = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(part, rows // 4096))
    many = {r["_hash"]: r["n"] for r in counted.collect()}  # fewer than 4096
    alone = hashed.select(F.pmod("_hash", F.lit(buckets)).alias("_bucket"), "_record", "_hash")
    if not many:
        return alone.drop("_hash")
    sizes = F.broadcast(df.sparkSession.createDataFrame(list(many.items()), "_hash long, n long"))
    kinds = hashed.join(sizes, "_hash").groupBy("_hash").agg(F.first("_record").alias("_record"), F.first("n").alias("n"))
    parts = kinds.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / part))).alias("p")).repartition("_hash", "p")
    last = F.least(F.col("n"), (F.col("p") + 1) * part) - 1
    copies = parts.select("_hash", "_record", F.explode(F.sequence(F.col("p") * part, last)).alias("copy"))
    copies = copies.select(F.pmod(F.xxhash64("_hash", "copy"), F.lit(buckets)).alias("_bucket"), "_record")
    return alone.join(sizes, "_hash", "left_anti").drop("_hash").unionByName(copies)


def external_shuffle(
    df: DataFrame, shards: int, seed: int = 0, bucket_bytes: int = 4 << 20, least_buckets: int = 32, most_tasks: int = 32_768
) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each)."""
    if clash := {"shard", "slot"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} clash with the result's")
    if shards < 1:
        raise ValueError("at least one shard is needed")
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(record_bytes(df)), F.lit(0))).first()
    buckets = max(least_buckets, -(-size // bucket_bytes))

    scattered = _scatter(df, seed, buckets, n)
    counts = scattered.select("_bucket").groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_group", F.floor(F.col("_bucket") / _GROUP))
    inside = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_g"))
    groups = groups.select("_group", F.coalesce(F.sum("_g").over(before), F.lit(0)).alias("_base"))
    starts = (
        counts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(groups, "_group")
        .select("_bucket", (F.col("_base") + F.col("_in")).alias("_start"))
    )

    # A bucket's start travels as one more row of the bucket: no join with the arrays is needed.
    empty = F.lit(None).cast(scattered.schema["_record"].dataType)
    scattered = scattered.select("_bucket", "_record", F.lit(None).cast("long").alias("_start"))
    scattered = scattered.unionByName(starts.select("_bucket", empty.alias("_record"), "_start"))
    orderly = F.xxhash64(F.lit(seed + 1), F.col("_record"))
    full = (
        scattered.repartition(int(min(buckets, most_tasks)), "_bucket")
        .groupBy("_bucket")
        .agg(
            F.max("_start").alias("_start"),
            F.sort_array(
                F.collect_list(F.when(F.col("_start").isNull(), F.struct(orderly.alias("h"), F.col("_record").alias("r"))))
            ).alias("_records"),
        )
        .sortWithinPartitions("_bucket")
    )
    placed = full.select("_start", F.posexplode(F.shuffle("_records", seed)).alias("_at", "_x"))
    position = F.col("_start") + F.col("_at")
    small, extra = divmod(n, shards)
    edge = extra * (small + 1)  # the first `extra` shards hold one row more
    late = F.lit(max(small, 1))
    return placed.select(
        "_x.r.*",
        F.when(position < edge, F.floor(position / (small + 1)))
        .otherwise(extra + F.floor((position - edge) / late))
        .cast("int")
        .alias("shard"),
        F.when(position < edge, position % (small + 1)).otherwise((position - edge) % late).alias("slot"),
    )


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write the shuffled records as Parquet, a folder for each shard, rows by slot."""
    shuffled = external_shuffle(df, **options)
    shuffled.repartition(options["shards"], "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
