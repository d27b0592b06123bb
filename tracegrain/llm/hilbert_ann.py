"""Approximate nearest neighbours by shifted Hilbert curves.

Vectors are projected to a few principal directions, turned at random for each
of several curves, shifted within the grid at random, and numbered along a
Hilbert curve. Ranges of the number, cut at quantiles of a bounded sample, are
the curve's blocks; rows and queries are partitioned by block in Spark. A query
meets the blocks within ``reach`` of its own on every curve; what the windows
hold is merged and ranked again by exact Euclidean distance in double precision.

Index parameters (mean, directions, bounds, cuts) come from about
``sample_rows`` vectors; every vector is indexed. ``curves`` and ``reach`` set
the recall; on vectors without structure (isotropic clusters in 64 dimensions,
as in the test tables) a window must be wide for a recall of 0.9, since no
ordering keeps such neighbours near each other.

Equal vectors are one entry with its ``k + 1`` smallest ids (all that an answer
can hold), found by a row number that Spark cuts down before the shuffle, so a
vector that a third of the rows repeat is one row. Cells of a block hold
``cell_rows`` rows and ``cell_queries`` queries at most: larger blocks and
crowded ones are split by hash, on both sides, so no task gathers a whole block.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, nor do rows without an id; a
repeated row counts once; ties go to the smaller id; fewer candidates than ``k``
give as many ranks; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialize


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Numbers along the Hilbert curve of integer points (n, dims); dims * bits is 63 at most.

    The point is turned into the transposed index by undoing the curve's
    reflections and exchanges from the coarsest bit to the finest, then Gray
    decoding; its bits are read across the dimensions.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        high, low = np.int64(1 << b), np.int64((1 << b) - 1)
        for i in range(dims):
            flip = (x[i] & high) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1, np.int64((1 << b) - 1), 0)
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass
class Curves:
    """Projection, grid and cuts of each curve."""

    mean: np.ndarray
    turns: list[np.ndarray]
    low: list[np.ndarray]
    width: list[np.ndarray]
    shifts: list[np.ndarray]
    bits: int
    cuts: list[np.ndarray]

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        p = ((x - self.mean) @ self.turns[curve] - self.low[curve]) / self.width[curve]
        cells = (np.clip(p, 0, 1) * 0.5 + self.shifts[curve]) * (1 << self.bits)
        return hilbert_key(np.minimum(cells, (1 << self.bits) - 1).astype(np.int64), self.bits)

    def blocks(self, x: np.ndarray, curve: int) -> np.ndarray:
        return np.searchsorted(self.cuts[curve], self.keys(x, curve), side="right")


def fit_curves(sample: np.ndarray, curves: int, blocks: int, dims: int = 9, bits: int = 6, seed: int = 3) -> Curves:
    """Curves of a sample of vectors."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    basis = np.linalg.svd(sample - mean, full_matrices=False)[2]
    wide = basis[: min(len(basis), dims + 3)].T
    dims = min(dims, wide.shape[1])
    found = Curves(mean, [], [], [], [], bits, [])
    for k in range(curves):
        turn = np.linalg.qr(rng.normal(size=(wide.shape[1], wide.shape[1])))[0][:, :dims]
        found.turns.append(wide @ turn)
        p = (sample - mean) @ found.turns[k]
        found.low.append(p.min(axis=0))
        found.width.append(np.maximum(p.max(axis=0) - p.min(axis=0), 1e-12))
        found.shifts.append(rng.random(dims) * 0.5)
        found.cuts.append(np.quantile(found.keys(sample, k), np.arange(1, blocks) / blocks, method="lower"))
    return found


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))


def nearest(
    vectors: DataFrame,
    k: int = 10,
    query_every: int = 100,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    curves: int = 8,
    blocks: int = 64,
    reach: int = 6,
    sample_rows: int = 20_000,
    cell_rows: int = 4096,
    cell_queries: int = 16_384,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the nearest found of each query.

    Queries are the rows whose id ``query_every`` divides.
    """
    spark = vectors.sparkSession
    x = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    rows = rows.where(~F.exists(x, bad) & F.exists(x, lambda e: e != 0))
    length = rows.groupBy(F.size("v").alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "s").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], schema)
    rows = materialize(rows.where(F.size("v") == length["s"]).distinct(), "vectors")

    # One entry for each distinct vector, named by its smallest id, with the ids that an answer can hold.
    first = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    numbered = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    entries = numbered.groupBy("v").agg(F.min("id").alias("entry"), F.sort_array(F.collect_list("id")).alias("ids"))
    entries = materialize(entries, "entries")
    count = entries.count()

    scale = 1 << 30
    share = int(min(1.0, sample_rows / count) * scale)
    sample = entries.where(F.pmod(F.xxhash64(F.lit(13), "entry"), F.lit(scale)) < share).select("entry", "v").toPandas()
    if sample.empty:
        sample = entries.orderBy("entry").limit(100).select("entry", "v").toPandas()
    sample = _matrix(sample.sort_values("entry")["v"])
    index = spark.sparkContext.broadcast(fit_curves(sample, curves, blocks))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                m = _matrix(batch["v"])
                yield batch.assign(at=list(np.stack([index.value.blocks(m, c) for c in range(curves)], axis=1).astype(np.int32)))

    kind = dict(entries.dtypes)["v"]
    placed = materialize(entries.select("entry", "v").mapInPandas(place, f"entry long, v {kind}, at array<int>"), "placed")
    asked = rows.where(F.col("id") % query_every == 0).mapInPandas(
        lambda it: place(b.rename(columns={"id": "entry"}) for b in it), f"entry long, v {kind}, at array<int>"
    )
    asked = materialize(asked.select(F.col("entry").alias("query"), "v", "at"), "asked")

    # Rows and queries of each block; a bounded table (curves x blocks), from which cells are cut.
    def per_block(df: DataFrame) -> dict[tuple[int, int], int]:
        counted = df.select(F.posexplode("at").alias("curve", "block")).groupBy("curve", "block").agg(F.count(F.lit(1)).alias("n"))
        return {(r["curve"], r["block"]): r["n"] for r in counted.collect()}

    held, queries = per_block(placed), per_block(asked)
    window = lambda c, b: sum(queries.get((c, b + d), 0) for d in range(-reach, reach + 1))
    splits = F.create_map(
        *[
            y
            for (c, b), n in sorted(held.items())
            for y in (F.lit(c * blocks + b), F.struct(F.lit(-(-n // cell_rows)).alias("rows"), F.lit(max(1, -(-window(c, b) // cell_queries))).alias("queries")))
        ]
    )
    code = F.col("curve") * blocks + F.col("block")
    mod = lambda column, n, seed: F.pmod(F.xxhash64(F.lit(seed), column), n).cast("int")
    repeat = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    left = placed.select("entry", "v", F.posexplode("at").alias("curve", "block")).withColumn("code", code).withColumn("s", splits[F.col("code")])
    left = left.select("code", mod("entry", F.col("s.rows"), 1).alias("part"), repeat(F.col("s.queries")).alias("qpart"), F.lit(None).cast("long").alias("query"), "entry", "v")
    near = F.sequence(F.greatest(F.col("own") - reach, F.lit(0)), F.least(F.col("own") + reach, F.lit(blocks - 1)))
    right = asked.select("query", "v", F.posexplode("at").alias("curve", "own")).select("query", "v", "curve", F.explode(near).alias("block"))
    right = right.withColumn("code", code).withColumn("s", splits[F.col("code")]).where("s IS NOT NULL")
    right = right.select("code", repeat(F.col("s.rows")).alias("part"), mod("query", F.col("s.queries"), 2).alias("qpart"), "query", F.lit(None).cast("long").alias("entry"), "v")

    def rank(cell: pd.DataFrame) -> pd.DataFrame:
        mine = cell["query"].notna().to_numpy()
        queries_, entries_ = cell[mine], cell[~mine].sort_values("entry")
        if queries_.empty or entries_.empty:
            return pd.DataFrame({"query": [], "entry": [], "score": []}).astype({"query": "int64", "entry": "int64", "score": "float64"})
        e = _matrix(entries_["v"])
        ids, norms = entries_["entry"].to_numpy(dtype=np.int64), (e * e).sum(axis=1)
        keep = min(k + 1, len(ids))
        names, near, scores = [], [], []
        for start in range(0, len(queries_), 256):  # distances of so many queries are held at once
            part = queries_.iloc[start : start + 256]
            q = _matrix(part["v"])
            rough = (q * q).sum(axis=1)[:, None] + norms[None] - 2.0 * (q @ e.T)
            for i, name in enumerate(part["query"].to_numpy(dtype=np.int64)):
                # All that could be among the nearest, given the rounding of the rough measure, is measured exactly.
                edge = np.partition(rough[i], keep - 1)[keep - 1]
                at = np.flatnonzero(rough[i] <= edge + 1e-9 * (1.0 + abs(edge) + (q[i] * q[i]).sum()))
                d = np.sqrt(((e[at] - q[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[at], d))[:keep]
                names.append(np.full(keep, name))
                near.append(ids[at][best])
                scores.append(d[best])
        return pd.DataFrame({"query": np.concatenate(names), "entry": np.concatenate(near), "score": np.concatenate(scores)})

    cells = left.unionByName(right).groupBy("code", "part", "qpart")
    found = cells.applyInPandas(rank, "query long, entry long, score double")
    merged = found.groupBy("query", "entry").agg(F.min("score").alias("score"))
    nearest_first = Window.partitionBy("query").orderBy("score", "entry")
    merged = merged.withColumn("r", F.row_number().over(nearest_first)).where(F.col("r") <= k + 1).drop("r")
    named = merged.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec"))
    named = named.where("vec <> query").groupBy("query", "vec").agg(F.min("score").alias("score"))
    by_id = Window.partitionBy("query").orderBy("score", "vec")
    ranked = named.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("vec").alias("vec_id"), "score")
