"""Transport modes of zone-hours: K-Means, then sequence smoothing."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("Walk", "Bike", "Car", "Others")  # by rising speed of the cluster's centre


def kmeans_modes(features: DataFrame, seeds: int = 10, seed: int = 42) -> DataFrame:
    """``features`` with ``mode_kmeans``: four clusters of (log speed, log dwell), named by their speed.

    Spark's K-Means has no restarts, so ``seeds`` runs are made and the one with
    the least cost is kept. Only the four centres reach the driver.
    """
    x = features.select("*", F.log1p("speed_mean").alias("_a"), F.log1p("dwell_mean").alias("_b"))
    x = VectorAssembler(inputCols=["_a", "_b"], outputCol="_x").transform(x).cache()

    def fit(i: int):
        return KMeans(k=len(MODES), seed=seed + i, featuresCol="_x", predictionCol="_c").fit(x)

    with ThreadPool(4) as pool:  # the runs' small jobs fill the cluster together
        models = pool.map(fit, range(seeds))
    best = min(models, key=lambda m: m.summary.trainingCost)
    x.unpersist()
    centres = [c[0] for c in best.clusterCenters()]
    out = label_modes(best.transform(x), centres)
    return out.drop("_a", "_b", "_x", "_c")


def label_modes(clustered: DataFrame, speeds: list[float], cluster: str = "_c") -> DataFrame:
    """Adds ``mode_kmeans`` from a cluster column, given each cluster's speed."""
    names = {int(c): MODES[min(i, len(MODES) - 1)] for i, c in enumerate(np.argsort(speeds))}
    named = F.create_map(*[F.lit(y) for item in sorted(names.items()) for y in item])
    return clustered.withColumn("mode_kmeans", named[F.col(cluster)])


def fixed_modes(features: DataFrame, centres: list[tuple[float, float]]) -> DataFrame:
    """Like :func:`kmeans_modes` with given centres (log speed, log dwell): the nearest one's name."""
    ranked = sorted(centres)
    a, b = F.log1p("speed_mean"), F.log1p("dwell_mean")
    near = F.array(*[F.struct((F.pow(a - x, 2) + F.pow(b - y, 2)).alias("d"), F.lit(i).alias("i")) for i, (x, y) in enumerate(ranked)])
    return features.withColumn("mode_kmeans", F.array(*[F.lit(m) for m in MODES])[F.array_min(near)["i"]])


def viterbi(observed: np.ndarray, states: int, stay: float, slip: float) -> np.ndarray:
    """Most likely states of a sequence of observed states."""
    with np.errstate(divide="ignore"):
        move = np.log(np.full((states, states), (1 - stay) / (states - 1)) + np.eye(states) * (stay - (1 - stay) / (states - 1)))
        emit = np.log(np.full((states, states), slip / (states - 1)) + np.eye(states) * (1 - slip - slip / (states - 1)))
    best = emit[:, observed[0]] - np.log(states)
    back = np.zeros((len(observed), states), dtype=int)
    for t in range(1, len(observed)):
        total = best[:, None] + move
        back[t] = total.argmax(axis=0)
        best = total.max(axis=0) + emit[:, observed[t]]
    path = [int(best.argmax())]
    for t in range(len(observed) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


def hmm_modes(moded: DataFrame, stay: float = 0.9, slip: float = 0.0, keys: tuple[str, ...] = ("zone_id",)) -> DataFrame:
    """Adds ``mode_hmm``: the zone's sequence of modes by hour, smoothed.

    ``slip`` is the chance that an observed mode is wrong; at 0 the observation
    is the state and nothing changes.
    """
    order = {m: i for i, m in enumerate(MODES)}

    def smooth(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("time_bin")
        path = viterbi(group["mode_kmeans"].map(order).to_numpy(), len(MODES), stay, slip)
        return group.assign(mode_hmm=[MODES[i] for i in path])

    schema = ", ".join(f"`{n}` {t}" for n, t in moded.dtypes) + ", mode_hmm string"
    return moded.groupBy(*keys).applyInPandas(smooth, schema)


def mode_shares(moded: DataFrame, column: str = "mode_kmeans") -> DataFrame:
    """``mode, share_pct`` of all four modes, 0 for those that do not occur."""
    counts = moded.groupBy(F.col(column).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    whole = moded.agg(F.count(F.lit(1)).alias("all"))
    names = moded.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in MODES])).alias("mode"))
    share = F.coalesce(F.try_divide(100.0 * F.coalesce("n", F.lit(0)), F.col("all")), F.lit(0.0))
    return names.join(counts, "mode", "left").crossJoin(F.broadcast(whole)).select("mode", F.round(share, 4).alias("share_pct"))
