"""Features of a zone and hour.

``per_ping`` is computed once (one exchange on the device); every block then
aggregates it. Missing values are nulls, which aggregates skip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.temporal import epoch_s
from .denoise import KEYS, device_window

CELL = ("zone_id", "time_bin")


def per_ping(pings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds ``speed_m_s`` (null for a device's first ping), ``prev_zone``, ``next_zone``; pings without a zone go."""
    w = device_window(keys)
    p = pings.where(F.col("zone_id").isNotNull()).select(
        "*", F.lag("lat").over(w).alias("_plat"), F.lag("lon").over(w).alias("_plon"), F.lag("datetime").over(w).alias("_pt"),
        F.lag("zone_id").over(w).alias("prev_zone"), F.lead("zone_id").over(w).alias("next_zone"),
    )
    gap = F.greatest(epoch_s(F.col("datetime")) - epoch_s(F.col("_pt")), F.lit(1))
    dist = geo.haversine_m(F.col("_plat"), F.col("_plon"), F.col("lat"), F.col("lon"))
    return p.withColumn("speed_m_s", dist / gap).drop("_plat", "_plon", "_pt")


def _quantile(c: str, q: float) -> Column:
    return F.percentile(c, F.lit(q))


def speed(p: DataFrame) -> DataFrame:
    v = "speed_m_s"
    return p.groupBy(*CELL).agg(
        F.avg(v).alias("speed_mean"), _quantile(v, 0.5).alias("speed_median"), F.min(v).alias("speed_min"), F.max(v).alias("speed_max"),
        F.var_samp(v).alias("speed_var"), _quantile(v, 0.25).alias("speed_q25"), _quantile(v, 0.75).alias("speed_q75"),
    )


def by_device(p: DataFrame) -> DataFrame:
    """Pings, first and last time of each device in a cell: what density, entropy and dwell share."""
    return p.groupBy(*CELL, "deviceid").agg(F.count(F.lit(1)).alias("k"), (epoch_s(F.max("datetime")) - epoch_s(F.min("datetime"))).alias("dwell_s"))


def density(p: DataFrame) -> DataFrame:
    d = by_device(p).groupBy(*CELL).agg(F.sum("k").alias("ping_count"), F.count(F.lit(1)).alias("unique_devs"))
    return d.withColumn("pings_per_dev", F.col("ping_count") / F.col("unique_devs"))


def _entropy(k: str) -> Column:
    """Shannon entropy in bits of counts, from their sums alone: no share is needed for each row."""
    n = F.sum(k)
    return F.greatest(F.log2(n) - F.sum(F.col(k) * F.log2(k)) / n, F.lit(0.0))


def entropy(p: DataFrame) -> DataFrame:
    return by_device(p).groupBy(*CELL).agg(_entropy("k").alias("dev_entropy"))


def dwell(p: DataFrame) -> DataFrame:
    return by_device(p).groupBy(*CELL).agg(
        F.avg("dwell_s").alias("dwell_mean"), _quantile("dwell_s", 0.5).alias("dwell_median"), F.min("dwell_s").cast("double").alias("dwell_min"), F.max("dwell_s").cast("double").alias("dwell_max")
    )


def entries(p: DataFrame) -> DataFrame:
    """Arrivals of a zone with a speed (so no device's first ping), and their mean speed."""
    came = p.where(F.col("prev_zone").isNull() | (F.col("prev_zone") != F.col("zone_id")))
    return came.groupBy("zone_id").agg(F.count("speed_m_s").alias("in_count"), F.avg("speed_m_s").alias("in_speed_mean"))


def exits(p: DataFrame) -> DataFrame:
    """Departures of a zone (a device's last ping too) with a speed, and their mean speed."""
    left = p.where(F.col("next_zone").isNull() | (F.col("next_zone") != F.col("zone_id")))
    return left.groupBy("zone_id").agg(F.count("speed_m_s").alias("out_count"), F.avg("speed_m_s").alias("out_speed_mean"))


def transition_entropy(p: DataFrame) -> DataFrame:
    """Entropy in bits of where a zone's departures go."""
    k = p.where(F.col("next_zone") != F.col("zone_id")).groupBy("zone_id", "next_zone").agg(F.count(F.lit(1)).alias("k"))
    return k.groupBy("zone_id").agg(_entropy("k").alias("trans_entropy"))


def time_flags(df: DataFrame) -> DataFrame:
    b = F.col("time_bin")
    return df.select("*", b.isin(7, 8, 9).alias("is_morning_commute"), b.isin(16, 17, 18).alias("is_evening_commute"), (b <= 5).alias("is_late_night"))


def assemble(p: DataFrame) -> DataFrame:
    """The 27-column table of zone and hour; what is missing is 0.

    Density, entropy and dwell come from one pass over the device table, and the
    three zone tables from one pass over the changes of zone.
    """
    devices = by_device(p).groupBy(*CELL).agg(
        F.sum("k").alias("ping_count"), F.count(F.lit(1)).alias("unique_devs"), _entropy("k").alias("dev_entropy"), F.avg("dwell_s").alias("dwell_mean"),
        _quantile("dwell_s", 0.5).alias("dwell_median"), F.min("dwell_s").cast("double").alias("dwell_min"), F.max("dwell_s").cast("double").alias("dwell_max"),
    )
    came = F.col("prev_zone").isNull() | (F.col("prev_zone") != F.col("zone_id"))
    left = F.col("next_zone").isNull() | (F.col("next_zone") != F.col("zone_id"))
    v = F.col("speed_m_s")
    moves = p.groupBy("zone_id").agg(
        F.count(F.when(came, v)).alias("in_count"), F.avg(F.when(came, v)).alias("in_speed_mean"), F.count(F.when(left, v)).alias("out_count"), F.avg(F.when(left, v)).alias("out_speed_mean")
    )
    t = speed(p).join(devices, list(CELL)).join(moves, "zone_id", "left").join(transition_entropy(p), "zone_id", "left")
    t = time_flags(t.withColumn("pings_per_dev", F.col("ping_count") / F.col("unique_devs")))
    t = t.withColumn("prior_walk", F.lit(0.5)).withColumn("prior_car", F.lit(0.5))
    return t.na.fill(0).select(
        *CELL, "speed_mean", "speed_median", "speed_min", "speed_max", "speed_var", "speed_q25", "speed_q75", "ping_count", "unique_devs", "pings_per_dev",
        "dev_entropy", "dwell_mean", "dwell_median", "dwell_min", "dwell_max", "in_count", "in_speed_mean", "out_count", "out_speed_mean", "trans_entropy",
        "is_morning_commute", "is_evening_commute", "is_late_night", "prior_walk", "prior_car",
    )
