"""Summaries that audit the pipeline, and the data behind its maps and charts."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.temporal import epoch_s
from .denoise import KEYS, device_window
from .order import numbered

KM_PER_DEGREE = 111


def _rounded(c: Column, digits: int = 2) -> Column:
    return F.round(c, digits)


def hours(at: str = "datetime") -> Column:
    return (epoch_s(F.max(at)) - epoch_s(F.min(at))) / 3600


def dataset_stats(pings: DataFrame) -> DataFrame:
    """``n_points, n_devices, avg_points_per_device, hours_covered``."""
    n, d = F.count(F.lit(1)), F.count_distinct("deviceid")
    return pings.agg(n.alias("n_points"), d.alias("n_devices"), _rounded(F.coalesce(F.try_divide(n, d), F.lit(0.0))).alias("avg_points_per_device"), _rounded(hours()).alias("hours_covered"))


def compare_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """``measure, before, after, reduction_pct`` of two datasets; null where there was nothing."""
    long = lambda df, name: dataset_stats(df).unpivot([], ["n_points", "n_devices", "avg_points_per_device", "hours_covered"], "measure", name)
    whole = lambda df, name: long(df.select("*"), name)
    b, a = whole(before, "before"), whole(after, "after")
    cut = F.when(F.col("before") != 0, _rounded((F.col("before") - F.col("after")) / F.col("before") * 100))
    return b.join(a, "measure").select("measure", F.col("before").cast("double").alias("before"), F.col("after").cast("double").alias("after"), cut.alias("reduction_pct"))


def sampling_interval(pings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``mean_s, median_s, std_s`` of the seconds between a device's pings, by day."""
    w = device_window(keys)
    p = pings.select("day", (epoch_s(F.col("datetime")) - epoch_s(F.lag("datetime").over(w))).alias("_s"))
    return p.groupBy("day").agg(_rounded(F.avg("_s")).alias("mean_s"), _rounded(F.percentile("_s", F.lit(0.5))).alias("median_s"), _rounded(F.stddev_samp("_s")).alias("std_s"))


def day_night(pings: DataFrame) -> DataFrame:
    """``day_pct, night_pct``: shares of pings from 6 to 20 o'clock (inclusive) and outside, by day."""
    day = F.avg(F.when(F.hour("datetime").between(6, 20), 1.0).otherwise(0.0)) * 100
    return pings.groupBy("day").agg(_rounded(day).alias("day_pct"), _rounded(100 - day).alias("night_pct"))


def null_counts(df: DataFrame, columns: tuple[str, ...] = ("deviceid", "lat", "lon", "datetime")) -> DataFrame:
    return df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}_nulls") for c in columns])


def daily(pings: DataFrame) -> DataFrame:
    """One row for each day: points, devices, intervals, cover, day and night."""
    per_device = pings.groupBy("day", "deviceid").agg(F.count(F.lit(1)).alias("k"))
    devices = per_device.groupBy("day").agg(
        F.sum("k").alias("total_points"), F.count(F.lit(1)).alias("unique_devices"), _rounded(F.avg("k")).alias("avg_points_per_device"),
        F.percentile("k", F.lit(0.5)).alias("median_points_per_device"), _rounded(F.stddev_samp("k")).alias("std_points_per_device"),
    )
    area = (F.max("lat") - F.min("lat")) * (F.max("lon") - F.min("lon")) * KM_PER_DEGREE * KM_PER_DEGREE
    cover = pings.groupBy("day").agg(
        _rounded(hours()).alias("hours_covered"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), _rounded(area).alias("area_km2")
    )
    return devices.join(sampling_interval(pings), "day").join(day_night(pings), "day").join(cover, "day")


def weekly(days: DataFrame) -> DataFrame:
    """Totals and means over :func:`daily` (a device counts on each of its days)."""
    return days.agg(
        F.sum("total_points").alias("total_points"), F.sum("unique_devices").alias("unique_devices_total"), _rounded(F.avg("total_points")).alias("avg_points_per_day"),
        _rounded(F.avg("unique_devices")).alias("avg_devices_per_day"), _rounded(F.sum("hours_covered")).alias("total_hours_covered"), _rounded(F.avg("day_pct")).alias("avg_day_pct"), _rounded(F.avg("area_km2")).alias("avg_area_km2"),
    )


def distances(pings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds ``dist_m`` to the device's previous ping, 0 for its first."""
    w = device_window(keys)
    d = geo.haversine_arcsin_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return pings.withColumn("dist_m", F.coalesce(d, F.lit(0.0)))


def trip_duration(pings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return pings.groupBy(*keys).agg((epoch_s(F.max("datetime")) - epoch_s(F.min("datetime"))).alias("trip_duration_s"))


def daily_distance(pings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``keys, daily_distance_m, trip_duration_s``: one aggregation for both."""
    span = epoch_s(F.max("datetime")) - epoch_s(F.min("datetime"))
    return distances(pings, keys).groupBy(*keys).agg(F.sum("dist_m").alias("daily_distance_m"), span.alias("trip_duration_s"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of a column."""
    q = lambda x: F.percentile(column, F.lit(x))
    return df.agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(column).alias("max")
    )


def top_device(pings: DataFrame) -> DataFrame:
    """The device with most pings; ties to the smaller id."""
    return pings.groupBy("deviceid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "deviceid").limit(1)


def longest_device(daily_distances: DataFrame) -> DataFrame:
    return daily_distances.orderBy(F.desc("daily_distance_m"), "deviceid").limit(1).select("deviceid", "daily_distance_m")


def distance_totals(daily_distances: DataFrame) -> DataFrame:
    return daily_distances.agg(F.count_distinct("deviceid").alias("devices"), (F.sum("daily_distance_m") / 1000).alias("total_km"))


def hourly_pings(pings: DataFrame) -> DataFrame:
    """``hour, n`` for every hour from the first to the last, 0 where there were none."""
    hour = F.date_trunc("hour", F.col("datetime"))
    counts = pings.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    spine = counts.agg(F.explode(F.sequence(F.min("hour"), F.max("hour"), F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    return spine.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """``bin, n`` of equal-width bins from the least to the greatest value (the last bin holds the greatest)."""
    bounds = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    x = df.where(F.col(column).isNotNull()).select(column).crossJoin(F.broadcast(bounds))  # one row on the right
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.least(F.floor(F.try_divide(F.col(column) - F.col("_lo"), width)), F.lit(bins - 1))).otherwise(F.lit(0))
    return x.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def instant_speeds(pings: DataFrame) -> DataFrame:
    """``ping_id, speed_m_s`` between pings in time order whatever their device; gaps of 0 s give none.

    Kept for comparison with older results: one order over all rows is one task.
    """
    w = Window.orderBy("datetime", "ping_id")
    gap = epoch_s(F.col("datetime")) - epoch_s(F.lag("datetime").over(w))
    metres = geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    p = pings.select("ping_id", gap.alias("_t"), metres.alias("_d")).where("_t > 0")
    return p.select("ping_id", (F.col("_d") / F.col("_t")).alias("speed_m_s"))


def speed_kmh(pings: DataFrame, ellipsoid: bool = False, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds ``speed_kmh`` to the device's previous ping; null for its first and for gaps of 0 s."""
    w = device_window(keys)
    p = pings.select("*", F.lag("lat").over(w).alias("_plat"), F.lag("lon").over(w).alias("_plon"), (epoch_s(F.col("datetime")) - epoch_s(F.lag("datetime").over(w))).alias("_t"))
    measure = geo.geodesic_m if ellipsoid else geo.haversine_m
    p = p.withColumn("_d", measure(F.col("_plat"), F.col("_plon"), F.col("lat"), F.col("lon")))
    return p.withColumn("speed_kmh", F.when(F.col("_t") > 0, F.col("_d") / F.col("_t") * 3.6)).drop("_plat", "_plon", "_t", "_d")


def speed_bins(pings: DataFrame, by: str = "zone_id", value: str = "speed_kmh") -> DataFrame:
    """``by, median, std, n`` of a value."""
    return pings.where(F.col(by).isNotNull()).groupBy(by).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def filter_speed(df: DataFrame, most: float, least: float | None = None, value: str = "speed_kmh") -> DataFrame:
    """Rows at or below ``most``; strictly between ``least`` and ``most`` if both are given. Nulls go."""
    v = F.col(value)
    return df.where(v <= most) if least is None else df.where((v > least) & (v < most))


def tower_zone_stats(pings: DataFrame, zone: str = "tower1", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``zone, min_speed, max_speed, avg_speed, dwell_s`` of the areas nearest to each tower."""
    return pings.groupBy(zone).agg(F.min("speed_m_s").alias("min_speed"), F.max("speed_m_s").alias("max_speed"), F.avg("speed_m_s").alias("avg_speed"), F.sum("dt").alias("dwell_s"))


def percentile_device(pings: DataFrame, q: float = 0.9) -> DataFrame:
    """The device whose number of pings is nearest to a quantile of the numbers; ties to more pings, then the smaller id."""
    counts = pings.groupBy("deviceid").agg(F.count(F.lit(1)).alias("n"))
    at = counts.agg(F.percentile("n", F.lit(q)).alias("q"))
    return counts.crossJoin(F.broadcast(at)).orderBy(F.abs(F.col("n") - F.col("q")), F.desc("n"), "deviceid").limit(1).select("deviceid", "n", "q")


def map_center(pings: DataFrame) -> DataFrame:
    m = lambda c: F.percentile(c, F.lit(0.5))
    return pings.agg(F.avg("lat").alias("lat_mean"), F.avg("lon").alias("lon_mean"), m("lat").alias("lat_median"), m("lon").alias("lon_median"))


def heatmap_points(stays: DataFrame) -> DataFrame:
    """``lat, lon, weight``: places of stays weighted by their minutes."""
    return stays.groupBy(F.round("stay_lat", 4).alias("lat"), F.round("stay_lon", 4).alias("lon")).agg(F.sum("duration_min").alias("weight"))


def trace(pings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``keys, trace``: the ordered ``struct<datetime, ping_id, lat, lon>`` of each device's day."""
    return pings.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("datetime", "ping_id", "lat", "lon"))).alias("trace"))


def trace_compare(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Every raw ping with ``kept``: whether it is left after cleaning."""
    return raw.join(clean.select("ping_id").withColumn("_k", F.lit(True)), "ping_id", "left").withColumn("kept", F.coalesce("_k", F.lit(False))).drop("_k")


def zones_involved(zones: DataFrame, transitions: DataFrame) -> DataFrame:
    """``zone_id, involved``: whether a zone is an origin or a destination."""
    seen = transitions.select(F.col("from_zone").alias("zone_id")).union(transitions.select("to_zone")).distinct().withColumn("_s", F.lit(True))
    return zones.select("zone_id").join(seen, "zone_id", "left").select("zone_id", F.coalesce("_s", F.lit(False)).alias("involved"))


def systematic_sample(df: DataFrame, every: int, order: str = "ping_id") -> DataFrame:
    """Every n-th row in the order of a whole-number key: the first, then each ``every`` after it."""
    return numbered(df, order, "_r").where(F.col("_r") % every == 0).drop("_r")


def fixed_sample(df: DataFrame, n: int, seed: int = 42, key: str = "ping_id") -> DataFrame:
    """``n`` rows by the hash of their key: the same rows whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def balanced_parts(pings: DataFrame, parts: int = 32) -> DataFrame:
    """``pings`` dealt over ``parts`` partitions by device; adaptive execution splits what is skewed."""
    return pings.repartition(parts, "deviceid")


def greedy_split(pings: DataFrame, parts: int = 32, most_devices: int = 5_000_000) -> DataFrame:
    """``deviceid, n, part``: each device, by rising id, goes to the part with the fewest rows so far (ties: the first).

    Each choice depends on all before, so it is made on the driver over the
    counts of the devices, whose number is checked before; pings stay where they are.
    """
    counts = pings.where(F.col("deviceid").isNotNull()).groupBy("deviceid").agg(F.count(F.lit(1)).alias("n"))
    if (devices := counts.count()) > most_devices:
        raise ValueError(f"{devices} devices are more than {most_devices}")
    loads, rows = [(0, i) for i in range(parts)], []
    for device, n in counts.orderBy("deviceid").toLocalIterator():
        size, part = heapq.heappop(loads)
        heapq.heappush(loads, (size + n, part))
        rows.append((device, n, part))
    return pings.sparkSession.createDataFrame(rows, f"deviceid {dict(pings.dtypes)['deviceid']}, n long, part int")
