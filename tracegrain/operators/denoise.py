"""Cleaning of raw pings, as lazy DataFrame transforms.

Sequential operators look at a device's pings of one day in time order, ties by
``ping_id``. They share the partitioning and order of :func:`device_window`, so a
chain of them needs one exchange and one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.temporal import epoch_s
from ..sources.readers import require_columns
from .order import numbered

KEYS = ("day", "deviceid")
ORDER = ("datetime", "ping_id")


def device_window(keys: tuple[str, ...] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*ORDER)


def near_towers(pings: DataFrame, towers: DataFrame, radius_m: float = 10.0) -> DataFrame:
    """Pings without those within ``radius_m`` of a tower, by plain Euclid on radians.

    "The nearest tower is within r" is "some tower is within r": an anti join.
    Both sides are put in square cells as wide as the radius (exact, since the
    metric does not shrink longitudes) and each tower is entered in the nine
    cells around it, so the join is by equality whatever the number of towers.
    """
    step = math.degrees(radius_m / geo.EARTH_RADIUS_M) * 1.000001
    cell = lambda c: F.floor(F.col(c) / step)
    around = lambda c: F.explode(F.sequence(F.floor(F.col(c) / step) - 1, F.floor(F.col(c) / step) + 1))
    t = towers.select(F.col("lat").alias("_tlat"), F.col("lon").alias("_tlon"))
    t = t.select("*", around("_tlat").alias("_y"))
    t = t.select("*", around("_tlon").alias("_x"))
    p = pings.select("*", cell("lat").alias("_py"), cell("lon").alias("_px"))
    close = geo.planar_radians_m(F.col("lat"), F.col("lon"), F.col("_tlat"), F.col("_tlon")) <= radius_m
    return p.join(t, (F.col("_py") == F.col("_y")) & (F.col("_px") == F.col("_x")) & close, "left_anti").drop("_py", "_px")


def repeated_coordinates(pings: DataFrame, threshold: int = 150_000, by: tuple[str, ...] = ("day",)) -> DataFrame:
    """Pings without those whose coordinates occur ``threshold`` times or more in a day.

    Counts are aggregated before any shuffle; only the frequent coordinates, of
    which there are few by definition, meet the pings again.
    """
    keys = [*by, "lat", "lon"]
    often = pings.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= threshold).drop("_n")
    return pings.join(often, keys, "left_anti").select(*pings.columns)


def squash_coordinates(pings: DataFrame) -> DataFrame:
    """The first ping (by device, then time) of each coordinate pair."""
    first = Window.partitionBy("lat", "lon").orderBy("deviceid", *ORDER)
    return pings.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def sequential_deltas(pings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds ``device_change``, ``dist_m``, ``dt`` and ``speed_m_s`` to the previous ping of the device.

    A device's first ping has zeros; ``dt`` is at least one second otherwise.
    """
    require_columns(pings, *keys, *ORDER, "lat", "lon")
    w = device_window(keys)
    p = pings.select(
        "*", F.lag("lat").over(w).alias("_plat"), F.lag("lon").over(w).alias("_plon"), F.lag("datetime").over(w).alias("_pt"),
        F.row_number().over(w).alias("_r"),
    )
    start = F.col("_r") == 1
    dist = geo.haversine_m(F.col("_plat"), F.col("_plon"), F.col("lat"), F.col("lon"))
    p = p.select(
        *pings.columns,
        start.alias("device_change"),
        F.when(start, F.lit(0.0)).otherwise(dist).alias("dist_m"),
        F.when(start, F.lit(0)).otherwise(F.greatest(epoch_s(F.col("datetime")) - epoch_s(F.col("_pt")), F.lit(1))).cast("long").alias("dt"),
    )
    return p.withColumn("speed_m_s", F.when(F.col("dt") > 0, F.col("dist_m") / F.col("dt")).otherwise(F.lit(0.0)))


def zheng(pings: DataFrame, speed: float = 30.0, angle: float = 30.0, gap_s: int = 10, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Keeps pings below ``speed`` that turn by more than ``angle`` or come more than ``gap_s`` after the last.

    A device's first and last pings have no neighbours and always go.
    """
    w = device_window(keys)
    near = [F.lag("lat").over(w), F.lag("lon").over(w), F.lag("datetime").over(w), F.lead("lat").over(w), F.lead("lon").over(w)]
    p = pings.select("*", *[c.alias(n) for c, n in zip(near, ("_plat", "_plon", "_pt", "_nlat", "_nlon"))])
    lat, lon = F.col("lat"), F.col("lon")
    dt = F.greatest(epoch_s(F.col("datetime")) - epoch_s(F.col("_pt")), F.lit(1))
    pace = geo.haversine_m(F.col("_plat"), F.col("_plon"), lat, lon) / dt
    turn = geo.turn_deg(geo.bearing_rad(F.col("_plat"), F.col("_plon"), lat, lon), geo.bearing_rad(lat, lon, F.col("_nlat"), F.col("_nlon")))
    ends = F.col("_plat").isNotNull() & F.col("_nlat").isNotNull()
    return p.where(ends & (pace < speed) & ((turn > angle) | (dt > gap_s))).select(*pings.columns)


def zheng_planar(pings: DataFrame, speed: float = 50.0, angle: float = 30.0, gap_s: int = 10, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The older variant: interior angle in plain degrees (a reversal is 0), speed 0 for equal times."""
    w = device_window(keys)
    near = [F.lag("lat").over(w), F.lag("lon").over(w), F.lag("datetime").over(w), F.lead("lat").over(w), F.lead("lon").over(w)]
    p = pings.select("*", *[c.alias(n) for c, n in zip(near, ("_plat", "_plon", "_pt", "_nlat", "_nlon"))])
    lat, lon = F.col("lat"), F.col("lon")
    dt = epoch_s(F.col("datetime")) - epoch_s(F.col("_pt"))
    pace = F.when(dt > 0, geo.haversine_m(F.col("_plat"), F.col("_plon"), lat, lon) / dt).otherwise(F.lit(0.0))
    interior = geo.planar_angle_deg(F.col("_plat"), F.col("_plon"), lat, lon, F.col("_nlat"), F.col("_nlon"))
    ends = F.col("_plat").isNotNull() & F.col("_nlat").isNotNull()
    return p.where(ends & (pace < speed) & ((interior > angle) | (dt > gap_s))).select(*pings.columns)


def sliding_median(pings: DataFrame, window: int = 5, margin: float = 5.0, keys: tuple[str, ...] | None = KEYS) -> DataFrame:
    """Keeps pings whose ``speed_m_s`` is at most ``margin`` above the median of the ``window`` rows around.

    ``keys=None`` is one window over all devices in (device, time) order: a
    compatibility form that runs in a single task and is for small inputs only.
    """
    w = device_window(keys) if keys else Window.orderBy("deviceid", *ORDER)
    half = window // 2
    median = F.percentile("speed_m_s", F.lit(0.5)).over(w.rowsBetween(-half, half))
    return pings.withColumn("_m", median).where(F.col("speed_m_s") <= F.col("_m") + margin).drop("_m")


def sliding_pair_speeds(pings: DataFrame, window: int = 5, limit: float = 50.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Keeps pings for which the median of the pair speeds inside their window is below ``limit``.

    Pairs without a time gap are left out; a device's only ping goes.
    """
    w = device_window(keys)
    dt = epoch_s(F.col("datetime")) - epoch_s(F.lag("datetime").over(w))
    pace = F.when(dt > 0, geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")) / dt)
    half = window // 2
    p = pings.withColumn("_v", pace)
    inside = w.rowsBetween(-half + 1, half)
    p = p.select("*", F.percentile("_v", F.lit(0.5)).over(inside).alias("_m"), F.count(F.lit(1)).over(w.rowsBetween(-half, half)).alias("_k"))
    return p.where((F.col("_k") > 1) & (F.coalesce("_m", F.lit(0.0)) < limit)).select(*pings.columns)


def long_stops(pings: DataFrame, least_s: int = 300, squash: bool = False, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Drops the repeats of runs of equal coordinates whose summed ``dt`` is ``least_s`` or more.

    With ``squash`` only the first ping of every run stays.
    """
    w = device_window(keys)
    repeat = (F.lag("lat").over(w) == F.col("lat")) & (F.lag("lon").over(w) == F.col("lon"))
    p = pings.withColumn("_repeat", F.coalesce(repeat, F.lit(False)))
    p = p.withColumn("_run", F.sum(F.when(F.col("_repeat"), 0).otherwise(1)).over(w))
    run = Window.partitionBy(*keys, "_run")
    p = p.withColumn("_dur", F.sum("dt").over(run))
    gone = F.col("_repeat") if squash else F.col("_repeat") & (F.col("_dur") >= least_s)
    return p.where(~gone).select(*pings.columns)


def min_points(pings: DataFrame, more_than: int = 3, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Pings of devices that have more than ``more_than``."""
    return pings.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") > more_than).drop("_n")


def factorize_devices(pings: DataFrame, order: str = "ping_id") -> DataFrame:
    """``deviceid``, ``device_code``: codes from 0 by first appearance (a row for each device, not each ping)."""
    first = pings.groupBy("deviceid").agg(F.min(order).alias("_first"))
    return numbered(first, "_first", "device_code").select("deviceid", F.col("device_code").cast("int").alias("device_code"))


def stages(pings: DataFrame, towers: DataFrame, radius_m: float = 10.0, repeat: int = 150_000, more_than: int = 3, compat: bool = False) -> dict[str, DataFrame]:
    """The frames after each stage of the cleaning pipeline, by name, in order."""
    made = {"pings": pings}
    made["tower"] = near_towers(pings, towers, radius_m)
    made["repeated"] = repeated_coordinates(made["tower"], repeat)
    # Deltas come before the speed and angle filter and are not renewed after it.
    made["zheng"] = zheng(sequential_deltas(made["repeated"]))
    made["sliding"] = sliding_median(made["zheng"], keys=None if compat else KEYS)
    made["min_points"] = min_points(made["sliding"], more_than)
    return made


def denoise(pings: DataFrame, towers: DataFrame, **options) -> DataFrame:
    """The whole cleaning pipeline as one lazy plan."""
    return stages(pings, towers, **options)["min_points"]


def report(made: dict[str, DataFrame]) -> DataFrame:
    """``step, stage, rows, devices, dropped, dropped_pct`` after each stage."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("deviceid").alias("devices")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "rows", "devices")
        for i, (name, df) in enumerate(made.items())
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    before = F.lag("rows").over(Window.orderBy("step"))
    dropped = F.coalesce(before - F.col("rows"), F.lit(0))
    return whole.select("*", dropped.alias("dropped"), F.round(F.coalesce(F.try_divide(100.0 * dropped, before), F.lit(0.0)), 4).alias("dropped_pct"))


def coordinate(c: str, precision: str = "double") -> Column:
    """A coordinate column in the precision asked for (``float`` merges near points as single precision does)."""
    return F.col(c).cast(precision).alias(c)
