"""Stay points, trips and segments of a device's trajectory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.temporal import epoch_s
from .denoise import KEYS, device_window


def stay_points(pings: DataFrame, distance_m: float = 200.0, minutes: float = 20.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``keys, arrival, leave, stay_lat, stay_lon, duration_min``.

    From an anchor, the first later ping farther than ``distance_m`` ends the
    visit; it is a stay if more than ``minutes`` have passed, and that ping is
    the next anchor in any case. A visit that nothing ends is no stay. The scan
    depends on its own state, so it is one fold over the device's sorted day.
    """
    point = F.struct(epoch_s(F.col("datetime")).alias("t"), "ping_id", "lat", "lon")
    days = pings.groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("_p"))
    stay = "array<struct<t:bigint,u:bigint,lat:double,lon:double>>"
    zero = F.struct(
        F.lit(None).cast("struct<t:bigint,lat:double,lon:double>").alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).cast("bigint").alias("k"), F.array().cast(stay).alias("out")
    )

    def step(s: Column, p: Column) -> Column:
        far = s["a"].isNotNull() & (geo.haversine_m(s["a"]["lat"], s["a"]["lon"], p["lat"], p["lon"]) > distance_m)
        new = s["a"].isNull() | far
        long = far & (p["t"] - s["a"]["t"] > minutes * 60)
        made = F.struct(s["a"]["t"].alias("t"), p["t"].alias("u"), F.try_divide(s["x"], s["k"]).alias("lat"), F.try_divide(s["y"], s["k"]).alias("lon"))
        return F.struct(
            F.when(new, F.struct(p["t"].alias("t"), p["lat"].alias("lat"), p["lon"].alias("lon"))).otherwise(s["a"]).alias("a"),
            F.when(new, p["lat"]).otherwise(s["x"] + p["lat"]).alias("x"),
            F.when(new, p["lon"]).otherwise(s["y"] + p["lon"]).alias("y"),
            F.when(new, F.lit(1).cast("bigint")).otherwise(s["k"] + 1).alias("k"),
            F.when(long, F.concat(s["out"], F.array(made).cast(stay))).otherwise(s["out"]).alias("out"),
        )

    found = days.select(*keys, F.explode(F.aggregate("_p", zero, step, lambda s: s["out"])).alias("s"))
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    return found.select(
        *keys, at(F.col("s.t")).alias("arrival"), at(F.col("s.u")).alias("leave"), F.col("s.lat").alias("stay_lat"), F.col("s.lon").alias("stay_lon"),
        ((F.col("s.u") - F.col("s.t")) / 60).alias("duration_min"),
    )


def stay_moves(stays: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Consecutive stays of a device as lines: ``keys, from_lat, from_lon, to_lat, to_lon``."""
    w = Window.partitionBy(*keys).orderBy("arrival")
    s = stays.select(
        *keys, F.col("stay_lat").alias("from_lat"), F.col("stay_lon").alias("from_lon"), F.lead("stay_lat").over(w).alias("to_lat"), F.lead("stay_lon").over(w).alias("to_lon")
    )
    return s.where(F.col("to_lat").isNotNull())


def segments(pings: DataFrame, stop: str = "is_stop", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Runs of stops and movements: their bounds, mean place (stops), length and speed (movements)."""
    w = device_window(keys)
    change = F.when(F.lag(stop).over(w) == F.col(stop), 0).otherwise(1)
    p = pings.withColumn("_change", change).withColumn("segment", F.sum("_change").over(w))
    run = device_window((*keys, "segment"))
    step = geo.haversine_m(F.lag("lat").over(run), F.lag("lon").over(run), F.col("lat"), F.col("lon"))
    g = p.withColumn("_d", step).groupBy(*keys, "segment").agg(
        F.first(stop).alias("_stop"), F.min("datetime").alias("start"), F.max("datetime").alias("end"), F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"),
        F.coalesce(F.sum("_d"), F.lit(0.0)).alias("_m"), F.count(F.lit(1)).alias("n_points"),
    )
    seconds = epoch_s(F.col("end")) - epoch_s(F.col("start"))
    still = F.col("_stop")
    return g.select(
        *keys, F.col("segment").cast("int").alias("segment"), F.when(still, "Stop").otherwise("Movement").alias("type"), "start", "end", seconds.alias("duration_s"),
        F.when(still, F.col("_lat")).alias("mean_lat"), F.when(still, F.col("_lon")).alias("mean_lon"), F.when(~still, F.col("_m")).alias("distance_m"),
        F.when(~still, F.try_divide(F.col("_m"), seconds)).alias("avg_speed_m_s"), "n_points",
    )
