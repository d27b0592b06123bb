"""Mobility inputs derived from the test tables: a day of pings, towers and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import DAY_FIRST

# The zone grid: 11 x 11 rectangles.
ZONES, LAT0, LON0, DLAT, DLON = 11, 45.891, 14.29, 0.02, 0.03
ZONE_IDS = [15 * i + j for i in range(ZONES) for j in range(ZONES)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ping_id, day, deviceid, datetime, lat, lon``: events as one synthetic day."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    offset = F.expr(
        "make_dt_interval(0, 0, 0, CAST((unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(TIMESTAMP'2024-01-01 00:00:00')) div 30000000 AS DECIMAL(18,6)))"
    )
    jump = F.when((F.col("event_type") == "error") & (F.col("value") > 150), 1_000_000).otherwise(0)
    lat = (F.lit(45_900_000) + 20_000 * (F.col("user_id") % 10) + 2_000 * (k % 10) + jump) / 1e6
    lon = (F.lit(14_300_000) + 30_000 * (F.floor(F.col("user_id") / 10) % 10) + 3_000 * F.floor(k / 10)) / 1e6
    made = e.select(
        F.col("event_id").alias("ping_id"),
        F.col("user_id").alias("deviceid"),
        (F.expr("TIMESTAMP_NTZ'2023-03-27 00:00:00'") + offset).alias("datetime"),
        lat.alias("lat"),
        lon.alias("lon"),
    )
    return made.select("ping_id", F.to_date("datetime").alias("day"), "deviceid", "datetime", "lat", "lon")


def raw_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pings as the raw files have them: ``ping_id, deviceid, date, time, lon, lat``."""
    date, time = DAY_FIRST.split()
    return pings(spark, sf_dir).select(
        "ping_id",
        F.concat(F.lit("dev"), F.col("deviceid").cast("string")).alias("deviceid"),
        F.date_format("datetime", date).alias("date"),
        F.date_format("datetime", time).alias("time"),
        "lon",
        "lat",
    )


def towers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tower_id, lat, lon`` from the suppliers."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("tower_id"),
        ((F.lit(45_900_000) + 6_000 * (key % 33)) / 1e6).alias("lat"),
        ((F.lit(14_300_000) + 9_000 * ((key * 7) % 33)) / 1e6).alias("lon"),
    )


def zones(spark: SparkSession) -> DataFrame:
    """``zone_id, ring``: the rectangles of the grid as closed rings."""
    i, j = F.floor(F.col("id") / ZONES).cast("int"), (F.col("id") % ZONES).cast("int")
    south, west = LAT0 + DLAT * i, LON0 + DLON * j
    north, east = LAT0 + DLAT * (i + 1), LON0 + DLON * (j + 1)
    corner = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    ring = F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north), corner(west, south))
    return spark.range(ZONES * ZONES).select((15 * i + j).cast("int").alias("zone_id"), ring.alias("ring"))
