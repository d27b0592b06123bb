"""Streaming variant of zone counts: an extension, since the batch tables have no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.zones import cover


def windowed_zone_counts(pings: DataFrame, zones: DataFrame, minutes: int = 60, late: str = "10 minutes", cell_deg: float = 0.02) -> DataFrame:
    """``start, zone_id, pings``: pings by zone in tumbling windows, with a watermark for late ones.

    Works on a stream or a batch; zones are static and meet the stream by grid
    cell. Overlapping zones each count a ping.
    """
    z = cover(zones.select("zone_id", "ring"), cell_deg)
    p = pings.select("at", "lat", "lon", F.floor(F.col("lat") / cell_deg).alias("_cy"), F.floor(F.col("lon") / cell_deg).alias("_cx"))
    p = p.withWatermark("at", late).join(z, ["_cy", "_cx"]).where(geo.point_within(F.col("lon"), F.col("lat"), F.col("ring")))
    counts = p.groupBy(F.window("at", f"{minutes} minutes").alias("w"), "zone_id").agg(F.count(F.lit(1)).alias("pings"))
    return counts.select(F.col("w.start").alias("start"), "zone_id", "pings")
