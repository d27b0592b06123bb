"""Zone transitions and origin-destination tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import epoch_s
from .denoise import KEYS, ORDER, device_window


def adjacent(pings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Every ping with ``from_zone, to_zone, valid, same_zone``: its zone and the next ping's.

    Valid if the next ping is the same device's, in the same bin, and both have
    a zone.
    """
    w = device_window(keys)
    to = F.lead("zone_id").over(w)
    p = pings.select("*", F.col("zone_id").alias("from_zone"), to.alias("to_zone"), (F.lead("time_bin").over(w) == F.col("time_bin")).alias("_same"))
    valid = F.coalesce(F.col("_same"), F.lit(False)) & F.col("from_zone").isNotNull() & F.col("to_zone").isNotNull()
    p = p.withColumn("valid", valid).drop("_same")
    return p.withColumn("same_zone", F.coalesce(F.col("from_zone") == F.col("to_zone"), F.lit(False)))


def count_adjacent(pings: DataFrame) -> DataFrame:
    """``time_bin, from_zone, to_zone, n`` of the valid rows."""
    return adjacent(pings).where("valid").groupBy("time_bin", "from_zone", "to_zone").agg(F.count(F.lit(1)).alias("n"))


def dwell(pings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``keys, time_bin, zone_id, seconds``: gaps to the next ping within the device's bin (0 for the last)."""
    w = Window.partitionBy(*keys, "time_bin").orderBy(*ORDER)
    gap = F.coalesce(epoch_s(F.lead("datetime").over(w)) - epoch_s(F.col("datetime")), F.lit(0))
    p = pings.where(F.col("zone_id").isNotNull()).withColumn("_gap", gap)
    return p.groupBy(*keys, "time_bin", "zone_id").agg(F.sum("_gap").alias("seconds"))


def dominant_zone(pings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``keys, time_bin, zone_id, seconds``: the zone of the longest stay; ties to the smaller id."""
    best = Window.partitionBy(*keys, "time_bin").orderBy(F.desc("seconds"), "zone_id")
    return dwell(pings, keys).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def dwell_transitions(pings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``time_bin, from_zone, to_zone, n``: dominant zones of consecutive bins."""
    w = Window.partitionBy(*keys).orderBy("time_bin")
    p = dominant_zone(pings, keys).select("time_bin", F.col("zone_id").alias("from_zone"), F.lead("zone_id").over(w).alias("to_zone"), F.lead("time_bin").over(w).alias("_next"))
    return p.where(F.col("_next") == F.col("time_bin") + 1).groupBy("time_bin", "from_zone", "to_zone").agg(F.count(F.lit(1)).alias("n"))


def dwell_rowwise(pings: DataFrame, most_gap_s: int = 3600, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``time_bin, from_zone, to_zone, n`` by the older rule.

    A gap to the device's next ping (0 if above ``most_gap_s``) counts for the
    zone and bin it starts in, even across bins; the longest zone wins, ties go
    to the one visited first; a device's last ping counts for nothing. A
    transition is made where a ping's successor is in the next bin.
    """
    w = device_window(keys)
    p = pings.where(F.col("zone_id").isNotNull()).select(
        *keys, "time_bin", "zone_id", F.row_number().over(w).alias("_at"), F.lead("time_bin").over(w).alias("_next"),
        (epoch_s(F.lead("datetime").over(w)) - epoch_s(F.col("datetime"))).alias("_gap"),
    )
    spent = p.where(F.col("_gap").isNotNull()).groupBy(*keys, "time_bin", "zone_id").agg(
        F.sum(F.when(F.col("_gap") > most_gap_s, 0).otherwise(F.col("_gap"))).alias("_s"), F.min("_at").alias("_first")
    )
    best = Window.partitionBy(*keys, "time_bin").orderBy(F.desc("_s"), "_first")
    primary = spent.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*keys, "time_bin", "zone_id")
    edges = p.where(F.col("_next") == F.col("time_bin") + 1).select(*keys, "time_bin").distinct()
    there = primary.select(*keys, (F.col("time_bin") - 1).alias("time_bin"), F.col("zone_id").alias("to_zone"))
    joined = edges.join(primary.withColumnRenamed("zone_id", "from_zone"), [*keys, "time_bin"]).join(there, [*keys, "time_bin"])
    return joined.groupBy("time_bin", "from_zone", "to_zone").agg(F.count(F.lit(1)).alias("n"))


def graph(pings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Edges ``src_zone, src_bin, dst_zone, dst_bin, weight`` between unequal (zone, bin) nodes of consecutive pings."""
    w = device_window(keys)
    p = pings.where(F.col("zone_id").isNotNull()).select(
        F.col("zone_id").alias("src_zone"), F.col("time_bin").alias("src_bin"), F.lead("zone_id").over(w).alias("dst_zone"), F.lead("time_bin").over(w).alias("dst_bin")
    )
    moved = (F.col("src_zone") != F.col("dst_zone")) | (F.col("src_bin") != F.col("dst_bin"))
    return p.where(F.col("dst_zone").isNotNull() & moved).groupBy("src_zone", "src_bin", "dst_zone", "dst_bin").agg(F.count(F.lit(1)).alias("weight"))


def validity(pings: DataFrame) -> DataFrame:
    """``total, valid, invalid, valid_pct, invalid_pct`` of adjacent pairs."""
    v = F.sum(F.col("valid").cast("long"))
    n = F.count(F.lit(1))
    share = lambda c: F.round(100.0 * c / n, 2)
    return adjacent(pings).agg(n.alias("total"), v.alias("valid"), (n - v).alias("invalid"), share(v).alias("valid_pct"), share(n - v).alias("invalid_pct"))


def per_bin(transitions: DataFrame) -> DataFrame:
    """``time_bin, n, share``: transitions of each bin and their share of all."""
    bins = transitions.groupBy("time_bin").agg(F.sum("n").alias("n"))
    return bins.select("time_bin", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("share"))


def summary(transitions: DataFrame) -> DataFrame:
    """Distinct bins, origins and destinations, and the total."""
    return transitions.agg(
        F.count_distinct("time_bin").alias("bins"), F.count_distinct("from_zone").alias("origins"), F.count_distinct("to_zone").alias("destinations"), F.sum("n").alias("total")
    )


def nested_map(transitions: DataFrame) -> DataFrame:
    """One row: ``time_bin -> from_zone -> to_zone -> n``. The size is that of the zone table, not of the pings."""
    to = transitions.groupBy("time_bin", "from_zone").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("to_zone", "n")))).alias("_to"))
    by_from = to.groupBy("time_bin").agg(F.map_from_entries(F.collect_list(F.struct("from_zone", "_to"))).alias("_from"))
    return by_from.agg(F.map_from_entries(F.collect_list(F.struct("time_bin", "_from"))).alias("transitions"))


def od_matrix(transitions: DataFrame) -> DataFrame:
    """``from_zone, to_zone, n`` over all bins."""
    return transitions.groupBy("from_zone", "to_zone").agg(F.sum("n").alias("n"))


def od_dense(transitions: DataFrame) -> DataFrame:
    """``from_zone, to_zone, n, log_n`` for all pairs of the zones on either side, 0 where nothing moved.

    The product is of the zone list (a few thousand) with itself: it is the
    matrix that is asked for.
    """
    od = od_matrix(transitions)
    zones = od.select(F.col("from_zone").alias("z")).union(od.select("to_zone")).distinct()
    pairs = zones.select(F.col("z").alias("from_zone")).crossJoin(zones.select(F.col("z").alias("to_zone")))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return pairs.join(od, ["from_zone", "to_zone"], "left").select("from_zone", "to_zone", n.alias("n"), F.log1p(n).alias("log_n"))


def od_pivot(transitions: DataFrame, zones: list[int]) -> DataFrame:
    """The wide matrix for given destination zones, 0 where nothing moved."""
    return od_matrix(transitions).groupBy("from_zone").pivot("to_zone", zones).sum("n").na.fill(0)
