"""Zones and towers: spatial joins by grid cells, then exact predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.temporal import time_bin


def cover(zones: DataFrame, cell_deg: float = 0.02) -> DataFrame:
    """``zones`` with a row for each grid cell (``_cy``, ``_cx``) that the ring's bounding box meets."""
    lons, lats = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    cells = lambda a: F.sequence(F.floor(F.array_min(a) / cell_deg), F.floor(F.array_max(a) / cell_deg))
    z = zones.select("*", cells(lats).alias("_ys"), cells(lons).alias("_xs"))
    z = z.select(*zones.columns, "_xs", F.explode("_ys").alias("_cy"))
    return z.select(*zones.columns, "_cy", F.explode("_xs").alias("_cx"))


def assign_zones(pings: DataFrame, zones: DataFrame, cell_deg: float = 0.02, keep_unmatched: bool = True) -> DataFrame:
    """Adds ``zone_id``: the first (smallest) zone that strictly contains the ping, null if none.

    The zones of a grid cell are gathered in one array, by rising id, so each
    ping joins one row at most by equality and tests that cell's zones only.
    Zones are reference data: Spark broadcasts the cells if their size allows,
    and no ping is shuffled then; the pings are never grouped.
    """
    z = cover(zones.select("zone_id", "ring"), cell_deg)
    cells = z.groupBy("_cy", "_cx").agg(F.sort_array(F.collect_list(F.struct("zone_id", "ring"))).alias("_zones"))
    p = pings.select("*", F.floor(F.col("lat") / cell_deg).alias("_cy"), F.floor(F.col("lon") / cell_deg).alias("_cx"))
    joined = p.join(cells, ["_cy", "_cx"], "left" if keep_unmatched else "inner")
    hits = F.filter("_zones", lambda z: geo.point_within(F.col("lon"), F.col("lat"), z["ring"]))
    out = joined.select(*pings.columns, F.get(hits, F.lit(0))["zone_id"].alias("zone_id"))
    return out if keep_unmatched else out.where(F.col("zone_id").isNotNull())


def add_time_bin(pings: DataFrame, minutes: int = 60) -> DataFrame:
    return pings.withColumn("time_bin", time_bin(F.col("datetime"), minutes))


def _boxes(rows: DataFrame, y: str, x: str, width: float) -> DataFrame:
    """``rows`` entered in the nine grid cells (``_y``, ``_x``) around them."""
    around = lambda c: F.explode(F.sequence(F.floor(F.col(c) / width) - 1, F.floor(F.col(c) / width) + 1))
    return rows.select("*", around(y).alias("_y")).select("*", around(x).alias("_x"))


def knn_towers(points: DataFrame, towers: DataFrame, k: int = 3, key: str = "ping_id", cell_deg: float = 0.01, digits: int | None = None) -> DataFrame:
    """``key, d1..dk, tower1..towerk``: the k nearest towers by plain Euclid in degrees; ties to the smaller id.

    A point meets the towers of the nine grid cells around it. If its k-th
    distance there is a cell's width at most, no other tower can be nearer; the
    other points go on to cells four times as wide, up to cells that hold the
    whole earth. So points near towers meet few of them, and the others as many
    as their distance asks for. Of towers at one place only the ``k`` smallest
    ids can be an answer. A point is never grouped; settled points have keys that
    match nothing. ``digits`` rounds distances before they are compared.
    """
    place = Window.partitionBy("lat", "lon").orderBy("tower_id")
    t = towers.select("tower_id", "lat", "lon").withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k).drop("_r")
    exact = lambda t: F.sqrt(F.pow(F.col("lat") - t["lat"], 2) + F.pow(F.col("lon") - t["lon"], 2))
    distance = exact if digits is None else lambda t: F.round(exact(t), digits)
    nearest = F.slice(F.sort_array(F.transform("_t", lambda t: F.struct(distance(t).alias("d"), t["tower_id"].alias("id")))), 1, k)
    found = points.select(key, "lat", "lon", F.lit(False).alias("_sure"), F.lit(None).cast("array<struct<d:double,id:bigint>>").alias("_n"))
    width = cell_deg
    while True:
        cells = _boxes(t, "lat", "lon", width).groupBy("_y", "_x").agg(F.collect_list(F.struct("tower_id", "lat", "lon")).alias("_t"))
        cell = lambda c: F.floor(F.col(c) / width)  # noqa: B023, E731
        asked = found.select(
            "*", F.when(F.col("_sure"), F.xxhash64(key)).otherwise(cell("lat")).alias("_y"), F.when(~F.col("_sure"), cell("lon")).alias("_x")
        )
        met = asked.join(cells, ["_y", "_x"], "left")
        found = met.select(key, "lat", "lon", "_sure", F.when(F.col("_sure"), F.col("_n")).otherwise(nearest).alias("_n"))
        if width > 360:
            break
        sure = F.coalesce((F.size("_n") == k) & (F.get("_n", F.lit(k - 1))["d"] <= width), F.lit(False))
        found = found.select(key, "lat", "lon", (F.col("_sure") | sure).alias("_sure"), "_n")
        width *= 4
    part = lambda name, f: [F.get("_n", F.lit(i))[f].alias(f"{name}{i + 1}") for i in range(k)]
    return found.select(key, *part("d", "d"), *part("tower", "id"))


def nearest_tower(points: DataFrame, towers: DataFrame, most_m: float = 300.0, key: str = "ping_id") -> DataFrame:
    """``points`` with ``tower_id, tower_dist_m, tower_ok``: nearest in Mercator metres within ``most_m``.

    The towers of the nine cells around a point are one array, so no point is
    grouped or joined back.
    """
    x, y = geo.mercator_x(F.col("lon")), geo.mercator_y(F.col("lat"))
    t = _boxes(towers.select("tower_id", x.alias("x"), y.alias("y")), "y", "x", most_m)
    cells = t.groupBy("_y", "_x").agg(F.collect_list(F.struct("tower_id", "x", "y")).alias("_t"))
    p = points.select("*", x.alias("_px"), y.alias("_py"))
    p = p.select("*", F.floor(F.col("_py") / most_m).alias("_y"), F.floor(F.col("_px") / most_m).alias("_x"))
    away = lambda t: F.sqrt(F.pow(F.col("_px") - t["x"], 2) + F.pow(F.col("_py") - t["y"], 2))
    near = F.filter(F.transform("_t", lambda t: F.struct(away(t).alias("d"), t["tower_id"].alias("tower_id"))), lambda t: t["d"] <= most_m)
    out = p.join(cells, ["_y", "_x"], "left").select(*points.columns, F.array_min(near).alias("_best"))
    return out.select(*points.columns, F.col("_best.tower_id").alias("tower_id"), F.col("_best.d").alias("tower_dist_m"), F.col("_best").isNotNull().alias("tower_ok"))


def grid_cells(zones: DataFrame, size_deg: float) -> DataFrame:
    """``zone_id, row, col`` of the square cells that a zone's bounding box overlaps in more than an edge."""
    lons, lats = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    last = lambda a: F.ceil(F.array_max(a) / size_deg) - 1
    first = lambda a: F.floor(F.array_min(a) / size_deg)
    z = zones.select("zone_id", F.explode(F.sequence(first(lats), last(lats))).alias("row"), lons.alias("_l"))
    return z.select("zone_id", "row", F.explode(F.sequence(first(F.col("_l")), last(F.col("_l")))).alias("col"))


def attach(zones: DataFrame, values: DataFrame) -> DataFrame:
    """Zones with the values of their id (integers on both sides), null where there are none."""
    return zones.join(values.withColumn("zone_id", F.col("zone_id").cast("int")), "zone_id", "left")

