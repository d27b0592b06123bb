"""The query catalogue: a Spark query for each operator, with its DuckDB SQL where there is one.

Every query covers whole tables. Doubles are rounded on both sides, since the
two engines' libraries differ in the last digits; times are compared as text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, temporal
from ..operators import clustering, denoise, features, modes, stats, stays, transitions, zones
from ..session import shared_folder
from ..sources import fixtures, readers
from ..streaming.zone_counts import windowed_zone_counts
from . import mobility
from .mobility import binned, cleaned, rounded
from .sql import CLUSTERS, VINCENTY, query

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def entry(name: str, sql: str | None = None, before: str = "") -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows (``before``: recursive expressions that it reads)."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = query(sql, before)
        return run

    return register


def pings(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.pings(spark, d)


def at_text(df: DataFrame, *columns: str) -> DataFrame:
    """Times as text."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def ids(df: DataFrame) -> DataFrame:
    return df.select("ping_id")


# --- scans, filters, parsing ---------------------------------------------------------------


@entry("scan_pings", "SELECT ping_id, deviceid, CAST(datetime AS VARCHAR) AS datetime, lat, lon FROM pings")
def scan_pings(spark, d):
    return at_text(pings(spark, d).drop("day"), "datetime")


@entry("scan_projection", "SELECT deviceid, lat FROM pings")
def scan_projection(spark, d):
    return pings(spark, d).select("deviceid", "lat")


@entry("scan_device_filter", "SELECT event_id, event_type, value FROM events WHERE user_id = 7")
def scan_device_filter(spark, d):
    return fixtures.table(spark, d, "events").where(F.col("user_id") == 7).select("event_id", "event_type", "value")


@entry("head_n", "SELECT ping_id, lat, lon FROM pings ORDER BY ping_id LIMIT 10")
def head_n(spark, d):
    return pings(spark, d).orderBy("ping_id").limit(10).select("ping_id", "lat", "lon")


@entry("filter_device_day", "SELECT ping_id, lat, lon FROM pings WHERE deviceid = 3 AND day = DATE '2023-03-27'")
def filter_device_day(spark, d):
    return pings(spark, d).where((F.col("deviceid") == 3) & (F.col("day") == F.lit("2023-03-27").cast("date"))).select("ping_id", "lat", "lon")


@entry("filter_contains", "SELECT ping_id, deviceid FROM raw WHERE regexp_matches(deviceid, '1[0-9]$')")
def filter_contains(spark, d):
    return fixtures.raw_pings(spark, d).where(F.col("deviceid").rlike("1[0-9]$")).select("ping_id", "deviceid")


@entry("dropna_subset", "SELECT ping_id, lat FROM (SELECT ping_id, CASE WHEN ping_id % 5 <> 0 THEN lat END AS lat FROM pings) WHERE lat IS NOT NULL")
def dropna_subset(spark, d):
    return pings(spark, d).select("ping_id", F.when(F.col("ping_id") % 5 != 0, F.col("lat")).alias("lat")).dropna(subset=["lat"])


@entry("parse_datetime", "SELECT ping_id, CAST(strptime(date || ' ' || time, '%d.%m.%Y %H:%M:%S') AS VARCHAR) AS datetime FROM raw")
def parse_datetime(spark, d):
    return at_text(fixtures.raw_pings(spark, d).select("ping_id", temporal.parse_datetime(F.col("date"), F.col("time")).alias("datetime")), "datetime")


@entry("parse_datetime_coerce", "SELECT ping_id, CAST(strptime(date || ' ' || time, '%d.%m.%Y %H:%M:%S') AS VARCHAR) AS datetime FROM raw WHERE ping_id % 7 <> 0")
def parse_datetime_coerce(spark, d):
    p = fixtures.raw_pings(spark, d).withColumn("time", F.when(F.col("ping_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("time")))
    p = p.select("ping_id", temporal.try_parse_datetime(F.col("date"), F.col("time")).alias("datetime"))
    return at_text(p.where(F.col("datetime").isNotNull()), "datetime")


@entry("factorize_devices", "SELECT deviceid, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS device_code FROM (SELECT deviceid, min(ping_id) AS f FROM pings GROUP BY deviceid)")
def factorize_devices(spark, d):
    return denoise.factorize_devices(pings(spark, d))


@entry("systematic_sample", "SELECT ping_id FROM (SELECT ping_id, row_number() OVER (ORDER BY ping_id) AS r FROM pings) WHERE r % 100 = 1")
def systematic_sample(spark, d):
    return ids(stats.systematic_sample(pings(spark, d).select("ping_id"), 100))


@entry("sample_bernoulli")
def sample_bernoulli(spark, d):
    return ids(pings(spark, d).sample(0.1, seed=42))


@entry("sample_fixed")
def sample_fixed(spark, d):
    return ids(stats.fixed_sample(pings(spark, d), 500))


_PARTS = 8


@entry(
    "greedy_split",
    "SELECT deviceid, n, part FROM dealt",
    before=f"""ranked AS (SELECT deviceid, n, row_number() OVER (ORDER BY deviceid) AS r FROM counts),
dealt AS (
  SELECT deviceid, n, r, CAST(0 AS INTEGER) AS part, list_transform(range({_PARTS}), lambda i: CASE WHEN i = 0 THEN n ELSE 0 END) AS loads FROM ranked WHERE r = 1
  UNION ALL
  SELECT k.deviceid, k.n, k.r, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER),
         list_transform(range({_PARTS}), lambda i: loads[i + 1] + CASE WHEN i = list_position(loads, list_min(loads)) - 1 THEN k.n ELSE 0 END)
  FROM dealt d JOIN ranked k ON k.r = d.r + 1)""",
)
def greedy_split(spark, d):
    return stats.greedy_split(pings(spark, d), _PARTS)


@entry("union_parts", "SELECT ping_id, lat, lon FROM pings")
def union_parts(spark, d):
    p = pings(spark, d).select("ping_id", "lat", "lon")
    return readers.union_parts([p.where(F.col("ping_id") % 4 == i) for i in range(4)])


@entry("rename_counters", "SELECT event_id AS counter_id, value AS avg_speed FROM events")
def rename_counters(spark, d):
    return fixtures.table(spark, d, "events").select("event_id", "value").withColumnsRenamed({"event_id": "counter_id", "value": "avg_speed"})


@entry("time_bins", "SELECT ping_id, CAST((hour(datetime) * 60 + minute(datetime)) // 30 AS INTEGER) AS time_bin, CAST(hour(datetime) * 3600 + minute(datetime) * 60 + second(datetime) AS BIGINT) AS seconds FROM pings")
def time_bins(spark, d):
    p = zones.add_time_bin(pings(spark, d), 30)
    return p.select("ping_id", "time_bin", temporal.seconds_of_day(F.col("datetime")).cast("long").alias("seconds"))


@entry("mercator", "SELECT ping_id, round(6378137e0 * radians(lon), 4) AS x, round(6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) AS y FROM pings")
def mercator(spark, d):
    return rounded(pings(spark, d).select("ping_id", geo.mercator_x(F.col("lon")).alias("x"), geo.mercator_y(F.col("lat")).alias("y")), 4)


# --- sources and sinks: written to the shared folder and read back ----------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@entry("schema_peek", "SELECT place, name FROM (VALUES (0, 'event_id'), (1, 'ts'), (2, 'user_id'), (3, 'event_type'), (4, 'value'), (5, 'props')) v(place, name)")
def schema_peek(spark, d):
    names = readers.schema_names(fixtures.table(spark, d, "events"))
    return spark.createDataFrame(list(enumerate(names)), "place int, name string")


@entry("scan_day_files", "SELECT ping_id, lat, CASE WHEN ping_id % 2 = 0 THEN '2023-03-27' ELSE '2023-03-28' END AS day FROM pings")
def scan_day_files(spark, d):
    path, p = _scratch(spark, "days"), pings(spark, d).drop("day")
    for rest, day in ((0, "20230327"), (1, "20230328")):
        p.where(F.col("ping_id") % 2 == rest).write.parquet(f"{path}/{day}.parquet")
    p.limit(5).write.parquet(f"{path}/towers.parquet")
    return at_text(readers.read_days(spark, f"{path}/*.parquet", skip=("towers.parquet",), columns=("ping_id", "lat")), "day")


@entry("write_day_folders", "SELECT ping_id, deviceid, lat, lon FROM pings WHERE day = DATE '2023-03-27' AND ping_id % 3 = 0")
def write_day_folders(spark, d):
    path = _scratch(spark, "folders")
    day = F.when(F.col("ping_id") % 3 == 0, F.col("day")).otherwise(F.date_add("day", 1))
    readers.write_days(pings(spark, d).withColumn("day", day), path)
    return spark.read.parquet(path).where(F.col("day") == F.lit("2023-03-27").cast("date")).select("ping_id", "deviceid", "lat", "lon")


@entry("write_with_schema", "SELECT CAST(ping_id AS INTEGER) AS ping_id, CAST(deviceid AS VARCHAR) AS deviceid, CAST(datetime AS VARCHAR) AS datetime FROM pings")
def write_with_schema(spark, d):
    path = _scratch(spark, "typed")
    schema = T.StructType([T.StructField("ping_id", T.IntegerType()), T.StructField("deviceid", T.StringType()), T.StructField("datetime", T.TimestampNTZType())])
    readers.write_as(pings(spark, d), path, schema)
    return at_text(spark.read.schema(schema).parquet(path), "datetime")


_COUNTRY = "CASE WHEN s_nationkey % 2 = 0 THEN 'Slovenia' ELSE 'Croatia' END"


@entry("csv_towers", f"SELECT lon AS \"LON\", lat AS \"LAT\" FROM towers JOIN (SELECT s_suppkey AS tower_id, {_COUNTRY} AS c FROM supplier) USING (tower_id) WHERE c = 'Slovenia'")
def csv_towers(spark, d):
    path = _scratch(spark, "towers")
    country = fixtures.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tower_id"), F.expr(_COUNTRY).alias("Country"))
    t = fixtures.towers(spark, d).join(country, "tower_id").select(F.col("lon").alias("LON"), F.col("lat").alias("LAT"), "Country", F.lit("Europe").alias("Continent"))
    readers.write_csv(t, path)
    return readers.read_towers_csv(spark, path, "Slovenia").select("LON", "LAT")


@entry("write_csv", "SELECT CAST(from_zone AS VARCHAR) AS from_zone, CAST(to_zone AS VARCHAR) AS to_zone, CAST(n AS VARCHAR) AS n FROM od")
def write_csv(spark, d):
    path = _scratch(spark, "od")
    readers.write_csv(transitions.od_matrix(mobility.dwell_transitions(spark, d)), path)
    return spark.read.csv(path, header=True)


_CORNERS = """SELECT zone_id, round(14.29e0 + 0.03e0 * (zone_id % 15), 6) AS west, round(45.891e0 + 0.02e0 * (zone_id // 15), 6) AS south,
  round(14.29e0 + 0.03e0 * (zone_id % 15 + 1), 6) AS east, round(45.891e0 + 0.02e0 * (zone_id // 15 + 1), 6) AS north FROM zones"""


def _corners(z: DataFrame) -> DataFrame:
    return rounded(z.select("zone_id", *[F.col("ring")[i][c].alias(n) for n, i, c in (("west", 0, "lon"), ("south", 0, "lat"), ("east", 2, "lon"), ("north", 2, "lat"))]))


@entry("zones_reproject", _CORNERS)
def zones_reproject(spark, d):
    path = _scratch(spark, "zones")
    metres = F.transform("ring", lambda p: F.struct(geo.mercator_x(p["lon"]).alias("lon"), geo.mercator_y(p["lat"]).alias("lat")))
    readers.write_zones_geojson(fixtures.zones(spark).withColumn("ring", metres), path)
    return _corners(readers.read_zones_geojson(spark, path, crs="EPSG:3857"))


@entry("geoparquet_scan", _CORNERS)
def geoparquet_scan(spark, d):
    path = _scratch(spark, "roads")
    fixtures.zones(spark).select("zone_id", readers.ring_wkb("ring").alias("geometry")).write.parquet(path)
    return _corners(readers.read_geoparquet(spark, path).withColumnRenamed("geometry", "ring"))


@entry("folder_sizes", "SELECT true AS found, CAST(3 AS BIGINT) AS files")
def folder_sizes(spark, d):
    path = _scratch(spark, "sizes")
    for i in range(3):
        spark.range(10).coalesce(1).write.parquet(f"{path}/part={i}")
    s = readers.folder_sizes(spark, path).where(F.col("name").endswith(".parquet"))
    return s.agg((F.min("bytes") > 0).alias("found"), F.count(F.lit(1)).alias("files"))


# --- deltas and speeds ---------------------------------------------------------------------


@entry("sequential_deltas", "SELECT ping_id, device_change, round(dist_m, 4) AS dist_m, dt, round(speed_m_s, 4) AS speed_m_s FROM deltas")
def sequential_deltas(spark, d):
    return rounded(denoise.sequential_deltas(pings(spark, d)).select("ping_id", "device_change", "dist_m", "dt", "speed_m_s"), 4)


@entry("compute_distances", "SELECT ping_id, round(coalesce(hav_asin, 0), 4) AS dist_m FROM meters")
def compute_distances(spark, d):
    return rounded(stats.distances(pings(spark, d)).select("ping_id", "dist_m"), 4)


@entry("bearings", "SELECT ping_id, round(degrees(b1) - 360 * floor(degrees(b1) / 360), 4) AS bearing FROM angles WHERE plat IS NOT NULL AND hav > 0")
def bearings(spark, d):
    w = denoise.device_window()
    p = pings(spark, d).select("ping_id", "lat", "lon", F.lag("lat").over(w).alias("a"), F.lag("lon").over(w).alias("o"))
    p = p.where(geo.haversine_m(F.col("a"), F.col("o"), F.col("lat"), F.col("lon")) > 0)
    return rounded(p.select("ping_id", geo.bearing_deg(F.col("a"), F.col("o"), F.col("lat"), F.col("lon")).alias("bearing")), 4)


_GLOBAL = """
SELECT ping_id, hav / gap AS speed_m_s FROM (SELECT *, epoch(datetime) - epoch(pt) AS gap, 2 * 6371000e0 * atan2(sqrt(a), sqrt(1 - a)) AS hav FROM (
  SELECT *, pow(sin((radians(lat) - radians(plat)) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(plon)) / 2), 2) AS a FROM (
    SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(datetime) OVER w AS pt FROM pings WINDOW w AS (ORDER BY datetime, ping_id)))) WHERE gap > 0"""


@entry("instant_speeds", f"SELECT ping_id, round(speed_m_s, 4) AS speed_m_s FROM ({_GLOBAL})")
def instant_speeds(spark, d):
    return rounded(stats.instant_speeds(pings(spark, d)), 4)


@entry("sampling_interval", "SELECT CAST(day AS VARCHAR) AS day, mean_s, median_s, std_s FROM intervals")
def sampling_interval(spark, d):
    return at_text(stats.sampling_interval(pings(spark, d)), "day")


@entry("speed_kmh", "SELECT ping_id, round(speed_kmh, 4) AS speed_kmh FROM kmh")
def speed_kmh(spark, d):
    return rounded(stats.speed_kmh(pings(spark, d)).select("ping_id", "speed_kmh"), 4)


@entry("speed_kmh_geodesic", f"SELECT ping_id, round(m / gap * 3.6e0, 4) AS speed_kmh FROM ({VINCENTY}) UNION ALL SELECT ping_id, NULL FROM meters WHERE gap IS NULL OR gap <= 0")
def speed_kmh_geodesic(spark, d):
    return rounded(stats.speed_kmh(pings(spark, d), ellipsoid=True).select("ping_id", "speed_kmh"), 4)


@entry("speed_range_kmh", "SELECT ping_id, round(speed_kmh, 4) AS speed_kmh FROM kmh WHERE speed_kmh > 1 AND speed_kmh < 200")
def speed_range_kmh(spark, d):
    return rounded(stats.filter_speed(stats.speed_kmh(pings(spark, d)), 200.0, 1.0).select("ping_id", "speed_kmh"), 4)


@entry("filter_high_speeds", "SELECT ping_id FROM kmh WHERE speed_kmh <= 100")
def filter_high_speeds(spark, d):
    return ids(stats.filter_speed(stats.speed_kmh(pings(spark, d)), 100.0))


@entry("speed_class", "SELECT ping_id, CASE WHEN speed_m_s < 1 THEN 'Stop' ELSE 'Movement' END AS class FROM deltas")
def speed_class(spark, d):
    p = denoise.sequential_deltas(pings(spark, d))
    return p.select("ping_id", F.when(F.col("speed_m_s") < 1, "Stop").otherwise("Movement").alias("class"))


# --- cleaning --------------------------------------------------------------------------------


@entry("denoise_tower", "SELECT ping_id FROM tower_ok")
def denoise_tower(spark, d):
    return ids(denoise.near_towers(pings(spark, d), fixtures.towers(spark, d)))


@entry("denoise_repeated", "SELECT ping_id FROM pings JOIN (SELECT day, lat, lon, count(*) AS n FROM pings GROUP BY ALL) USING (day, lat, lon) WHERE n < 6")
def denoise_repeated(spark, d):
    return ids(denoise.repeated_coordinates(pings(spark, d), mobility.REPEAT))


@entry("denoise_repeated_squash", "SELECT ping_id FROM (SELECT ping_id, row_number() OVER (PARTITION BY lat, lon ORDER BY deviceid, datetime, ping_id) AS r FROM pings) WHERE r = 1")
def denoise_repeated_squash(spark, d):
    return ids(denoise.squash_coordinates(pings(spark, d)))


@entry("denoise_zheng", "SELECT ping_id FROM angles WHERE plat IS NOT NULL AND nlat IS NOT NULL AND speed_m_s < 30 AND (turn > 30 OR dt > 10)")
def denoise_zheng(spark, d):
    return ids(denoise.zheng(pings(spark, d)))


@entry("denoise_zheng_planar", "SELECT ping_id FROM angles WHERE plat IS NOT NULL AND nlat IS NOT NULL AND CASE WHEN gap > 0 THEN hav / gap ELSE 0 END < 50 AND (interior > 30 OR gap > 10)")
def denoise_zheng_planar(spark, d):
    return ids(denoise.zheng_planar(pings(spark, d)))


_SLIDE = "SELECT ping_id FROM (SELECT ping_id, speed_m_s, median(speed_m_s) OVER ({w} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM deltas) WHERE speed_m_s <= m + 5"


@entry("denoise_sliding", _SLIDE.format(w="PARTITION BY day, deviceid ORDER BY datetime, ping_id"))
def denoise_sliding(spark, d):
    return ids(denoise.sliding_median(denoise.sequential_deltas(pings(spark, d))))


@entry("denoise_sliding_global", _SLIDE.format(w="ORDER BY deviceid, datetime, ping_id"))
def denoise_sliding_global(spark, d):
    return ids(denoise.sliding_median(denoise.sequential_deltas(pings(spark, d)), keys=None))


@entry(
    "denoise_sliding_pairs",
    """SELECT ping_id FROM (SELECT ping_id, median(v) OVER (PARTITION BY day, deviceid ORDER BY datetime, ping_id ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS m,
         count(*) OVER (PARTITION BY day, deviceid ORDER BY datetime, ping_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS k
       FROM (SELECT *, CASE WHEN gap > 0 THEN hav / gap END AS v FROM meters)) WHERE k > 1 AND coalesce(m, 0) < 50""",
)
def denoise_sliding_pairs(spark, d):
    return ids(denoise.sliding_pair_speeds(pings(spark, d)))


_RUNS = """SELECT *, sum(dt) OVER (PARTITION BY day, deviceid, run) AS dur FROM (
  SELECT *, sum(CASE WHEN rep THEN 0 ELSE 1 END) OVER (PARTITION BY day, deviceid ORDER BY datetime, ping_id) AS run
  FROM (SELECT *, coalesce(lat = plat AND lon = plon, false) AS rep FROM deltas))"""


@entry("denoise_long_stops", f"SELECT ping_id FROM ({_RUNS}) WHERE NOT (rep AND dur >= 300)")
def denoise_long_stops(spark, d):
    return ids(denoise.long_stops(denoise.sequential_deltas(pings(spark, d))))


@entry("denoise_long_stops_squash", f"SELECT ping_id FROM ({_RUNS}) WHERE NOT rep")
def denoise_long_stops_squash(spark, d):
    return ids(denoise.long_stops(denoise.sequential_deltas(pings(spark, d)), squash=True))


@entry("denoise_min_points", "SELECT ping_id FROM (SELECT ping_id, count(*) OVER (PARTITION BY day, deviceid) AS n FROM pings) WHERE n > 60")
def denoise_min_points(spark, d):
    return ids(denoise.min_points(pings(spark, d), 60))


@entry("denoise_pipeline", "SELECT ping_id, deviceid, round(speed_m_s, 4) AS speed_m_s FROM clean")
def denoise_pipeline(spark, d):
    return rounded(cleaned(spark, d)["min_points"].select("ping_id", "deviceid", "speed_m_s"), 4)


_REPORT = [("pings", "pings"), ("tower", "tower_ok"), ("repeated", "repeat_ok"), ("zheng", "zheng_ok"), ("sliding", "sliding_ok"), ("min_points", "clean")]


@entry(
    "denoise_report",
    "SELECT step, stage, rows, devices, coalesce(lag(rows) OVER (ORDER BY step) - rows, 0) AS dropped, round(coalesce(100e0 * (lag(rows) OVER (ORDER BY step) - rows) / lag(rows) OVER (ORDER BY step), 0), 4) AS dropped_pct FROM ("
    + " UNION ALL ".join(f"SELECT {i} AS step, '{n}' AS stage, count(*) AS rows, count(DISTINCT deviceid) AS devices FROM {t}" for i, (n, t) in enumerate(_REPORT))
    + ")",
)
def denoise_report(spark, d):
    return denoise.report(cleaned(spark, d))


# --- zones and towers ------------------------------------------------------------------------


@entry("zones_load", "SELECT zone_id, CAST(5 AS INTEGER) AS corners FROM zones")
def zones_load(spark, d):
    path = _scratch(spark, "zones")
    readers.write_zones_geojson(fixtures.zones(spark), path)
    return readers.read_zones_geojson(spark, path).select("zone_id", F.size("ring").alias("corners"))


@entry("zone_assign", "SELECT ping_id, zone_id FROM zoned")
def zone_assign(spark, d):
    return zones.assign_zones(pings(spark, d), fixtures.zones(spark)).select("ping_id", "zone_id")


@entry("zone_assign_matched", "SELECT ping_id, zone_id, time_bin FROM inside")
def zone_assign_matched(spark, d):
    return binned(spark, d).select("ping_id", "zone_id", "time_bin")


_KNN = """SELECT ping_id, max(CASE WHEN r = 1 THEN d END) AS d1, max(CASE WHEN r = 2 THEN d END) AS d2, max(CASE WHEN r = 3 THEN d END) AS d3,
  max(CASE WHEN r = 1 THEN tower_id END) AS tower1, max(CASE WHEN r = 2 THEN tower_id END) AS tower2, max(CASE WHEN r = 3 THEN tower_id END) AS tower3
  FROM (SELECT ping_id, tower_id, d, row_number() OVER (PARTITION BY ping_id ORDER BY d, tower_id) AS r
        FROM (SELECT ping_id, tower_id, sqrt(pow(p.lat - t.lat, 2) + pow(p.lon - t.lon, 2)) AS d FROM pings p CROSS JOIN towers t)) WHERE r <= 3 GROUP BY ping_id"""


@entry("knn_towers", f"SELECT ping_id, round(d1, 6) AS d1, round(d2, 6) AS d2, round(d3, 6) AS d3 FROM ({_KNN})")
def knn_towers(spark, d):
    return rounded(zones.knn_towers(pings(spark, d), fixtures.towers(spark, d)).select("ping_id", "d1", "d2", "d3"))


@entry("knn_outlier", f"SELECT ping_id FROM ({_KNN}) WHERE d1 <= 0.0055")
def knn_outlier(spark, d):
    return ids(zones.knn_towers(pings(spark, d), fixtures.towers(spark, d)).where(F.col("d1") <= 0.0055))


@entry(
    "nearest_tower",
    """SELECT p.ping_id, round(m, 3) AS tower_dist_m, m IS NOT NULL AS tower_ok FROM pings p LEFT JOIN (
         SELECT ping_id, min(sqrt(pow(x - tx, 2) + pow(y - ty, 2))) AS m FROM
           (SELECT ping_id, 6378137e0 * radians(lon) AS x, 6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y FROM pings),
           (SELECT 6378137e0 * radians(lon) AS tx, 6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS ty FROM towers)
         WHERE sqrt(pow(x - tx, 2) + pow(y - ty, 2)) <= 300 GROUP BY ping_id) USING (ping_id)""",
)
def nearest_tower(spark, d):
    return rounded(zones.nearest_tower(pings(spark, d), fixtures.towers(spark, d)).select("ping_id", "tower_dist_m", "tower_ok"), 3)


@entry(
    "grid_cells",
    """SELECT zone_id, r AS row, c AS col FROM (SELECT zone_id, unnest(range(CAST(floor((45.891e0 + 0.02e0 * (zone_id // 15)) / 0.01e0) AS BIGINT), CAST(ceil((45.891e0 + 0.02e0 * (zone_id // 15 + 1)) / 0.01e0) AS BIGINT))) AS r FROM zones)
       JOIN (SELECT zone_id, unnest(range(CAST(floor((14.29e0 + 0.03e0 * (zone_id % 15)) / 0.01e0) AS BIGINT), CAST(ceil((14.29e0 + 0.03e0 * (zone_id % 15 + 1)) / 0.01e0) AS BIGINT))) AS c FROM zones) USING (zone_id)""",
)
def grid_cells(spark, d):
    return zones.grid_cells(fixtures.zones(spark), 0.01)


@entry("zone_cluster_join", "SELECT zone_id, n FROM zones LEFT JOIN (SELECT zone_id, count(*) AS n FROM inside GROUP BY zone_id) USING (zone_id)")
def zone_cluster_join(spark, d):
    counts = binned(spark, d).groupBy(F.col("zone_id").cast("string").alias("zone_id")).agg(F.count(F.lit(1)).alias("n"))
    return zones.attach(fixtures.zones(spark), counts).select("zone_id", "n")


# --- features --------------------------------------------------------------------------------


def _block(name: str, cte: str, run: Callable[[DataFrame], DataFrame], columns: str) -> None:
    doubles = ", ".join(f"round({c[1:]}, 4) AS {c[1:]}" if c[0] == "~" else c for c in columns.split())
    entry(name, f"SELECT {doubles} FROM {cte}")(lambda spark, d: rounded(run(features.per_ping(binned(spark, d))), 4))


_block("feat_speed", "f_speed", features.speed, "zone_id time_bin ~speed_mean ~speed_median ~speed_min ~speed_max ~speed_var ~speed_q25 ~speed_q75")
_block("feat_density", "f_density", features.density, "zone_id time_bin ping_count unique_devs ~pings_per_dev")
_block("feat_entropy", "f_entropy", features.entropy, "zone_id time_bin ~dev_entropy")
_block("feat_dwell", "f_dwell", features.dwell, "zone_id time_bin ~dwell_mean ~dwell_median ~dwell_min ~dwell_max")
_block("feat_entries", "f_entries", features.entries, "zone_id in_count ~in_speed_mean")
_block("feat_exits", "f_exits", features.exits, "zone_id out_count ~out_speed_mean")
_block("feat_trans_entropy", "f_trans", features.transition_entropy, "zone_id ~trans_entropy")


@entry("feat_time_flags", "SELECT DISTINCT time_bin, time_bin IN (7, 8, 9) AS is_morning_commute, time_bin IN (16, 17, 18) AS is_evening_commute, time_bin <= 5 AS is_late_night FROM inside")
def feat_time_flags(spark, d):
    return features.time_flags(binned(spark, d).select("time_bin").distinct())


_FEATURES = "zone_id time_bin ~speed_mean ~speed_median ~speed_min ~speed_max ~speed_var ~speed_q25 ~speed_q75 ping_count unique_devs ~pings_per_dev ~dev_entropy ~dwell_mean ~dwell_median ~dwell_min ~dwell_max in_count ~in_speed_mean out_count ~out_speed_mean ~trans_entropy is_morning_commute is_evening_commute is_late_night prior_walk prior_car"
_FEATURE_SQL = "SELECT " + ", ".join(f"round({c[1:]}, 4) AS {c[1:]}" if c[0] == "~" else c for c in _FEATURES.split()) + " FROM feats"


@entry("zone_hour_features", _FEATURE_SQL)
def zone_hour_features(spark, d):
    return rounded(mobility.zone_hour_features(spark, d), 4)


@entry("top_zones", "SELECT zone_id, CAST(sum(ping_count) AS BIGINT) AS pings FROM f_density GROUP BY zone_id ORDER BY pings DESC, zone_id LIMIT 20")
def top_zones(spark, d):
    p = features.density(features.per_ping(binned(spark, d))).groupBy("zone_id").agg(F.sum("ping_count").alias("pings"))
    return p.orderBy(F.desc("pings"), "zone_id").limit(20)


# --- transitions -----------------------------------------------------------------------------


@entry("transitions_adjacent", "SELECT ping_id, from_zone, to_zone, valid, same_zone FROM adjacent")
def transitions_adjacent(spark, d):
    return transitions.adjacent(binned(spark, d)).select("ping_id", "from_zone", "to_zone", "valid", "same_zone")


@entry("transitions_adjacent_counts", "SELECT time_bin, from_zone, to_zone, count(*) AS n FROM adjacent WHERE valid GROUP BY ALL")
def transitions_adjacent_counts(spark, d):
    return transitions.count_adjacent(binned(spark, d))


@entry(
    "transitions_dwell_rowwise",
    """SELECT e.time_bin, a.zone_id AS from_zone, b.zone_id AS to_zone, count(*) AS n FROM
       (SELECT DISTINCT day, deviceid, time_bin FROM moves WHERE next_bin = time_bin + 1) e
       JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day, deviceid, time_bin ORDER BY s DESC, f) AS r FROM (
               SELECT day, deviceid, time_bin, zone_id, sum(CASE WHEN epoch(nt) - epoch(datetime) > 3600 THEN 0 ELSE epoch(nt) - epoch(datetime) END) AS s, min("at") AS f
               FROM moves WHERE nt IS NOT NULL GROUP BY ALL)) WHERE r = 1) a USING (day, deviceid, time_bin)
       JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day, deviceid, time_bin ORDER BY s DESC, f) AS r FROM (
               SELECT day, deviceid, time_bin, zone_id, sum(CASE WHEN epoch(nt) - epoch(datetime) > 3600 THEN 0 ELSE epoch(nt) - epoch(datetime) END) AS s, min("at") AS f
               FROM moves WHERE nt IS NOT NULL GROUP BY ALL)) WHERE r = 1) b ON b.day = e.day AND b.deviceid = e.deviceid AND b.time_bin = e.time_bin + 1
       GROUP BY e.time_bin, a.zone_id, b.zone_id""",
)
def transitions_dwell_rowwise(spark, d):
    return transitions.dwell_rowwise(binned(spark, d))


@entry("dominant_zone", "SELECT deviceid, time_bin, zone_id, seconds FROM dominant")
def dominant_zone(spark, d):
    return transitions.dominant_zone(binned(spark, d)).drop("day")


@entry("transitions_dwell", "SELECT time_bin, from_zone, to_zone, n FROM trans")
def transitions_dwell(spark, d):
    return mobility.dwell_transitions(spark, d)


@entry(
    "transition_graph",
    """SELECT zone_id AS src_zone, time_bin AS src_bin, next_zone AS dst_zone, next_bin AS dst_bin, count(*) AS weight FROM moves
       WHERE next_zone IS NOT NULL AND (next_zone <> zone_id OR next_bin <> time_bin) GROUP BY ALL""",
)
def transition_graph(spark, d):
    return transitions.graph(binned(spark, d))


@entry(
    "transition_validity",
    """SELECT count(*) AS total, CAST(sum(CAST(valid AS INTEGER)) AS BIGINT) AS valid, CAST(count(*) - sum(CAST(valid AS INTEGER)) AS BIGINT) AS invalid,
       round(100e0 * sum(CAST(valid AS INTEGER)) / count(*), 2) AS valid_pct, round(100e0 * (count(*) - sum(CAST(valid AS INTEGER))) / count(*), 2) AS invalid_pct FROM adjacent""",
)
def transition_validity(spark, d):
    return transitions.validity(binned(spark, d))


@entry("transitions_per_bin", "SELECT time_bin, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / (SELECT sum(n) FROM trans), 6) AS share FROM trans GROUP BY time_bin")
def transitions_per_bin(spark, d):
    return transitions.per_bin(mobility.dwell_transitions(spark, d))


@entry("transitions_summary", "SELECT count(DISTINCT time_bin) AS bins, count(DISTINCT from_zone) AS origins, count(DISTINCT to_zone) AS destinations, CAST(sum(n) AS BIGINT) AS total FROM trans")
def transitions_summary(spark, d):
    return transitions.summary(mobility.dwell_transitions(spark, d))


@entry("transitions_map", "SELECT time_bin, from_zone, to_zone, n FROM trans")
def transitions_map(spark, d):
    m = transitions.nested_map(mobility.dwell_transitions(spark, d))
    m = m.select(F.explode("transitions").alias("time_bin", "f")).select("time_bin", F.explode("f").alias("from_zone", "t"))
    return m.select("time_bin", "from_zone", F.explode("t").alias("to_zone", "n"))


@entry("od_matrix", "SELECT from_zone, to_zone, n FROM od")
def od_matrix(spark, d):
    return transitions.od_matrix(mobility.dwell_transitions(spark, d))


@entry(
    "od_dense_log",
    """SELECT a.z AS from_zone, b.z AS to_zone, coalesce(n, 0) AS n, round(ln(1 + coalesce(n, 0)), 6) AS log_n
       FROM (SELECT from_zone AS z FROM od UNION SELECT to_zone FROM od) a CROSS JOIN (SELECT from_zone AS z FROM od UNION SELECT to_zone FROM od) b
       LEFT JOIN od ON od.from_zone = a.z AND od.to_zone = b.z""",
)
def od_dense_log(spark, d):
    return rounded(transitions.od_dense(mobility.dwell_transitions(spark, d)))


@entry("od_pivot", "SELECT from_zone, " + ", ".join(f'CAST(coalesce(sum(n) FILTER (to_zone = {z}), 0) AS BIGINT) AS "{z}"' for z in fixtures.ZONE_IDS) + " FROM od GROUP BY from_zone")
def od_pivot(spark, d):
    return transitions.od_pivot(mobility.dwell_transitions(spark, d), fixtures.ZONE_IDS)


# --- statistics ------------------------------------------------------------------------------

_STATS = """SELECT count(*) AS n_points, count(DISTINCT deviceid) AS n_devices, round(count(*) / count(DISTINCT deviceid), 2) AS avg_points_per_device,
  round((epoch(max(datetime)) - epoch(min(datetime))) / 3600, 2) AS hours_covered FROM {t}"""


@entry("dataset_stats", _STATS.format(t="pings"))
def dataset_stats(spark, d):
    return stats.dataset_stats(pings(spark, d))


@entry(
    "compare_stats",
    "SELECT measure, before, after, round((before - after) / before * 100, 2) AS reduction_pct FROM ("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS measure, CAST(a.{m} AS DOUBLE) AS before, CAST(b.{m} AS DOUBLE) AS after FROM ({_STATS.format(t='pings')}) a, ({_STATS.format(t='inside')}) b"
        for m in ("n_points", "n_devices", "avg_points_per_device", "hours_covered")
    )
    + ")",
)
def compare_stats(spark, d):
    return stats.compare_stats(pings(spark, d), binned(spark, d))


_DAYS = "total_points, unique_devices, avg_points_per_device, median_points_per_device, std_points_per_device, mean_s, median_s, std_s, day_pct, night_pct, hours_covered, lat_min, lat_max, lon_min, lon_max, area_km2"


@entry("daily_stats", f"SELECT CAST(day AS VARCHAR) AS day, {_DAYS} FROM days")
def daily_stats(spark, d):
    return at_text(stats.daily(pings(spark, d)), "day")


@entry(
    "weekly_stats",
    """SELECT CAST(sum(total_points) AS BIGINT) AS total_points, CAST(sum(unique_devices) AS BIGINT) AS unique_devices_total, round(avg(total_points), 2) AS avg_points_per_day, round(avg(unique_devices), 2) AS avg_devices_per_day,
       round(sum(hours_covered), 2) AS total_hours_covered, round(avg(day_pct), 2) AS avg_day_pct, round(avg(area_km2), 2) AS avg_area_km2 FROM days""",
)
def weekly_stats(spark, d):
    return stats.weekly(stats.daily(pings(spark, d)))


@entry(
    "null_counts",
    """SELECT count(*) FILTER (deviceid IS NULL) AS deviceid_nulls, count(*) FILTER (ping_id % 5 = 0 OR lat IS NULL) AS lat_nulls, count(*) FILTER (lon IS NULL) AS lon_nulls,
       count(*) FILTER (datetime IS NULL) AS datetime_nulls FROM pings""",
)
def null_counts(spark, d):
    return stats.null_counts(pings(spark, d).withColumn("lat", F.when(F.col("ping_id") % 5 != 0, F.col("lat"))))


@entry("day_night_ratio", "SELECT CAST(day AS VARCHAR) AS day, day_pct, night_pct FROM days")
def day_night_ratio(spark, d):
    return at_text(stats.day_night(pings(spark, d)), "day")


@entry(
    "hourly_pings",
    """SELECT CAST(h AS VARCHAR) AS hour, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(date_trunc('hour', datetime)) FROM pings), (SELECT max(date_trunc('hour', datetime)) FROM pings), INTERVAL 1 HOUR)) AS h)
       LEFT JOIN (SELECT date_trunc('hour', datetime) AS h, count(*) AS n FROM pings GROUP BY 1) USING (h)""",
)
def hourly_pings(spark, d):
    return at_text(stats.hourly_pings(pings(spark, d)), "hour")


@entry(
    "speed_histogram",
    f"""SELECT CAST(least(floor((speed_m_s - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n FROM (SELECT round(speed_m_s, 4) AS speed_m_s FROM ({_GLOBAL})),
       (SELECT min(round(speed_m_s, 4)) AS lo, max(round(speed_m_s, 4)) AS hi FROM ({_GLOBAL})) GROUP BY 1""",
)
def speed_histogram(spark, d):
    return stats.histogram(rounded(stats.instant_speeds(pings(spark, d)), 4), "speed_m_s")


@entry(
    "speed_bins",
    """SELECT zone_id, round(quantile_cont(speed_kmh, 0.5), 4) AS median, round(CASE WHEN count(speed_kmh) > 1 THEN stddev_samp(speed_kmh) END, 4) AS std, count(speed_kmh) AS n
       FROM kmh JOIN (SELECT ping_id, zone_id FROM inside) USING (ping_id) GROUP BY zone_id""",
)
def speed_bins(spark, d):
    zoned = zones.assign_zones(stats.speed_kmh(pings(spark, d)), fixtures.zones(spark), keep_unmatched=False)
    return rounded(stats.speed_bins(zoned), 4)


@entry(
    "tower_zone_stats",
    f"""SELECT t AS tower1, round(min(speed_m_s), 4) AS min_speed, round(max(speed_m_s), 4) AS max_speed, round(avg(speed_m_s), 4) AS avg_speed, CAST(sum(dt) AS BIGINT) AS dwell_s
       FROM deltas JOIN (SELECT ping_id, arg_min(tower_id, (round(sqrt(pow(p.lat - t.lat, 2) + pow(p.lon - t.lon, 2)), 9), tower_id)) AS t FROM pings p CROSS JOIN towers t GROUP BY ping_id) USING (ping_id) GROUP BY t""",
)
def tower_zone_stats(spark, d):
    near = zones.knn_towers(pings(spark, d), fixtures.towers(spark, d), k=1, digits=9).select("ping_id", "tower1")
    return rounded(stats.tower_zone_stats(denoise.sequential_deltas(pings(spark, d)).join(near, "ping_id")), 4)


@entry("daily_distance", "SELECT deviceid, round(daily_distance_m, 3) AS daily_distance_m, trip_duration_s FROM distance")
def daily_distance(spark, d):
    return rounded(stats.daily_distance(pings(spark, d)).drop("day"), 3)


@entry("trip_duration", "SELECT deviceid, trip_duration_s FROM distance")
def trip_duration(spark, d):
    return stats.trip_duration(pings(spark, d)).drop("day")


@entry("max_distance_device", "SELECT deviceid, round(daily_distance_m, 3) AS daily_distance_m FROM distance ORDER BY distance.daily_distance_m DESC, deviceid LIMIT 1")
def max_distance_device(spark, d):
    return rounded(stats.longest_device(stats.daily_distance(pings(spark, d))), 3)


@entry("top_device", "SELECT deviceid, n FROM counts ORDER BY n DESC, deviceid LIMIT 1")
def top_device(spark, d):
    return stats.top_device(pings(spark, d))


@entry(
    "describe_distance",
    """SELECT count(x) AS n, round(avg(x), 3) AS mean, round(stddev_samp(x), 3) AS std, round(min(x), 3) AS min, round(quantile_cont(x, 0.25), 3) AS q25, round(quantile_cont(x, 0.5), 3) AS q50,
       round(quantile_cont(x, 0.75), 3) AS q75, round(max(x), 3) AS max FROM (SELECT daily_distance_m AS x FROM distance)""",
)
def describe_distance(spark, d):
    return rounded(stats.describe(stats.daily_distance(pings(spark, d)), "daily_distance_m"), 3)


@entry("distance_totals", "SELECT count(DISTINCT deviceid) AS devices, round(sum(daily_distance_m) / 1000, 3) AS total_km FROM distance")
def distance_totals(spark, d):
    return rounded(stats.distance_totals(stats.daily_distance(pings(spark, d))), 3)


@entry("percentile_device", "SELECT deviceid, n, q FROM counts, (SELECT quantile_cont(CAST(n AS DOUBLE), 0.9) AS q FROM counts) ORDER BY abs(n - q), n DESC, deviceid LIMIT 1")
def percentile_device(spark, d):
    return stats.percentile_device(pings(spark, d))


@entry("map_center", "SELECT round(avg(lat), 6) AS lat_mean, round(avg(lon), 6) AS lon_mean, round(quantile_cont(lat, 0.5), 6) AS lat_median, round(quantile_cont(lon, 0.5), 6) AS lon_median FROM pings")
def map_center(spark, d):
    return rounded(stats.map_center(pings(spark, d)))


@entry("zones_involved", "SELECT zone_id, zone_id IN (SELECT from_zone FROM trans UNION SELECT to_zone FROM trans) AS involved FROM zones")
def zones_involved(spark, d):
    return stats.zones_involved(fixtures.zones(spark), mobility.dwell_transitions(spark, d))


@entry("trace_user", "SELECT deviceid, CAST(row_number() OVER (PARTITION BY deviceid ORDER BY datetime, ping_id) - 1 AS INTEGER) AS place, ping_id, lat, lon FROM pings")
def trace_user(spark, d):
    t = stats.trace(pings(spark, d)).select("deviceid", F.posexplode("trace").alias("place", "x"))
    return t.select("deviceid", "place", "x.ping_id", "x.lat", "x.lon")


@entry("trace_compare", "SELECT ping_id, ping_id IN (SELECT ping_id FROM clean) AS kept FROM pings")
def trace_compare(spark, d):
    made = cleaned(spark, d)
    return stats.trace_compare(made["pings"], made["min_points"]).select("ping_id", "kept")


# --- stays and segments ----------------------------------------------------------------------


@entry("stay_points", "SELECT deviceid, CAST(arrival AS VARCHAR) AS arrival, CAST(leave AS VARCHAR) AS leave, round(stay_lat, 6) AS stay_lat, round(stay_lon, 6) AS stay_lon, round(duration_min, 4) AS duration_min FROM stays")
def stay_points(spark, d):
    s = mobility.stay_points(spark, d).withColumn("duration_min", F.round("duration_min", 4))
    return rounded(at_text(s.drop("day"), "arrival", "leave"))


@entry(
    "stay_points_zoned",
    """SELECT deviceid, CAST(arrival AS VARCHAR) AS arrival, CASE WHEN stay_lat < 46.111e0 THEN CAST(floor((round(stay_lat, 6) - 45.891e0) / 0.02e0) * 15 + floor((round(stay_lon, 6) - 14.29e0) / 0.03e0) AS INTEGER) END AS zone_id FROM stays""",
)
def stay_points_zoned(spark, d):
    s = mobility.stay_points(spark, d).select("deviceid", "arrival", F.round("stay_lat", 6).alias("lat"), F.round("stay_lon", 6).alias("lon"))
    s = s.withColumn("ping_id", F.struct("deviceid", "arrival"))
    return at_text(zones.assign_zones(s, fixtures.zones(spark)).select("deviceid", "arrival", "zone_id"), "arrival")


@entry(
    "stay_moves",
    """SELECT * FROM (SELECT deviceid, round(stay_lat, 6) AS from_lat, round(stay_lon, 6) AS from_lon, round(lead(stay_lat) OVER w, 6) AS to_lat, round(lead(stay_lon) OVER w, 6) AS to_lon
       FROM stays WINDOW w AS (PARTITION BY day, deviceid ORDER BY arrival)) WHERE to_lat IS NOT NULL""",
)
def stay_moves(spark, d):
    return rounded(stays.stay_moves(mobility.stay_points(spark, d)).drop("day"))


@entry("heatmap_points", "SELECT round(stay_lat, 4) AS lat, round(stay_lon, 4) AS lon, round(sum(duration_min), 3) AS weight FROM stays GROUP BY 1, 2")
def heatmap_points(spark, d):
    return stats.heatmap_points(mobility.stay_points(spark, d)).withColumn("weight", F.round("weight", 3))


@entry(
    "trip_segments",
    """SELECT deviceid, CAST(seg AS INTEGER) AS segment, CASE WHEN bool_and(stop) THEN 'Stop' ELSE 'Movement' END AS type, CAST(min(datetime) AS VARCHAR) AS start, CAST(max(datetime) AS VARCHAR) AS "end",
         CAST(epoch(max(datetime)) - epoch(min(datetime)) AS BIGINT) AS duration_s, CASE WHEN bool_and(stop) THEN round(avg(lat), 7) END AS mean_lat, CASE WHEN bool_and(stop) THEN round(avg(lon), 7) END AS mean_lon,
         CASE WHEN NOT bool_and(stop) THEN round(coalesce(sum(CASE WHEN first THEN NULL ELSE hav END), 0), 4) END AS distance_m,
         CASE WHEN NOT bool_and(stop) AND max(datetime) > min(datetime) THEN round(coalesce(sum(CASE WHEN first THEN NULL ELSE hav END), 0) / (epoch(max(datetime)) - epoch(min(datetime))), 4) END AS avg_speed_m_s, count(*) AS n_points
       FROM (SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY day, deviceid ORDER BY datetime, ping_id) AS seg FROM (
         SELECT *, coalesce(lag(stop) OVER (PARTITION BY day, deviceid ORDER BY datetime, ping_id) <> stop, true) AS first FROM (SELECT *, speed_m_s < 1 AS stop FROM deltas)))
       GROUP BY day, deviceid, seg""",
)
def trip_segments(spark, d):
    p = denoise.sequential_deltas(pings(spark, d)).withColumn("is_stop", F.col("speed_m_s") < 1)
    s = at_text(stays.segments(p).drop("day"), "start", "end")
    digits = {"mean_lat": 7, "mean_lon": 7, "distance_m": 4, "avg_speed_m_s": 4}
    return s.withColumns({c: F.round(c, n) for c, n in digits.items()})


# --- modes and clusters ----------------------------------------------------------------------

_CENTRES = [(0.5, 1.0), (1.5, 3.0), (2.5, 5.0), (3.0, 2.0)]
_MODE_SQL = "SELECT zone_id, time_bin, CASE list_position(ds, list_min(ds)) WHEN 1 THEN 'Walk' WHEN 2 THEN 'Bike' WHEN 3 THEN 'Car' ELSE 'Others' END AS mode_kmeans FROM (SELECT zone_id, time_bin, [{}] AS ds FROM feats)".format(
    ", ".join(f"pow(ln(1 + speed_mean) - {a}e0, 2) + pow(ln(1 + dwell_mean) - {b}e0, 2)" for a, b in _CENTRES)
)


@entry("modes_fixed", _MODE_SQL)
def modes_fixed(spark, d):
    return modes.fixed_modes(mobility.zone_hour_features(spark, d), _CENTRES).select("zone_id", "time_bin", "mode_kmeans")


@entry("mode_shares", f"SELECT m AS mode, round(coalesce(100e0 * n / (SELECT count(*) FROM feats), 0), 4) AS share_pct FROM (SELECT unnest(['Walk', 'Bike', 'Car', 'Others']) AS m) LEFT JOIN (SELECT mode_kmeans AS m, count(*) AS n FROM ({_MODE_SQL}) GROUP BY 1) USING (m)")
def mode_shares(spark, d):
    return modes.mode_shares(modes.fixed_modes(mobility.zone_hour_features(spark, d), _CENTRES))


@entry("modes_kmeans")
def modes_kmeans(spark, d):
    return modes.kmeans_modes(mobility.zone_hour_features(spark, d)).select("zone_id", "time_bin", "mode_kmeans")


@entry("modes_hmm", _MODE_SQL.replace("AS mode_kmeans", "AS mode_hmm"))
def modes_hmm(spark, d):
    m = modes.fixed_modes(mobility.zone_hour_features(spark, d), _CENTRES).select("zone_id", "time_bin", "mode_kmeans")
    return modes.hmm_modes(m).select("zone_id", "time_bin", "mode_hmm")


_LN = {"stay": "ln((1 - 0.9e0) / 3 + (0.9e0 - (1 - 0.9e0) / 3))", "move": "ln((1 - 0.9e0) / 3)", "same": "ln(0.1e0 / 3 + (1 - 0.1e0 - 0.1e0 / 3))", "slip": "ln(0.1e0 / 3)"}
_STEP = "list_transform([1, 2, 3, 4], lambda p: best[p] + CASE WHEN p = s THEN {stay} ELSE {move} END)".format(**_LN)
_EMIT = "CASE WHEN o = s THEN {same} ELSE {slip} END".format(**_LN)


@entry(
    "modes_hmm_smoothed",
    f"""SELECT q.zone_id, q.time_bin, q.mode_kmeans, (['Walk', 'Bike', 'Car', 'Others'])[path[CAST(q.r AS INTEGER)]] AS mode_hmm
        FROM seq q JOIN (SELECT zone_id, paths[list_position(best, list_max(best))] AS path FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY r DESC) AS x FROM walk) WHERE x = 1) w USING (zone_id)""",
    before=f"""seq AS (SELECT *, list_position(['Walk', 'Bike', 'Car', 'Others'], mode_kmeans) AS o, row_number() OVER (PARTITION BY zone_id ORDER BY time_bin) AS r FROM ({_MODE_SQL})),
walk AS (
  SELECT zone_id, r, list_transform([1, 2, 3, 4], lambda s: {_EMIT} - ln(4e0)) AS best, list_transform([1, 2, 3, 4], lambda s: [s]) AS paths FROM seq WHERE r = 1
  UNION ALL
  SELECT q.zone_id, q.r, list_transform([1, 2, 3, 4], lambda s: list_max({_STEP}) + {_EMIT}),
         list_transform([1, 2, 3, 4], lambda s: list_append(paths[list_position({_STEP}, list_max({_STEP}))], s))
  FROM walk w JOIN seq q ON q.zone_id = w.zone_id AND q.r = w.r + 1)""",
)
def modes_hmm_smoothed(spark, d):
    m = modes.fixed_modes(mobility.zone_hour_features(spark, d), _CENTRES).select("zone_id", "time_bin", "mode_kmeans")
    return modes.hmm_modes(m, slip=0.1)


@entry("zone_clusters")
def zone_clusters(spark, d):
    return clustering.zone_clusters(transitions.od_dense(mobility.dwell_transitions(spark, d)))


_NEAR = "2 * asin(sqrt(least(1e0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"


@entry("dbscan", "SELECT a AS ping_id, g AS deviceid, cluster FROM labels", before=CLUSTERS.format(rows="SELECT *, deviceid AS g FROM pings", near=f"a.day = b.day AND {_NEAR} <= 0.001e0"))
def dbscan(spark, d):
    return clustering.dbscan(pings(spark, d).drop("datetime")).select("ping_id", "deviceid", "cluster")


@entry("dbscan_by_zone", "SELECT a AS ping_id, g AS zone_id, cluster FROM labels", before=CLUSTERS.format(rows="SELECT *, zone_id AS g FROM inside", near=f"{_NEAR} <= 0.0009e0"))
def dbscan_by_zone(spark, d):
    p = binned(spark, d).select("ping_id", "zone_id", "lat", "lon")
    return clustering.dbscan(p, eps_rad=0.0009, keys=("zone_id",)).select("ping_id", "zone_id", "cluster")


@entry(
    "st_dbscan",
    "SELECT a AS ping_id, g AS deviceid, cluster FROM labels",
    before=CLUSTERS.format(rows="SELECT *, deviceid AS g FROM pings", near=f"a.day = b.day AND sqrt(pow(6371000e0 * {_NEAR}, 2) + pow(epoch(b.datetime) - epoch(a.datetime), 2)) <= 500"),
)
def st_dbscan(spark, d):
    return clustering.st_dbscan(pings(spark, d), eps=500.0, per_second=1.0).select("ping_id", "deviceid", "cluster")


@entry("haversine_matrix", f"SELECT a.ping_id AS a, b.ping_id AS b, round(6371000e0 * {_NEAR}, 4) AS metres FROM pings a JOIN pings b USING (day, deviceid) WHERE deviceid = 7")
def haversine_matrix(spark, d):
    return rounded(clustering.haversine_matrix(pings(spark, d).where(F.col("deviceid") == 7)).select("a", "b", "metres"), 4)


@entry(
    "dbscan_core_points",
    """SELECT a.ping_id, count(*) AS neighbours, count(*) >= 5 AS is_core FROM pings a JOIN pings b ON a.deviceid = b.deviceid AND a.day = b.day
       WHERE 2 * 6371000e0 * asin(sqrt(least(1e0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))) <= 0.001 * 6371000e0
       GROUP BY a.ping_id""",
)
def dbscan_core_points(spark, d):
    return clustering.dbscan_core(pings(spark, d))


@entry(
    "st_dbscan_core",
    """SELECT a.ping_id, count(*) AS neighbours, count(*) >= 5 AS is_core FROM pings a JOIN pings b ON a.day = b.day AND a.datetime = b.datetime
       WHERE 2 * 6371000e0 * asin(sqrt(least(1e0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))) <= 500
       GROUP BY a.ping_id""",
)
def st_dbscan_core(spark, d):
    return clustering.st_dbscan_core(pings(spark, d))


@entry("gmm_zone")
def gmm_zone(spark, d):
    return rounded(clustering.gmm_by_zone(binned(spark, d)))


# --- extension ---------------------------------------------------------------------------------


@entry("windowed_zone_counts", "SELECT CAST(date_trunc('hour', datetime) AS VARCHAR) AS start, zone_id, count(*) AS pings FROM inside GROUP BY 1, 2")
def zone_counts(spark, d):
    p = pings(spark, d).withColumn("at", F.col("datetime").cast("timestamp"))
    return at_text(windowed_zone_counts(p, fixtures.zones(spark)), "start")
