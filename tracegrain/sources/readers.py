"""Sources and sinks of the pipeline: pings, towers, zones, summaries."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo

RAW_PINGS = T.StructType(
    [
        T.StructField("deviceid", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("time", T.StringType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
    ]
)
TOWERS_CSV = T.StructType([T.StructField("LON", T.DoubleType()), T.StructField("LAT", T.DoubleType()), T.StructField("Country", T.StringType()), T.StructField("Continent", T.StringType())])
POINTS = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))
_GEOJSON = "type string, features array<struct<type string, properties map<string,string>, geometry struct<type string, coordinates array<array<array<double>>>>>>"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself, or an error that names what is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def schema_names(df: DataFrame) -> list[str]:
    """Column names without reading data."""
    return df.schema.names


def read_days(spark: SparkSession, pattern: str, skip: tuple[str, ...] = (), columns: tuple[str, ...] | None = None) -> DataFrame:
    """All day files (YYYYMMDD.parquet) of a glob, with ``day`` from the file's name.

    ``skip`` names files to leave out; ``columns`` is pushed to the scan.
    """
    df = spark.read.parquet(pattern)
    path = F.col("_metadata.file_path")  # the day file may be a folder of parts
    file = F.regexp_extract(path, r"([^/]+\.parquet)(?:/part-[^/]*)?$", 1).alias("_file")
    df = df.select(*(columns or ["*"]), file)
    if skip:
        df = df.where(~F.col("_file").isin(*skip))
    return df.withColumn("day", F.to_date(F.regexp_extract("_file", r"(\d{8})", 1), "yyyyMMdd")).drop("_file")


def read_towers_csv(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """Towers of a CSV file with a fixed schema; one country's if asked for."""
    df = spark.read.csv(path, header=True, schema=TOWERS_CSV)
    return df.where(F.col("Country") == country) if country else df


def read_zones_geojson(spark: SparkSession, path: str, id_property: str = "zone_id", crs: str = "EPSG:4326") -> DataFrame:
    """Zones of a GeoJSON file of polygons: ``zone_id``, ``ring`` in degrees; a missing id is the feature's place.

    ``crs`` is the file's system: EPSG:4326 (degrees) or EPSG:3857 (metres of Web Mercator).
    """
    if crs not in ("EPSG:4326", "EPSG:3857"):
        raise ValueError(f"unknown system {crs}")
    lon, lat = (geo.mercator_lon, geo.mercator_lat) if crs == "EPSG:3857" else (lambda x: x, lambda y: y)
    found = spark.read.schema(_GEOJSON).json(path, multiLine=True).select(F.posexplode("features").alias("_at", "f"))
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(lon(p[0]).alias("lon"), lat(p[1]).alias("lat")))
    return found.select(F.coalesce(F.col("f.properties")[id_property].cast("int"), F.col("_at")).alias("zone_id"), ring.alias("ring"))


def read_geoparquet(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """A Parquet file with a WKB column of lines or polygons, which becomes ``array<struct<lon, lat>>`` (a polygon's outer ring)."""
    return spark.read.parquet(path).withColumn(geometry, wkb_points(geometry))


@F.pandas_udf(POINTS)
def wkb_points(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Points of WKB lines and polygons (in Arrow batches); null for a null and for other kinds."""
    for batch in batches:
        yield batch.map(_points_of)


def _points_of(raw: bytes | None) -> list[dict[str, float]] | None:
    if raw is None:
        return None
    end = "<" if raw[0] == 1 else ">"
    kind = struct.unpack_from(f"{end}I", raw, 1)[0]
    if kind not in (2, 3):
        return None
    at = 5 if kind == 2 else 9  # a polygon counts its rings first
    n = struct.unpack_from(f"{end}I", raw, at)[0]
    xy = struct.unpack_from(f"{end}{2 * n}d", raw, at + 4)
    return [{"lon": x, "lat": y} for x, y in zip(xy[::2], xy[1::2])]


@F.pandas_udf(T.BinaryType())
def ring_wkb(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """WKB polygon of a ring ``array<struct<lon, lat>>``."""
    for batch in batches:
        yield batch.map(lambda ring: None if ring is None else struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<2d", p["lon"], p["lat"]) for p in ring))


def read_xlsx(spark: SparkSession, path: str, sheet: str, header_row: int = 3) -> DataFrame:
    """A sheet of a workbook (small files; needs openpyxl on the driver)."""
    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, header=header_row))


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """Part tables as one, columns matched by name."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def write_days(df: DataFrame, path: str) -> None:
    """Parquet (snappy), a folder for each day: later scans read only the days they ask for."""
    df.write.mode("overwrite").option("compression", "snappy").partitionBy("day").parquet(path)


def write_as(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Parquet with a given schema."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_zones_geojson(df: DataFrame, path: str) -> None:
    """Zones (reference data) as one GeoJSON collection."""
    point = lambda p: F.array(p["lon"], p["lat"])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", point)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("zone_id").alias("properties"), geometry.alias("geometry"))
    whole = df.agg(F.sort_array(F.collect_list(F.struct("zone_id", feature.alias("f")))).alias("x"))
    collection = F.struct(F.lit("FeatureCollection").alias("type"), F.transform("x", lambda z: z["f"]).alias("features"))
    whole.select(F.to_json(collection).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def folder_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``name``, ``bytes`` of the files below a path, from metadata only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"))
