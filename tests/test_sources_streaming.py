"""Readers, writers and the streaming variant."""

import datetime as dt
import json
import struct

import pytest
from pyspark.sql import functions as F

from tracegrain.sources import fixtures, readers
from tracegrain.streaming.zone_counts import windowed_zone_counts


def test_day_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "27.03.2023", "10:00:00", 14.0, 46.0)], readers.RAW_PINGS)
    for day in ("20230327", "20230328", "towers"):
        rows.toPandas().to_parquet(tmp_path / f"{day}.parquet")
    df = readers.read_days(spark, f"{tmp_path}/*.parquet", skip=("towers.parquet",), columns=("deviceid", "lat"))
    assert {str(r.day) for r in df.collect()} == {"2023-03-27", "2023-03-28"} and readers.schema_names(df) == ["deviceid", "lat", "day"]
    readers.write_days(df, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").where(F.col("day") == F.lit("2023-03-27").cast("date"))
    assert back.count() == 1
    assert {r.name for r in readers.folder_sizes(spark, f"{tmp_path}/out").collect()} != set()


def test_csv_and_geojson(spark, tmp_path):
    (tmp_path / "t.csv").write_text("LON,LAT,Country,Continent\n14.5,46.0,Slovenia,Europe\n15,45,Croatia,Europe\n")
    assert readers.read_towers_csv(spark, f"{tmp_path}/t.csv", "Slovenia").first().LON == 14.5
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    features = [{"type": "Feature", "properties": p, "geometry": {"type": "Polygon", "coordinates": [ring]}} for p in ({}, {"zone_id": "9"})]
    (tmp_path / "z.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    z = readers.read_zones_geojson(spark, f"{tmp_path}/z.json")
    assert sorted((r.zone_id, len(r.ring)) for r in z.collect()) == [(0, 4), (9, 4)]
    readers.write_zones_geojson(z, f"{tmp_path}/zo")
    assert [f["geometry"]["type"] for f in json.loads(spark.read.text(f"{tmp_path}/zo").first()[0])["features"]] == ["Polygon"] * 2
    assert sorted(map(tuple, readers.read_zones_geojson(spark, f"{tmp_path}/zo").collect())) == sorted(map(tuple, z.collect()))
    with pytest.raises(ValueError, match="EPSG:1"):
        readers.read_zones_geojson(spark, f"{tmp_path}/z.json", crs="EPSG:1")
    readers.write_csv(z.select("zone_id"), f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 2


def test_geometries_of_either_byte_order(spark, tmp_path):
    line = lambda e: struct.pack(f"{e}BII4d", int(e == "<"), 2, 2, 14.0, 46.0, 15.0, 47.0)
    rows = [(1, line("<")), (2, line(">")), (3, None), (4, struct.pack("<BI2d", 1, 1, 14.0, 46.0))]
    spark.createDataFrame(rows, "id int, geometry binary").write.parquet(f"{tmp_path}/r")
    got = {r.id: r.geometry and [tuple(p) for p in r.geometry] for r in readers.read_geoparquet(spark, f"{tmp_path}/r").collect()}
    assert got == {1: [(14.0, 46.0), (15.0, 47.0)], 2: [(14.0, 46.0), (15.0, 47.0)], 3: None, 4: None}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="lat"):
        readers.require_columns(spark.range(1), "lat")


def test_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2023, 3, 27, 8)
    rows = [(start + dt.timedelta(minutes=7 * i), 45.9 + 0.002 * (i % 10), 14.3) for i in range(40)]
    p = spark.createDataFrame(rows, "at timestamp, lat double, lon double")
    p.write.parquet(f"{tmp_path}/in")
    z = fixtures.zones(spark)
    stream = spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in")
    q = windowed_zone_counts(stream, z).writeStream.outputMode("complete").format("memory").queryName("zone_counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("zone_counts").collect())) == sorted(map(tuple, windowed_zone_counts(p, z).collect()))
