"""Zones, transitions, stays, modes and clusters on small hand-made inputs."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrain.functions import geo, temporal
from tracegrain.operators import clustering, features, modes, stats, stays, transitions, zones
from tracegrain.operators.order import numbered

DAY, START = dt.date(2023, 3, 27), dt.datetime(2023, 3, 27, 8)


def trip(spark, rows, device=1):
    """rows: (seconds from 8:00, zone)."""
    data = [(i, DAY, device, START + dt.timedelta(seconds=s), 46.0, 14.0, z) for i, (s, z) in enumerate(rows)]
    df = spark.createDataFrame(data, "ping_id long, day date, deviceid long, datetime timestamp_ntz, lat double, lon double, zone_id int")
    return zones.add_time_bin(df)


L_SHAPE = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4), (0, 0)]


@pytest.mark.parametrize("x, y, inside", [(1, 1, True), (3, 1, True), (1, 3, True), (3, 3, False), (5, 1, False), (0, 1, False), (4, 1, False), (2, 3, False), (0, 0, False), (2, 2, False), (1, 4, False)])
def test_point_within_excludes_edges(spark, x, y, inside):
    ring = F.array(*[F.struct(F.lit(float(a)).alias("lon"), F.lit(float(b)).alias("lat")) for a, b in L_SHAPE])
    row = spark.range(1).select(geo.point_within(F.lit(float(x)), F.lit(float(y)), ring).alias("i")).first()
    assert row.i is inside


def test_overlapping_zones_give_the_first(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    z = spark.createDataFrame([(2, square(0.0, 2.0)), (1, square(1.0, 3.0))], "zone_id int, ring array<struct<lon double, lat double>>")
    p = spark.createDataFrame([(0, 1.5, 1.5), (1, 0.5, 0.5), (2, 9.0, 9.0)], "ping_id long, lat double, lon double")
    got = {r.ping_id: r.zone_id for r in zones.assign_zones(p, z, cell_deg=0.5).collect()}
    assert got == {0: 1, 1: 2, 2: None}
    assert zones.assign_zones(p, z, keep_unmatched=False).count() == 2


def test_vincenty_and_haversine_agree(spark):
    df = spark.createDataFrame([(46.0, 14.0, 46.5, 14.5), (46.0, 14.0, 46.0, 14.0), (None, 14.0, 46.0, 14.0)], "a double, b double, c double, d double")
    cols = [F.col(x) for x in "abcd"]
    rows = df.select(geo.geodesic_m(*cols).alias("g"), geo.haversine_m(*cols).alias("h")).collect()
    assert rows[0].g == pytest.approx(rows[0].h, rel=0.005) and rows[1].g == 0 and rows[2].g is None


def test_dates_are_day_first_and_junk_is_null(spark):
    df = spark.createDataFrame([("01.04.2023", "10:00:00"), ("junk", "x")], "date string, time string")
    got = df.select(temporal.try_parse_datetime(F.col("date"), F.col("time")).alias("t")).collect()
    assert [r.t for r in got] == [dt.datetime(2023, 4, 1, 10), None]


def test_dwell_ties(spark):
    p = trip(spark, [(0, 7), (60, 3), (120, 7), (120, 3), (3600, 5), (3660, 5)])
    assert transitions.dominant_zone(p).where("time_bin = 8").first().zone_id == 3
    assert [(r.from_zone, r.to_zone) for r in transitions.dwell_transitions(p).collect()] == [(3, 5)]
    rowwise = transitions.dwell_rowwise(trip(spark, [(0, 7), (60, 3), (120, 7), (3600, 5), (3660, 5)]))
    assert [(r.from_zone, r.to_zone) for r in rowwise.collect()] == [(7, 5)]


def test_bins_that_are_not_consecutive_make_no_transition(spark):
    assert transitions.dwell_transitions(trip(spark, [(0, 1), (60, 1), (7200, 2), (7260, 2)])).count() == 0


def test_entries_exits_and_transition_entropy(spark):
    p = features.per_ping(trip(spark, [(0, 1), (60, 1), (120, 2), (180, 1)]))
    ins = {r.zone_id: r.in_count for r in features.entries(p).collect()}
    outs = {r.zone_id: r.out_count for r in features.exits(p).collect()}
    assert ins == {1: 1, 2: 1} and outs == {1: 2, 2: 1}
    assert {r.zone_id: r.trans_entropy for r in features.transition_entropy(p).collect()} == {1: 0.0, 2: 0.0}


def test_single_pings_have_zero_speeds_after_assembly(spark):
    p = trip(spark, [(0, 1)]).union(trip(spark, [(30, 1)], device=2))
    row = features.assemble(features.per_ping(p)).first()
    assert (row.ping_count, row.unique_devs, row.speed_mean, row.speed_var) == (2, 2, 0.0, 0.0) and len(row) == 27
    assert row.dev_entropy == pytest.approx(1.0)


def test_stay_scan(spark):
    far = 0.01
    rows = [(0, 46.0), (600, 46.0), (1500, 46.0 + far), (1600, 46.0 + 2 * far), (9000, 46.0 + 2 * far)]
    df = spark.createDataFrame([(i, DAY, 1, START + dt.timedelta(seconds=s), la, 14.0) for i, (s, la) in enumerate(rows)], "ping_id long, day date, deviceid long, datetime timestamp_ntz, lat double, lon double")
    got = stays.stay_points(df).collect()
    assert [(r.arrival, r.leave, r.duration_min, r.stay_lat) for r in got] == [(START, START + dt.timedelta(seconds=1500), 25.0, 46.0)]


def test_viterbi():
    seen = np.array([0, 0, 2, 0, 0])
    assert modes.viterbi(seen, 4, 0.9, 0.0).tolist() == seen.tolist()
    assert modes.viterbi(seen, 4, 0.9, 0.1).tolist() == [0, 0, 0, 0, 0]


def test_mode_shares_name_modes_that_do_not_occur(spark):
    df = spark.createDataFrame([("Car",), ("Car",), ("Walk",), ("Car",)], "mode_kmeans string")
    assert {r.mode: r.share_pct for r in modes.mode_shares(df).collect()} == {"Walk": 25.0, "Bike": 0.0, "Car": 75.0, "Others": 0.0}


def test_kmeans_modes_follow_speed(spark):
    df = spark.createDataFrame([(i, float(v), 10.0) for i, v in enumerate([1, 1.1, 5, 5.2, 20, 21, 90, 95])], "id int, speed_mean double, dwell_mean double")
    got = {r.id: r.mode_kmeans for r in modes.kmeans_modes(df, seeds=4).collect()}
    assert [got[i] for i in (0, 2, 4, 6)] == list(modes.MODES)


def test_dbscan_against_all_pairs():
    rng = np.random.default_rng(0)
    lat, lon = 46 + rng.normal(0, 0.05, 120), 14 + rng.normal(0, 0.05, 120)
    eps = 0.0003
    near = clustering._haversine_rad(*[np.radians(x) for x in (lat[:, None], lon[:, None], lat[None], lon[None])]) <= eps
    want = clustering._labels(120, lambda i: np.flatnonzero(near[i]), 5)
    assert clustering.haversine_labels(lat, lon, eps, 5).tolist() == want.tolist()


def test_dbscan_of_dense_places_compares_few(monkeypatch):
    rng = np.random.default_rng(3)
    exact, seen = clustering._haversine_rad, []

    def counted(*a):
        seen.append(np.broadcast(*a).size)
        return exact(*a)

    monkeypatch.setattr(clustering, "_haversine_rad", counted)
    lat, lon = 46 + rng.random(6000) * 0.02, 14 + rng.random(6000) * 0.03
    assert set(clustering.haversine_labels(lat, lon, 0.0009, 5)) == {0}
    apart = np.concatenate([lat, lat + 0.02 + np.degrees(0.0001001)])  # two blocks, just too far from each other
    assert np.bincount(clustering.haversine_labels(apart, np.tile(lon, 2), 0.0001, 5)).tolist() == [6000, 6000]
    assert sum(seen) < 200 * len(lat)  # its square is 36 000 000


def test_dbscan_over_date_line_pole_and_copies():
    rng = np.random.default_rng(4)
    for k, (y, x) in enumerate([(0, 180), (89.99, 0), (-89.99, 90), (46, 14)] * 6):
        lat, lon = np.minimum(y + rng.normal(0, 0.05, 200), 90), (x + rng.normal(0, 0.05, 200) + 180) % 360 - 180
        if k % 2:
            lat, lon = lat.round(2), lon.round(2)
        lat[7] = np.nan
        near = clustering._haversine_rad(*[np.radians(v) for v in (lat[:, None], lon[:, None], lat[None], lon[None])]) <= 0.0003
        want = clustering._labels(200, lambda i: np.flatnonzero(near[i]), 5)  # noqa: B023
        assert clustering.haversine_labels(lat, lon, 0.0003, 5).tolist() == want.tolist()


def test_dbscan_of_a_table_with_copies_and_nulls(spark):
    rows = [(i, 1, 46.0, 14.0) for i in range(5, 9)] + [(4, 1, 46.01, 14.0), (3, 1, 50.0, 14.0), (2, 1, None, 14.0), (1, 1, float("nan"), 14.0), (9, None, 46.0, 14.0)]
    rows += [(i, None, 0.0, 0.0) for i in range(10, 13)] + [(i, None, -0.0, 0.0) for i in range(13, 15)]
    got = clustering.dbscan(spark.createDataFrame(rows, "ping_id long, zone_id int, lat double, lon double"), keys=("zone_id",))
    assert got.columns == ["ping_id", "zone_id", "lat", "lon", "cluster"]
    assert {r.ping_id: r.cluster for r in got.collect()} == {1: -1, 2: -1, 3: -1, 9: -1} | {i: 0 for i in (*range(4, 9), *range(10, 15))}
    assert got.where("zone_id IS NULL").count() == 6


def test_spectral_finds_planted_blocks():
    rng = np.random.default_rng(1)
    block = np.repeat([0, 1, 2], 12)
    a = np.where(block[:, None] == block[None], 3.0, 0.05) + rng.random((36, 36)) * 0.1
    label = clustering.spectral_labels(a + a.T, 3)
    assert all(len(set(label[block == b])) == 1 for b in range(3)) and len(set(label)) == 3


def test_mixture_finds_two_components(spark):
    rng = np.random.default_rng(2)
    rows = [(1, float(x), float(y)) for x, y in np.concatenate([rng.normal(0, 0.1, (60, 2)), rng.normal(5, 0.1, (40, 2))])]
    got = clustering.gmm_by_zone(spark.createDataFrame(rows, "zone_id int, lat double, lon double")).orderBy("component").collect()
    assert [round(r.mean_lat) for r in got] == [0, 5] and got[0].weight == pytest.approx(0.6, abs=0.02)


def test_nearest_towers_far_and_tied(spark):
    rng = random.Random(2)
    towers = [(i, 46 + rng.randrange(6) / 50, 14 + rng.randrange(6) / 50) for i in range(60)]
    points = [(i, 46 + rng.random() / 5, 14 + rng.random() / 5) for i in range(80)] + [(90, -89.0, 179.9), (91, 89.0, -179.9), (92, 46.0, 14.0)]
    got = zones.knn_towers(spark.createDataFrame(points, "ping_id long, lat double, lon double"), spark.createDataFrame(towers, "tower_id long, lat double, lon double"))
    assert got.count() == len(points)
    for r in got.collect():
        y, x = next((y, x) for i, y, x in points if i == r.ping_id)
        want = sorted((math.sqrt((y - b) ** 2 + (x - c) ** 2), a) for a, b, c in towers)[:3]
        assert [r.tower1, r.tower2, r.tower3] == [a for _, a in want] and abs(r.d3 - want[2][0]) < 1e-9
    few = zones.knn_towers(spark.createDataFrame(points, "ping_id long, lat double, lon double"), spark.createDataFrame(towers[:2], "tower_id long, lat double, lon double")).collect()
    assert len(few) == len(points) and all(r.d2 is not None and r.d3 is None for r in few)


def test_numbers_and_greedy_parts(spark):
    values = [5, 1, 900, 901, 902, -7, 3, 1_000_000_000_000]
    got = numbered(spark.createDataFrame([(v,) for v in values], "v long"), "v", "r", rows=2).collect()
    assert {x.v: x.r for x in got} == {v: i for i, v in enumerate(sorted(values))}
    assert numbered(spark.createDataFrame([], "v long"), "v", "r").count() == 0
    pings = spark.createDataFrame([(i,) for i, n in enumerate([5, 3, 4, 1, 1, 2]) for _ in range(n)] + [(None,)], "deviceid long")
    assert sorted(map(tuple, stats.greedy_split(pings, 3).collect())) == [(0, 5, 0), (1, 3, 1), (2, 4, 2), (3, 1, 1), (4, 1, 1), (5, 2, 2)]
    with pytest.raises(ValueError, match="devices"):
        stats.greedy_split(pings, 3, most_devices=5)
