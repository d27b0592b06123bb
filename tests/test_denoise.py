"""Hand-made traces with results worked out by hand."""

import datetime as dt
import re

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracegrain.operators import denoise

START = dt.datetime(2023, 3, 27, 8)
M = 1 / 111_194.93  # degrees of latitude for a metre


def frame(spark, rows, device=1):
    """rows: (seconds, lat, lon)."""
    data = [(i, dt.date(2023, 3, 27), device, START + dt.timedelta(seconds=s), float(la), float(lo)) for i, (s, la, lo) in enumerate(rows)]
    return spark.createDataFrame(data, "ping_id long, day date, deviceid long, datetime timestamp_ntz, lat double, lon double")


def ids(df):
    return sorted(r.ping_id for r in df.collect())


def test_zheng_keeps_turns_and_drops_straight_points(spark):
    rows = [(0, 46, 14), (5, 46 + 20 * M, 14), (10, 46 + 40 * M, 14), (15, 46 + 20 * M, 14), (20, 46, 14), (25, 46 - 20 * M, 14)]
    assert ids(denoise.zheng(frame(spark, rows))) == [2]


def test_zheng_keeps_points_after_a_gap(spark):
    assert ids(denoise.zheng(frame(spark, [(i * 11, 46 + i * 20 * M, 14) for i in range(5)]))) == [1, 2, 3]


def test_zheng_drops_a_jump_and_its_successor(spark):
    rows = [(0, 46, 14), (20, 46, 14), (30, 46 + 1000 * M, 14), (40, 46, 14), (60, 46, 14), (80, 46, 14)]
    assert ids(denoise.zheng(frame(spark, rows))) == [1, 4]


def test_same_second_counts_as_one_second(spark):
    got = denoise.sequential_deltas(frame(spark, [(0, 46, 14), (0, 46 + 10 * M, 14)])).orderBy("ping_id").collect()
    assert [r.dt for r in got] == [0, 1] and got[1].speed_m_s == pytest.approx(10, abs=0.01)
    assert got[0].dist_m == 0 and got[0].device_change


@pytest.mark.parametrize("metres, kept", [(9.9, False), (10.1, True)])
@pytest.mark.parametrize("axis", [0, 1])
def test_tower_metric_does_not_shrink_longitudes(spark, metres, kept, axis):
    at = [46.0, 14.0]
    at[axis] += metres * M
    towers = spark.createDataFrame([(1, 46.0, 14.0)], "tower_id int, lat double, lon double")
    assert bool(ids(denoise.near_towers(frame(spark, [(0, *at)]), towers))) == kept


def test_repeats_from_the_threshold_on_go(spark):
    rows = [(i, 46, 14) for i in range(3)] + [(10 + i, 46, 15) for i in range(4)]
    assert ids(denoise.repeated_coordinates(frame(spark, rows), 4)) == [0, 1, 2]
    assert ids(denoise.squash_coordinates(frame(spark, rows))) == [0, 3]


def test_min_points_means_four(spark):
    three, four = frame(spark, [(i, 46, 14) for i in range(3)]), frame(spark, [(i, 46, 14) for i in range(4)], device=2)
    assert {r.deviceid for r in denoise.min_points(three.union(four)).collect()} == {2}


@pytest.mark.parametrize("last, left", [(299, [0, 1, 2]), (300, [0])])
def test_long_stops(spark, last, left):
    df = denoise.sequential_deltas(frame(spark, [(0, 46, 14), (100, 46, 14), (last, 46, 14)]))
    assert ids(denoise.long_stops(df)) == left
    assert ids(denoise.long_stops(df, squash=True)) == [0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 100), min_size=1, max_size=12))
def test_sliding_median_equals_pandas(spark, speeds):
    df = frame(spark, [(i, 46, 14) for i in range(len(speeds))]).join(
        spark.createDataFrame(list(enumerate(speeds)), "ping_id long, speed_m_s double"), "ping_id"
    )
    s = pd.Series(speeds)
    want = [i for i, ok in enumerate(s <= s.rolling(5, center=True, min_periods=1).median() + 5) if ok]
    assert ids(denoise.sliding_median(df)) == want


def test_sliding_spike(spark):
    speeds = [1.0, 5.0, 2.0, 9.0, 3.0, 100.0, 4.0]
    df = frame(spark, [(i, 46, 14) for i in range(7)]).join(spark.createDataFrame(list(enumerate(speeds)), "ping_id long, speed_m_s double"), "ping_id")
    assert ids(denoise.sliding_median(df)) == [0, 1, 2, 3, 4, 6]


def test_pipeline_only_removes_and_shuffles_by_device_once(spark):
    rows = frame(spark, [(i * 15, 46 + (i % 3) * 30 * M, 14) for i in range(20)])
    towers = spark.createDataFrame([(1, 10.0, 10.0)], "tower_id int, lat double, lon double")
    out = denoise.denoise(rows, towers)
    assert set(ids(out)) <= set(ids(rows))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # One exchange on the device serves deltas, speed and angle, sliding median and count.
    assert len(re.findall(r"hashpartitioning\(day#\d+L?, deviceid#\d+L?", plan)) == 1
    assert denoise.report(denoise.stages(rows, towers)).where(F.col("dropped") < 0).count() == 0
