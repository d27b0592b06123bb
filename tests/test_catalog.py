"""Every catalogue query against its DuckDB oracle on the smallest tables, values and all."""

import math
import os

import duckdb
import pytest

from tracegrain.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7) + 0.0
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.execute(ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"modes_kmeans"}))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
