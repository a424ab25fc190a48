"""Every registered query beside its SQL, at the smallest scale."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from tidemark import plans

QUERIES, SQL = plans.load()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, con, data, name):
    df = QUERIES[name](spark, data)
    rel = con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(map(plain, r)) for r in df.select(*names).collect()) == Counter(tuple(map(plain, r)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_cross_join_of_tables(spark, data):
    for name in ("spatial_join_tiles", "nearest_attribute", "box_overlay", "building_count"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
