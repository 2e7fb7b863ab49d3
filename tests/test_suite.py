"""Every registered relational query against DuckDB on the same files."""

import math
from collections import Counter

import duckdb
import pytest

from millrace.plans.suite import ORACLE_SQL, QUERIES
from millrace.sources.tables import NAMES


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_duckdb(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect())
    assert got == Counter(tuple(plain(v) for v in r) for r in cur.fetchall())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["filter_between"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_size), GreaterThanOrEqual(p_size,5), LessThanOrEqual(p_size,15)]" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan
