"""Registered queries against DuckDB on the smallest tables, and the driver's contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
import awardgrid.plans.reports  # noqa: F401
from awardgrid.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are missing")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(queries) and set(oracles) <= set(queries)
    assert entry.entry(spark).count() > 0
