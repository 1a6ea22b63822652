"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from paperlake.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF)
    want = tables.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in got.collect())
    order = [names.index(c) for c in sorted(names)]
    assert rows == sorted(repr([plain(r[k]) for k in order]) for r in want.fetchall())


def test_reading_order_keeps_every_block(spark):
    assert QUERIES["reading_order"](spark, SF).count() == QUERIES["grid_blocks"](spark, SF).count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["path", "page", "text"]
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
