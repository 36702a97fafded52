"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{sf}/{t}.parquet'")
    return con


def _plain(v):
    return v.item() if hasattr(v, "item") else v


def test_entry(spark):
    assert entry.entry(spark).count() == 8


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(SQL[name])
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want
