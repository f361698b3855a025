"""Every query with SQL agrees with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = [(f.__name__, sql) for m in entry.PLANS for f, sql in m.QUERIES.items() if sql]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{data}/{t}.parquet') else ''}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name,sql", CORE, ids=[n for n, _ in CORE])
def test_agrees(spark, data, duck, name, sql):
    got = entry.queries()[name](spark, data)
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
