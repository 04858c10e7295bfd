"""Every query with SQL gives the rows that DuckDB gives for it; the others run and have a stable schema."""

import math
import os

import duckdb
import pytest

from sparkloom.operators import ORACLES, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "tzinfo") and value is not None and getattr(value, "tzinfo", None):
        return value.replace(tzinfo=None)
    return value


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    own = table_of(df.columns, df.collect())
    got = duck.execute(ORACLES[name])
    other = table_of([d[0] for d in got.description], got.fetchall())
    assert own[0] == other[0]
    assert len(own[1]) == len(other[1])
    assert own[1] == other[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns == QUERIES[name](spark, sf_dir).columns and df.count() > 0
