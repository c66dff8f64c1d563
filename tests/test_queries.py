"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tidemark.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rel = duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    want = sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=repr)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["pandas_file", "pandas_roundtrip", "parse_times", "pickle_roundtrip"])
def test_rows_stay_on_executors(spark, monkeypatch, name):
    def refuse(*_, **__):
        raise AssertionError("all rows on the driver")

    monkeypatch.setattr(type(spark.range(1)), "toPandas", refuse)
    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() == 5
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
