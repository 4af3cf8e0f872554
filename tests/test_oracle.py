"""Every query with a DuckDB equivalent, on the smallest tables."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    mine = entry.queries()[name](spark, sf_dir)
    theirs = duck.sql(entry.oracle_sql()[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in mine.columns]
    assert sorted([tuple(map(plain, r)) for r in mine.collect()], key=repr) == sorted([tuple(plain(r[i]) for i in at) for r in theirs.fetchall()], key=repr)


def test_entry_and_other_queries(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    for name in ("chunk_explode", "chunk_stats"):
        assert entry.queries()[name](spark, sf_dir).count() > 0
