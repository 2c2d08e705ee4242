"""Every query with SQL against DuckDB, over the smallest tables."""

import re

import duckdb
import pytest

from siftwell.plans import golden  # noqa: F401  (registers its queries)
from siftwell.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in order]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_no_driver_tables_are_cut():
    for sql in SQL.values():
        assert not re.search(r"doc_id\s*<\s*\d|USING SAMPLE", sql)


def test_results_are_the_same_again(spark):
    a, b = (QUERIES["rrf_fusion"](spark, SF).collect() for _ in range(2))
    assert a == b
