"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from zonalis.plans.catalog import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.sql(ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda it: sorted(map(repr, it))
    pick = [want.columns.index(c) for c in cols]
    assert rows(tuple(r) for r in got.select(*cols).collect()) == rows(tuple(r[i] for i in pick) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
