"""Queries on tables larger than the smallest ones, or of other shapes."""

from __future__ import annotations

import os
import tracemalloc

import duckdb
import numpy as np
import pytest

from zonalis.operators import surrogate
from zonalis.operators.neighbours import nearest_neighbor
from zonalis.plans.catalog import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
@pytest.mark.parametrize("name", ["member_index", "name_match"])
def test_names_of_runs_beyond_their_digits(spark, tmp_path, name):
    """Runs 1000 and 10000 share a name that is cut to three or four digits, not a number."""
    duck = duckdb.connect()
    for table, key in (("lineitem", "l_suppkey"), ("embeddings", "vec_id")):
        rows = f"select * from '{FOLDER}/{table}.parquet'"
        shifted = " union all ".join(f"select * replace ({key} + {by} as {key}) from ({rows})" for by in (0, 996, 9996, 120000))
        duck.execute(f"create view {table} as {shifted}")
        duck.execute(f"copy {table} to '{tmp_path}/{table}.parquet' (format parquet)")
    got = QUERIES[name](spark, str(tmp_path))
    want = duck.sql(ORACLE[name])
    rows = lambda it: sorted(map(repr, it))
    assert rows(map(tuple, got.select(*want.columns).collect())) == rows(want.fetchall())


def test_nearest_neighbor_moves_points_in_packs(spark):
    """Points in 19 free dimensions reach nearly all rings; each was written once for every ring of 32 points."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 19))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").checkpoint()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = {r["id"]: (r["nearest"], r["dist"]) for r in nearest_neighbor(df, df, exclude_self=True).collect()}
    assert written() - before < 20 * x.nbytes
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)) + np.diag([np.inf] * len(x))
    assert all(got[i] == (int(d[i].argmin()), pytest.approx(d[i].min(), abs=1e-12)) for i in range(len(x)))


def test_fit_of_a_process_holds_one_square_matrix():
    """Some eight of them took more memory than an executor has."""
    rng, n = np.random.default_rng(0), 3000
    x = rng.standard_normal((n, 4))
    m = surrogate.Chain([x], [np.sin(x).sum(1) + rng.normal(0, 0.1, n)])
    tracemalloc.start()
    m.fit(1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 8 * n * n
    k = m._cov(x, m.level, x, m.level) + np.eye(n) * np.exp(m.noise[0])
    assert np.allclose(m.alpha, np.linalg.solve(k, m.y), atol=1e-6)
