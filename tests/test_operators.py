"""Closed-form cases of the calibration operators."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.functions.columns import band_centre, lat_band, member_index, nan_to_null, weighted_mean
from zonalis.operators import costs, errors, fields, matching, metrics, scaling, search, sensitivity, splits, surrogate, zrg
from zonalis.sources import manifest


def test_month_weights(spark):
    df = spark.createDataFrame([(1, dt.datetime(2019, 1, 1), 0.0), (1, dt.datetime(2019, 2, 1), 1.0), (2, dt.datetime(2019, 1, 1), None), (2, dt.datetime(2019, 2, 1), 5.0)], "k int, ts timestamp, value double")
    got = {r["k"]: r["value"] for r in fields.month_weighted_mean(df, ["k"]).collect()}
    assert got[1] == pytest.approx(28 / 59) and got[2] == 5.0


def test_interpolation_is_exact_for_log_linear(spark):
    p = [100.0, 1e4, 5e4, 8e4, 1e5]
    df = spark.createDataFrame([("a", x, 3 + 2 * math.log(x)) for x in p], "c string, p double, value double")
    for level, want in ((2e4, 3 + 2 * math.log(2e4)), (8.5e4, 3 + 2 * math.log(8.5e4)), (50.0, None), (2e5, None)):
        got = fields.interp_plev(df, ["c"], level).first()["value"]
        assert got == (pytest.approx(want) if want else None)


def test_bands_leave_out_the_pole(spark):
    df = spark.createDataFrame([(-90.0,), (-80.0,), (89.9,), (90.0,)], "lat double").select(lat_band(F.col("lat")).alias("b"), band_centre(lat_band(F.col("lat"))).alias("c"))
    assert [tuple(r) for r in df.collect()] == [(0, -85.0), (1, -75.0), (17, 85.0), (None, None)]


def test_missing_values_leave_both_sums(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("nan"), 5.0), (3.0, 1.0)], "v double, w double").withColumn("v", nan_to_null(F.col("v")))
    assert df.agg(weighted_mean(F.col("v"), F.col("w"))).first()[0] == 2.0
    assert df.where("w > 4").agg(weighted_mean(F.col("v"), F.col("w"))).first()[0] is None


def test_zrg_blocks_and_overlapping_regions(spark):
    grid = spark.createDataFrame([(1, -85.0, 0.0, 1.0), (2, 5.0, 0.0, 3.0), (3, 90.0, 0.0, 2.0)], "ncol long, lat double, lon double, area double")
    regions = spark.createDataFrame([(1, "A"), (2, "A"), (2, "B")], "ncol long, region string")
    f = spark.createDataFrame([(1, 0, "v", 1, 1.0), (1, 0, "v", 2, 2.0), (1, 0, "v", 3, 4.0)], "member long, snapshot int, variable string, ncol long, value double")
    got = {(r["block"], r["loc"]): r["value"] for r in zrg.zrg_all(f, grid, regions).collect()}
    assert got == {("global", "global"): pytest.approx(15 / 6), ("zonal", "-85.0"): 1.0, ("zonal", "5.0"): 2.0, ("regional", "A"): pytest.approx(7 / 4), ("regional", "B"): 2.0}


def test_mask_is_all_or_nothing(spark):
    sim = spark.createDataFrame([(s, v, c, 1.0) for s in (1, 2) for v in "ab" for c in (1, 2)], "snapshot int, variable string, ncol long, value double")
    obs = spark.createDataFrame([(1, "a", 1, 1.0), (1, "b", 1, 1.0), (2, "a", 1, 1.0)], "snapshot int, variable string, ncol long, value double")
    got = {(r["snapshot"], r["variable"], r["ncol"]): r["value"] for r in fields.obs_mask(sim, obs).collect()}
    assert got[1, "a", 2] is None and got[1, "a", 1] == 1.0 and got[2, "a", 2] == 1.0


def test_member_names(spark):
    df = spark.createDataFrame([("001.x",), ("case.m042",), ("control",)], "n string").select(member_index(F.col("n")).alias("i"))
    assert [r["i"] for r in df.collect()] == [0, 42, None]


def test_errors_are_raised(spark):
    p = spark.createDataFrame([(0, -1.0), (0, 1.0)], "param int, value double")
    with pytest.raises(ValueError):
        scaling.fit_minmax(p, spark.createDataFrame([(0, True, None, None)], "param int, is_log boolean, lo double, hi double"))
    with pytest.raises(ValueError):
        scaling.log_mask_check(["zz"], ["a"])
    with pytest.raises(ValueError):
        costs.block_weights({"a": 1.0}, {"zonal": 1.0}, {"b": {}})
    with pytest.raises(ValueError):
        costs.term_student_t(0.0)
    members = spark.createDataFrame([(1,), (2,)], "member int")
    with pytest.raises(ValueError):
        manifest.params_attach(members, spark.createDataFrame([(1, 0, 1.0)], "member int, param int, value double"))


def _rows(spark, d, v):
    return spark.createDataFrame([(0, var, b, d, v, 0.0) for var in (0, 1) for b in ("zonal", "zonal", "regional", "global")], "cand_id int, variable int, block string, mean double, var double, obs double")


def test_costs_of_a_uniform_offset(spark):
    w, b = {0: 0.5, 1: 0.5}, {"zonal": 1 / 3, "regional": 1 / 3, "global": 1 / 3}
    rows = _rows(spark, 2.0, 0.7)
    value = lambda term: costs.cost(rows, term, w, b).first()["cost"]
    assert value(costs.term_absolute()) == pytest.approx(2.0)
    gauss = 0.5 * 4 / 0.7 + 0.5 * math.log(2 * math.pi * 0.7)
    assert value(costs.term_gaussian()) == pytest.approx(gauss)
    assert value(costs.term_gaussian(kappa=0.1)) == pytest.approx(gauss + 0.07)
    assert value(costs.term_student_t(1e7)) == pytest.approx(gauss, rel=1e-4)
    assert costs.cost(rows, costs.term_absolute(), w, b, override={0: b}).first()["cost"] == pytest.approx(2.0)


def test_hessian_and_pinned_parameter(spark):
    a = np.array([[3.0, 1.0], [1.0, 2.0]])
    probes = sensitivity.hessian_probes(spark, [0.5, 0.5], [0.1, 0.1], [(0.0, 1.0)] * 2)
    x = [F.get("x", F.lit(k)) for k in range(2)]
    h = sensitivity.hessian(probes.withColumn("cost", sum(x[i] * x[j] * float(a[i, j]) for i in range(2) for j in range(2))))
    got = {(r["i"], r["j"]): r["h"] for r in h.collect()}
    assert got[0, 0] == pytest.approx(6) and got[0, 1] == pytest.approx(2) and got[1, 1] == pytest.approx(4)
    u = {r["param"]: r for r in sensitivity.param_uncertainty(spark, h, [0.5, 0.0], [(0.0, 1.0)] * 2).collect()}
    assert u[1]["at_bound"] and u[1]["stderr"] is None and u[0]["stderr"] == pytest.approx(math.sqrt(1 / 6))


def test_search_finds_a_quadratic_and_is_independent_of_others(spark):
    def score(c):
        return c.select("cand_id", F.aggregate("x", F.lit(0.0), lambda s, v: s + (v - 0.3) * (v - 0.3)).alias("cost"))

    starts = search.starts_uniform(spark, 3, [(0.0, 1.0)] * 2, 1).select("start_idx", "x")
    both = {r["start_idx"]: tuple(r["x"]) for r in search.search_multistart(starts, score, [(0.0, 1.0)] * 2, rounds=25, tol=1e-3).collect()}
    assert all(abs(v - 0.3) < 0.01 for x in both.values() for v in x)
    alone = search.search_multistart(starts.where("start_idx = 1"), score, [(0.0, 1.0)] * 2, rounds=25, tol=1e-3).first()
    assert tuple(alone["x"]) == both[1]


def test_p_values_and_critical_correlation(spark):
    assert metrics.t_two_sided(0.0, 10) == pytest.approx(1.0)
    r = metrics.r_critical(spark, [12]).first()["r"]
    t = r * math.sqrt(10 / (1 - r * r))
    assert t == pytest.approx(2.2281, abs=1e-3)


def test_surrogate_recovers_a_smooth_function(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(60, 2))
    f = np.sin(3 * x[:, 0]) + x[:, 1]
    rows = [(0, 0, 0, i, x[i].tolist(), float(f[i])) for i in range(40)] + [(0, 0, 1, i, x[i].tolist(), float(1.5 * f[i] + 0.2)) for i in range(12)]
    t = spark.createDataFrame(rows, "variable int, feat_idx int, level int, member long, x array<double>, y double")
    cand = spark.createDataFrame([(i, x[i].tolist()) for i in range(40, 60)], "cand_id long, x array<double>")
    one = {r["cand_id"]: r["mean"] for r in surrogate.predict_batch(surrogate.fit_models(t.where("level = 0"), steps=30), cand).collect()}
    assert np.abs(np.array([one[i] for i in range(40, 60)]) - f[40:]).max() < 0.1
    two = {r["cand_id"]: r["mean"] for r in surrogate.predict_batch(surrogate.fit_models(t, steps=30), cand).collect()}
    assert np.abs(np.array([two[i] for i in range(40, 60)]) - (1.5 * f[40:] + 0.2)).max() < 0.3


def test_gradient_of_the_chain():
    rng = np.random.default_rng(1)
    x = [rng.uniform(size=(8, 2)), rng.uniform(size=(5, 2))]
    m = surrogate.Chain(x, [rng.normal(size=8), rng.normal(size=5)])
    v = m._vector()
    m._set(v)
    m._solve()
    g = m._gradient()
    for i in range(len(v)):
        e = np.zeros(len(v))
        e[i] = 1e-5
        m._set(v + e)
        hi = m._solve()
        m._set(v - e)
        assert (hi - m._solve()) / 2e-5 == pytest.approx(g[i], rel=1e-3, abs=1e-4)


def test_sigma_estimators(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0, math.sqrt(0.7), 4000)
    df = spark.createDataFrame([(0, float(v), 0.2, 0.0, 1.0) for v in r], "k int, r double, gp_var double, obs_var double, w double")
    assert errors.sigma_moment(df, ["k"]).first()["s2"] == pytest.approx(0.5, rel=0.08)
    assert errors.sigma_mle(df, ["k"], points=60).first()["s2"] == pytest.approx(0.5, rel=0.08)


def test_twins_across_cell_edges(spark):
    a = spark.createDataFrame([(1, [1e-8, 0.5]), (2, [0.3, 0.3])], "member long, x array<double>")
    b = spark.createDataFrame([(9, [1e-8 - 5e-10, 0.5 + 5e-10]), (8, [0.3, 0.31])], "member long, x array<double>")
    assert [tuple(r) for r in matching.twin_match(a, b).collect()] == [(1, 9)]
    assert [r["member"] for r in matching.drop_twins(a, b).collect()] == [2]


def test_fold_sizes_do_not_depend_on_partitions(spark):
    m = spark.range(7).withColumnRenamed("id", "member")
    one = {r["member"]: r["fold"] for r in splits.kfold_assign(m.repartition(1), 3, 2).collect()}
    many = {r["member"]: r["fold"] for r in splits.kfold_assign(m.repartition(5), 3, 2).collect()}
    assert one == many and sorted(list(one.values()).count(k) for k in range(3)) == [2, 2, 3]


def test_starts_feasible_draws_until_each_start_has_a_point(spark):
    ids = spark.range(300).select(F.col("id").alias("start_idx"))
    got = search.starts_feasible(ids, [(0.0, 10.0), (0.0, 1.0)], (0, 1), 7).collect()  # one draw in 20 keeps the order
    assert sorted(r["start_idx"] for r in got) == list(range(300)) and max(r["draw"] for r in got) >= 16
    assert all(r["x"][0] <= r["x"][1] for r in got)
    with pytest.raises(ValueError):
        search.starts_feasible(ids, [(2.0, 3.0), (0.0, 1.0)], (0, 1), 7)


def test_extra_variance_in_the_units_of_its_specs(spark):
    scaler = spark.createDataFrame([("P", 0, "zonal", 3.0), ("P", 1, "regional", 5.0), ("P", 2, "global", 8.0), ("Q", 0, "zonal", 2.0)], "variable string, feat_idx int, block string, scale double")
    got = costs.extra_variance(scaler, {"P": {"zonal": 0.6, "global_phys": 4.0}}, {"P": {"zonal": 1.5, "regional": 10.0}, "Q": {"zonal_phys": 1.0}})
    want = {("P", 0): 0.36 + 0.25, ("P", 1): 4.0, ("P", 2): 0.25, ("Q", 0): 0.25}
    assert {(r[0], r[1]): pytest.approx(r[2]) for r in got.collect()} == want
    with pytest.raises(ValueError):
        costs.extra_variance(scaler, None, {"P": {"zonal": 1.0, "zonal_phys": 1.0}})


def test_residual_step_weighs_locations(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.0, 0.5, 0.5, 3.0), ("a", 3.0, 0.0, 1.5, 0.5, 1.0)], "b string, obs double, mean double, var double, extra double, w double")
    r = errors.residual_step(rows, ["b"]).first()
    assert (r["rms_residual"], r["rms_sd"], r["chi2"]) == (pytest.approx(3**0.5), pytest.approx(0.75**0.5), pytest.approx((3 * 1.0 + 4.5) / 4))
    r = errors.residual_step(rows.drop("w"), ["b"]).first()
    assert r["rms_residual"] == pytest.approx(5**0.5)


def test_params_attach_refuses_missing_values(spark):
    params = spark.createDataFrame([(1, "p", 1.0), (1, "q", 2.0), (2, "p", 1.0), (2, "q", None)], "member long, param string, value double")
    members = spark.createDataFrame([(1,), (2,)], "member long")
    assert manifest.params_attach(members.where("member = 1"), params).count() == 2
    with pytest.raises(ValueError):
        manifest.params_attach(members, params)


def test_member_names_of_any_length(spark):
    names = ["001.x", "1000.x", "7.y", "12", "m042", "a.b.m1042", "control", "x.mm3"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(member_index(F.col("n"))).collect()
    assert [r[0] for r in got] == [0, 999, 6, 11, 42, 1042, None, None]
