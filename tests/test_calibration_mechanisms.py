"""Pivots, normal equations, profiles, interval searches, ranks, resumable loops and stored partitions against brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonalis.functions.algebra import identity, solved
from zonalis.operators import compare, errors, neighbours, regression, sensitivity
from zonalis.sources import manifest

XS = "id long, x array<double>"


def points(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x] if x is not None else None) for i, x in rows], XS)


def brute_nearest(rows, train, exclude_self):
    out = {}
    for i, x in rows:
        best = None
        if x is not None and all(v is not None for v in x):
            ds = sorted((math.dist(x, t), j) for j, t in train if t is not None and not (exclude_self and j == i))
            best = ds[0] if ds else None
        out[i] = best
    return out


def check_nearest(spark, rows, train, exclude_self, **more):
    got = neighbours.nearest_neighbor(points(spark, rows), points(spark, train), exclude_self, **more).collect()
    want = brute_nearest(rows, train, exclude_self)
    assert len(got) == len(rows)
    for r in got:
        w = want[r["id"]]
        assert (r["nearest"], r["dist"]) == ((w[1], pytest.approx(w[0], abs=1e-12)) if w else (None, None)), r
    return sum(r["examined"] for r in got)


def test_nearest_by_pivots_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    grid = [(k, [a, b]) for k, (a, b) in enumerate(itertools.product((0.0, 0.5, 1.0), repeat=2))]
    check_nearest(spark, [*grid, (20, [5.0, 5.0]), (21, [0.25, 0.5]), (22, None)], grid, False)  # ties go to the smallest id
    check_nearest(spark, grid, grid, True)
    cloud = [(k, rng.standard_normal(5)) for k in range(80)] + [(100 + k, [1.0, 1, 1, 1, 1]) for k in range(5)]
    check_nearest(spark, cloud, cloud, True, pivots=6, ring_size=4)
    check_nearest(spark, cloud, cloud[:1], False)
    check_nearest(spark, cloud[:3], cloud[:1], True)  # the only training point is one of them
    check_nearest(spark, cloud[:3], [], False)
    line = [(k, [k * 1e-3] * 4) for k in range(50)]  # all pivots on one line
    check_nearest(spark, [*line, (99, [3.0, -1, 2, 0])], line, True, pivots=10)


def test_nearest_looks_at_few_points_of_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.uniform(0, 100, (40, 6))
    rows = [(k, centres[k % 40] + rng.normal(0, 0.1, 6)) for k in range(1200)]
    examined = check_nearest(spark, rows, rows[:600], True)
    assert examined < 0.12 * len(rows) * 600


@pytest.mark.parametrize("p", [1, 3, 8])
def test_solved_equals_numpy(spark, p):
    rng = np.random.default_rng(p)
    ms = [rng.standard_normal((p, p)) for _ in range(5)] + [np.zeros((p, p))]
    ms.append(np.fliplr(np.eye(p)))  # nothing on the diagonal: rows must change places
    got = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(ms)], "i int, m array<array<double>>").select("i", solved(F.col("m"), identity(p), p).alias("r")).collect()
    for r in got:
        if r["i"] == 5:
            assert r["r"] is None
        else:
            assert np.allclose(r["r"], np.linalg.inv(ms[r["i"]]), atol=1e-8)


def regression_rows(n=90, p=3, holes=True):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (n, p))
    y = {(0, 0): 1 + x @ [1, 2, 3], (0, 1): x[:, 0] * x[:, 1] + x[:, 2] ** 2, (1, 0): np.cos(x).sum(1) + 240}
    rows = [(v, f, m, x[m].tolist(), float(y[v, f][m]) if not (holes and m % 7 == 3 and v == 0) else None) for (v, f) in y for m in range(n)]
    rows = [r for r in rows if not (holes and r[:2] == (1, 0) and r[2] == 5)]  # a row that is not there at all
    return x, y, rows


def frame(spark, rows):
    return spark.createDataFrame([(*r[:3], r[3], r[4]) for r in rows], "variable int, feat_idx int, member long, x array<double>, y double")


def design(x, degree):
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([np.ones((len(x), 1)), x, *([x[:, i] * x[:, j]] if degree == 2 else [])])


@pytest.mark.parametrize("degree", [1, 2])
def test_fold_models_equal_numpy_with_missing_outputs(spark, degree):
    x, y, rows = regression_rows()
    folds = {m: m % 5 for m in range(80)}  # ten members are in no fold: always training
    df = frame(spark, [*rows, (0, 0, 999, None, 1.0)])
    f = spark.createDataFrame(list(folds.items()), "member long, fold int")
    got = regression.fold_models(df, f, degree, ridge=1e-12).collect()
    assert len(got) == 15
    have = {(r[0], r[1]): {q[2]: q[4] for q in rows if q[:2] == r[:2] and q[4] is not None} for r in rows}
    for r in got:
        use = {m: v for m, v in have[r["variable"], r["feat_idx"]].items() if folds.get(m) != r["k"]}
        want = np.linalg.lstsq(design(x[list(use)], degree), np.array(list(use.values())), rcond=None)[0]
        assert r["n"] == len(use) and np.allclose(r["coef"], want, atol=1e-6)
        assert r["mean"] == pytest.approx(np.mean(list(use.values()))) and r["scale"] == pytest.approx(np.std(list(use.values())), rel=1e-6)
    pairs = regression.kfold_eval(df.where("x is not null"), f, 5, degree)
    assert pairs.count() == sum(m in folds for r in rows for m in [r[2]])
    s = {r["variable"]: r for r in regression.skill_both_units(pairs, ["variable"]).collect()}
    assert s[0]["r2_phys"] > 0.2 and (degree == 1 or s[0]["r2_phys"] > 0.999999)


def test_fit_poly_merges_many_partitions_and_takes_empty_tables(spark):
    x, y, rows = regression_rows(holes=False)
    one = {(r["variable"], r["feat_idx"]): r["coef"] for r in regression.fit_poly(frame(spark, rows).repartition(1), 2, 1e-12).collect()}
    many = {(r["variable"], r["feat_idx"]): r["coef"] for r in regression.fit_poly(frame(spark, rows).repartition(13), 2, 1e-12).collect()}
    assert one.keys() == many.keys() == y.keys()
    assert all(np.allclose(one[k], many[k], atol=1e-8) for k in one)
    assert np.allclose(one[0, 1][4:], [0, 1, 0, 0, 0, 1], atol=1e-8)  # x0 x1 and x2 squared
    assert regression.fit_poly(frame(spark, []), 2).count() == 0


def test_partial_dependence_equals_averages(spark):
    x, y, rows = regression_rows(holes=False)
    models = regression.fit_poly(frame(spark, rows), 2)
    grid = spark.createDataFrame([(k, v) for k in range(3) for v in (-0.5, 0.25)], "param int, value double")
    sample = points(spark, [*enumerate(x.tolist()), (999, None)])
    coef = {(r["variable"], r["feat_idx"]): np.array(r["coef"]) for r in models.collect()}
    got = regression.partial_dependence(models, sample, 3, grid).collect()
    assert len(got) == 3 * 3 * 4
    for r in got:
        at = x.copy()
        at[:, r["a"]], at[:, r["b"]] = r["va"], r["vb"]
        assert r["value"] == pytest.approx((design(at, 2) @ coef[r["variable"], r["feat_idx"]]).mean(), abs=1e-9)


def test_sobol_sees_interactions(spark):
    box = spark.createDataFrame([(k, -1.0, 1.0) for k in range(4)], "param int, lo double, hi double")
    base = sensitivity.saltelli_base(spark, 4000, box, 4, {3: 0.5})
    coef = [0.0] * 15
    coef[1], coef[6], coef[9] = 1.0, 2.0, 0.0  # x0, and x0 x1: terms are 1, x0..x3, x0x0, x0x1, ...
    models = spark.createDataFrame([(0, 0, coef)], "variable int, feat_idx int, coef array<double>")
    scored = regression.saltelli_scores(base, models, 2)
    got = {r["param"]: r for r in sensitivity.sobol_indices(scored, ["variable", "feat_idx"]).collect()}
    # Var = 1/3 + 4/9; x0 alone 1/3, x1 alone nothing.
    total = 1 / 3 + 4 / 9
    assert got[0]["s1"] == pytest.approx(1 / 3 / total, abs=0.03) and got[1]["s1"] == pytest.approx(0, abs=0.03)
    assert got[0]["st"] == pytest.approx(1, abs=0.03) and got[1]["st"] == pytest.approx(4 / 9 / total, abs=0.03)
    assert got[2]["st"] == pytest.approx(0, abs=1e-12) and got[3]["st"] == pytest.approx(0, abs=1e-12)
    conf = {r["param"]: r["st_conf"] for r in sensitivity.sobol_bootstrap(scored, ["variable", "feat_idx"], 30).collect()}
    assert 0 < conf[0] < 0.1 and conf[2] == pytest.approx(0, abs=1e-12)
    x = sensitivity.saltelli_design(base, 4).where("row = 7").collect()
    by = {r["matrix"]: r["x"] for r in x}
    assert len(by) == 6 and all(by[m][3] == 0.5 for m in by) and by[1] == [by[-1][0], by[-2][1], *by[-1][2:]]
    assert sensitivity.primes(40)[-1] == 173


def test_correlations_of_free_parameters(spark):
    a = np.array([[4.0, 1.0, 0.5], [1.0, 3.0, 0.2], [0.5, 0.2, 2.0]])
    h = spark.createDataFrame([(g, i, j, float(s * a[i, j])) for g, s in ((0, 1), (1, 1), (2, -1)) for i in range(3) for j in range(i, 3)], "g int, i int, j int, h double")
    at = spark.createDataFrame([(0, [0.5] * 3), (1, [0.5, 0.0, 0.5]), (2, [0.5] * 3)], "g int, x array<double>").withColumns({"lo": F.array(*[F.lit(0.0)] * 3), "hi": F.array(*[F.lit(1.0)] * 3)})
    cov = sensitivity.covariance(h, at, 3, ["g"])
    se = {(r["g"], r["param"]): (r["at_bound"], r["stderr"]) for r in sensitivity.uncertainty_table(cov, 3, ["g"]).collect()}
    corr = {(r["g"], r["i"], r["j"]): r["corr"] for r in sensitivity.correlation_table(cov, 3, ["g"]).collect()}
    inv = np.linalg.inv(a)
    part = np.linalg.inv(a[np.ix_([0, 2], [0, 2])])
    assert all(se[0, k] == (False, pytest.approx(inv[k, k] ** 0.5)) for k in range(3)) and corr[0, 0, 2] == pytest.approx(inv[0, 2] / (inv[0, 0] * inv[2, 2]) ** 0.5)
    assert se[1, 1] == (True, None) and se[1, 2] == (False, pytest.approx(part[1, 1] ** 0.5)) and corr[1, 0, 1] is None and corr[1, 0, 2] == pytest.approx(part[0, 1] / (part[0, 0] * part[1, 1]) ** 0.5)
    assert all(se[2, k] == (False, None) for k in range(3))  # no minimum


def test_profiles_of_a_bent_and_a_bounded_cost(spark):
    best = spark.createDataFrame([(0, 0.2, -1.0, 1.0), (1, -0.1, -1.0, 1.0), (2, 0.0, 0.0, 1.0)], "param int, value double, lo double, hi double")

    def score(c):
        x, y, z = (F.get("x", F.lit(k)) for k in range(3))
        a, b = x - 0.2, y + 0.1
        return c.select("cand_id", (3.0 + a**4 + 2 * (b - a * a) ** 2 + 1e-3 * a * b + z * z + 0.5 * z).alias("cost"))

    got = {(r["param"], r["direction"]): r for r in sensitivity.profile_scan(score, best, 3, 0.05).collect()}
    # With x pinned, b is a² less a 4000th of a.
    for way in (1, -1):
        a, far = 0.0, 1.0
        for _ in range(60):
            mid = (a + far) / 2
            cost = mid**4 + 1e-3 * way * mid * mid * mid - 1e-6 * mid * mid / 8
            a, far = (mid, far) if cost < 0.05 else (a, mid)
        assert got[0, way]["crossing"] == pytest.approx(0.2 + way * a, abs=1e-6) and not got[0, way]["open"]
    # With y pinned below, x stays near its best and the cost is 2 b²; above, x leaves to either side and the cost is 2 b² / 3.
    assert got[1, -1]["crossing"] == pytest.approx(-0.1 - math.sqrt(0.025), abs=1e-3)
    assert got[1, 1]["crossing"] == pytest.approx(-0.1 + math.sqrt(0.075), abs=2e-3)
    assert got[2, -1]["open"] and got[2, -1]["crossing"] == 0.0  # no room on this side
    assert got[2, 1]["crossing"] == pytest.approx((-0.5 + math.sqrt(0.25 + 0.2)) / 2, abs=1e-6) and not got[2, 1]["open"]


def test_profile_reaches_the_edge_and_bounds_of_others(spark):
    best = spark.createDataFrame([(0, 0.0, -1.0, 1.0), (1, 0.0, -0.1, 0.1)], "param int, value double, lo double, hi double")

    def score(c):
        x, y = (F.get("x", F.lit(k)) for k in range(2))
        return c.select("cand_id", (x * x + y * y - 1.6 * x * y).alias("cost"))

    got = {(r["param"], r["direction"]): r for r in sensitivity.profile_scan(score, best, 2, 0.2).collect()}
    # y would go to 0.8 x and stops at 0.1: x² - 0.16 x + 0.01 = 0.2.
    assert got[0, 1]["crossing"] == pytest.approx(0.08 + math.sqrt(0.0064 + 0.19), abs=1e-6)
    assert got[1, 1]["open"] and got[1, 1]["crossing"] == 0.1 and got[1, -1]["open"]


@pytest.mark.parametrize("likelihood", ["gaussian", "laplace", "student_t"])
def test_sigma_mle_equals_a_dense_search(spark, likelihood):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k, (sd, v) in enumerate(((1.0, 0.2), (0.1, 0.5), (3.0, 0.01), (0.4, 0.0))):
        r, gp, w = rng.normal(0, sd, 60), rng.uniform(0.5, 1.5, 60) * v, rng.uniform(0.1, 1, 60)
        rows += [(k, float(a), float(b), 0.01, float(c)) for a, b, c in zip(r, gp, w, strict=True)]

        def nll(s, r=r, gp=gp, w=w):
            v = np.maximum(gp + 0.01 + s, 1e-6)
            t = {"gaussian": lambda: 0.5 * r * r / v + 0.5 * np.log(2 * np.pi * v), "laplace": lambda: np.sqrt(2) * np.abs(r) / np.sqrt(v) + 0.5 * np.log(2 * v),
                 "student_t": lambda: 0.5 * np.log(v) + 2.5 * np.log1p(r * r / (4 * v)) - math.lgamma(2.5) + math.lgamma(2) + 0.5 * math.log(4 * math.pi)}[likelihood]()
            return (w * t).sum() / w.sum()

        lo, hi = 0.0, 200.0
        for _ in range(12):
            s = np.concatenate([[lo], np.geomspace(max(lo, 1e-9), hi, 400)]) if lo < 1e-6 else np.linspace(lo, hi, 400)
            i = int(np.argmin([nll(v) for v in s]))
            lo, hi = s[max(i - 1, 0)], s[min(i + 1, len(s) - 1)]
        want[k] = ((lo + hi) / 2, nll((lo + hi) / 2))
    rows += [(9, None, 1.0, 0.0, 1.0), (0, 1.0, None, 0.0, 1.0), (0, 1.0, 1.0, 0.0, None)]
    df = spark.createDataFrame(rows, "k int, r double, gp_var double, obs_var double, w double").repartition(5)
    got = {r["k"]: r for r in errors.sigma_mle(df, ["k"], likelihood=likelihood).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for k, (s, f) in want.items():
        assert got[k]["nll"] == pytest.approx(f, abs=1e-9) and got[k]["s2"] == pytest.approx(s, abs=1e-6) and got[k]["passes"] <= 30
    assert got[1]["s2"] == 0.0


def test_ranks_over_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [("hot", float(rng.integers(0, 50)), f"s{k:04d}") for k in range(900)] + [(None, 1.0, "a"), (None, None, "b"), ("cold", 2.0, "x")]
    df = spark.createDataFrame(rows, "g string, v double, s string").withColumns({"part_": F.lit(1), "at_": F.lit(2)})
    for ranges in (1, 7, None):
        got = {(r["g"], r["s"]): (r["rank"], r["n"]) for r in compare.ranked(df, ["g"], ["v", "s"], ranges).collect()}
        hot = pd.DataFrame([r for r in rows if r[0] == "hot"], columns=["g", "v", "s"]).sort_values(["v", "s"]).reset_index(drop=True)
        assert all(got["hot", s] == (k + 1, 900) for k, s in enumerate(hot["s"]))
        assert got[None, "b"] == (1, 2) and got[None, "a"] == (2, 2) and got["cold", "x"] == (1, 1)
    assert compare.ranked(df.limit(0), ["g"], ["v", "s"]).count() == 0
    near = spark.createDataFrame([("p", "a", 1.0, 1.1), ("p", "b", 1.0, 0.9), ("p", "c", None, 1.0), ("q", "a", 5.0, 1.0), ("q", "b", 1.0, 1.0)], "k string, scenario string, pred double, obs double")
    labels = {(r["k"], r["scenario"]): (r["rank"], r["label"]) for r in compare.closest_to_obs(near, ["k"]).collect()}
    assert labels["p", "b"] == (1, "closest") and labels["p", "c"] == (3, "furthest") and labels["q", "b"] == (1, "closest")
    counts = {r["scenario"]: r["n_closest"] for r in compare.closest_counts(near.drop("k"), [], ["obs"]).collect()}
    assert sum(counts.values()) == 3


def calibration(spark, calls):
    """Candidates 0..20 with one parameter; residuals shrink as it nears the sigma in use."""
    cands = spark.range(21).select(F.col("id").alias("cand_id"), F.array(F.col("id") / 20.0).alias("x"))

    def optimise(sigma):
        calls.append(1)
        s = sigma.where("b = 'free'").agg(F.first("sigma").alias("s"))
        c = cands.crossJoin(s).withColumn("cost", F.abs(F.get("x", F.lit(0)) - F.col("s")))
        return c.orderBy("cost", "cand_id").limit(1).select("cand_id", "x", "cost")

    def residuals(best):
        rows = best.select(F.explode(F.array(F.lit("free"), F.lit("held"))).alias("b"), (F.get("x", F.lit(0)) * 0.5 + 0.2).alias("r"))
        return rows.select("b", "r", F.lit(0.0).alias("gp_var"), F.lit(0.0).alias("obs_var"), F.lit(1.0).alias("w"))

    start = spark.createDataFrame([("free", 0.9), ("held", 0.1)], "b string, sigma double")
    return optimise, residuals, start, spark.createDataFrame([("held", 0.7)], "b string, sigma double")


@pytest.mark.parametrize("method", ["moment", "mle"])
def test_calibration_goes_on_where_it_was_killed(spark, tmp_path, method):
    key = lambda df: [tuple(r) for r in df.orderBy("round", "b").collect()]
    calls: list[int] = []
    args = calibration(spark, calls)
    more = {"tol": 1e-3} if method == "mle" else {}
    whole = key(errors.calibrate_loop(*args[:2], ["b"], *args[2:], method=method, rounds=9, tol_sigma=0.03, **more))
    ran = len(calls)
    n = whole[-1][0] + 1
    assert ran == n < 9 and whole[-1][-1] and not whole[0][-1]
    assert all(r[3] == 0.7 for r in whole if r[1] == "held" and r[0] > 0) and all(r[4] == (r[1] == "held") for r in whole)

    path = f"{tmp_path}/{method}"

    def killed(best):
        if len(calls) - ran == 2:
            raise RuntimeError("lost")
        return args[1](best)

    with pytest.raises(RuntimeError, match="lost"):
        errors.calibrate_loop(args[0], killed, ["b"], *args[2:], method=method, rounds=9, tol_sigma=0.03, path=path, **more)
    (tmp_path / method / "round_1").mkdir(exist_ok=True)  # a round that was not finished does not count
    (tmp_path / method / "round_1" / "part-0.parquet").write_bytes(b"torn")
    before = len(calls)
    again = key(errors.calibrate_loop(*args[:2], ["b"], *args[2:], method=method, rounds=9, tol_sigma=0.03, path=path, **more))
    assert again == whole and len(calls) - before == n - 1
    before = len(calls)
    assert key(errors.calibrate_loop(*args[:2], ["b"], *args[2:], method=method, rounds=9, tol_sigma=0.03, path=path, **more)) == whole and len(calls) == before
    log = errors.calibrate_loop(*args[:2], ["b"], *args[2:], method=method, rounds=9, tol_sigma=0.03, path=path, **more)
    final = {r["b"]: (r["sigma"], r["fixed"]) for r in errors.calibrated_sigma(log, ["b"]).collect()}
    assert final["held"] == (0.7, True) and final["free"][0] == [r for r in whole if r[1] == "free"][-1][2]
    moved = {r["factor"]: r["dtheta_max"] for r in errors.sigma_sensitivity(args[0], log, ["b"]).collect()}
    assert moved[0.5] > 0 and moved[2.0] > 0


def test_stage_tables_by_partition(spark, tmp_path):
    path, schema = str(tmp_path), "member int, level int, value double"
    ppe = spark.createDataFrame([(m, lv, float(m + lv)) for m in range(4) for lv in (0, 1)], schema)
    obs = spark.createDataFrame([(1, 5.0)], "variable int, value double")
    assert sorted(manifest.zrg_persist({"ppe": ppe, "obs": obs}, path)) == ["obs", "ppe"]
    assert list(manifest.zrg_persist({"ppe": ppe.where("level = 1 and member < 2").withColumn("value", F.lit(-1.0)), "obs": obs}, path, "ppe")) == ["ppe"]
    back = {(r["member"], r["level"]): r["value"] for r in manifest.zrg_load(spark, path, "ppe", schema).collect()}
    assert back == {(m, 0): float(m) for m in range(4)} | {(0, 1): -1.0, (1, 1): -1.0}
    assert manifest.zrg_load(spark, path, "obs", "variable int, value double").first()["value"] == 5.0
    assert manifest.zrg_commits(spark, path).agg(F.max("commit")).first()[0] == 1
    # A partition that was replaced without a commit is found.
    ppe.where("level = 0").limit(2).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("level").parquet(f"{path}/ppe")
    with pytest.raises(ValueError, match="level"):
        manifest.zrg_load(spark, path, "ppe", schema)
    assert manifest.zrg_load(spark, path, "ppe", schema, check=False).count() == 4
    with pytest.raises(ValueError, match="mode"):
        manifest.zrg_persist({}, path, "all")
