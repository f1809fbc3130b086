"""Queries: polynomial surrogates of all outputs and parameters, and what is computed from them."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from zonalis.functions.lineage import settled
from zonalis.operators import regression, sensitivity
from zonalis.sources import fixtures as fx

from .registry import query, rounded
from .skill_queries import FOLDS, K, _folds, _level, _x

P = fx.N_PARAMS
OUTPUTS = [(v, f) for v in range(4) for f in range(fx.N_FEAT)]
RIDGE = "1e-8"


def recursive(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + fx.sql(body, *more).removeprefix("WITH ")


def phi_sql(degree: int, x: str = "e[1:19]") -> str:
    """The terms of a point as a DuckDB list."""
    square = f" || flatten(list_transform(range(1, {P + 1}), lambda i: list_transform(range(i, {P + 1}), lambda j: {x}[i] * {x}[j])))" if degree == 2 else ""
    return f"([1e0] || {x}{square})"


def fit_ctes(degree: int, level: int, folds: bool, loose: bool = False) -> list[str]:
    """CTEs up to fit (k, variable, feat_idx, n, coef, mean, scale): normal equations solved by elimination; k = -1 without folds.

    loose: members in no fold are in every training set.
    """
    m, keys = regression.n_terms(P, degree), "(SELECT unnest(range(5)) AS k)" if folds else "(SELECT -1 AS k)"
    fold = f"{'LEFT ' if loose else ''}JOIN folds USING (member)" if folds else ""
    mine = "WHERE fold IS DISTINCT FROM k" if folds else ""
    return [
        *([FOLDS] if folds else []),
        f"phi AS MATERIALIZED (SELECT member, {phi_sql(degree)} AS phi FROM vectors)",
        f"train AS MATERIALIZED (SELECT CAST(k AS INTEGER) AS k, member, phi, variable, feat_idx, value FROM outputs JOIN phi USING (member) {fold}, {keys} {mine + ' AND' if folds else 'WHERE'} level = {level})",
        f"gram AS (SELECT k, i, j, sum(phi[i] * phi[j]) AS v FROM (SELECT k, member, any_value(phi) AS phi FROM train GROUP BY ALL), range(1, {m + 1}) t(i), range(1, {m + 1}) u(j) GROUP BY ALL)",
        f"ridge AS (SELECT k, {RIDGE} * sum(v) / {m} AS r FROM gram WHERE i = j GROUP BY k)",
        "xrows AS (SELECT k, i, list(v + CASE WHEN i = j THEN r ELSE 0 END ORDER BY j) AS row FROM gram JOIN ridge USING (k) GROUP BY k, i)",
        f"xty AS (SELECT k, i, list(b ORDER BY variable, feat_idx) AS row FROM (SELECT k, i, variable, feat_idx, sum(phi[i] * value) AS b FROM train, range(1, {m + 1}) t(i) GROUP BY ALL) GROUP BY k, i)",
        "aug AS (SELECT k, list(x.row || y.row ORDER BY i) AS m FROM xrows x JOIN xty y USING (k, i) GROUP BY k)",
        f"el(k, s, m) AS (SELECT k, 0, m FROM aug UNION ALL SELECT k, s + 1, list_transform(m, lambda r, i: CASE WHEN i = s + 1 THEN piv ELSE list_transform(list_zip(r, piv), lambda z: z[1] - r[s + 1] * z[2]) END) FROM (SELECT *, list_transform(m[s + 1], lambda v: v / m[s + 1][s + 1]) AS piv FROM el WHERE s < {m}))",
        f"fit AS MATERIALIZED (SELECT k, CAST(o // 11 AS INTEGER) AS variable, CAST(o % 11 AS INTEGER) AS feat_idx, list_transform(m, lambda r: r[{m} + o + 1]) AS coef, n, mean, scale FROM el, (SELECT unnest(range(44)) AS o) JOIN (SELECT k AS k2, variable AS v2, feat_idx AS f2, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS scale FROM train GROUP BY ALL) ON v2 = o // 11 AND f2 = o % 11 WHERE s = {m} AND k = k2)",
    ]


def _training(spark, d, level: int):
    """All outputs and parameters of one level."""
    return _level(spark, d, level).withColumnRenamed("value", "y").join(_x(spark, d), "member")


def _quadratic(spark, d):
    return regression.fit_poly(_training(spark, d, 0), 2)


@query("fit_poly", recursive("SELECT variable, feat_idx, n, CAST(term AS INTEGER) AS term, round(coef[term + 1], 6) AS value FROM fit, (SELECT unnest(range(210)) AS term)", *fit_ctes(2, 0, False)))
def fit_poly(spark, d):
    """A quadratic in all 19 parameters for each of the 44 outputs, from all members."""
    return rounded(_quadratic(spark, d).select("variable", "feat_idx", "n", F.posexplode("coef").alias("term", "value")), "value")


@query("fit_poly_linear", recursive("SELECT variable, feat_idx, n, CAST(term AS INTEGER) AS term, round(coef[term + 1], 6) AS value FROM fit, (SELECT unnest(range(20)) AS term)", *fit_ctes(1, 1, False)))
def fit_poly_linear(spark, d):
    f = regression.fit_poly(_training(spark, d, 1), 1)
    return rounded(f.select("variable", "feat_idx", "n", F.posexplode("coef").alias("term", "value")), "value")


HELD = "held AS MATERIALIZED (SELECT f.k, f.variable, f.feat_idx, o.member, o.value AS truth, list_dot_product(f.coef, p.phi) AS pred, f.mean, f.scale FROM fit f JOIN outputs o ON o.variable = f.variable AND o.feat_idx = f.feat_idx JOIN phi p ON p.member = o.member JOIN folds d ON d.member = o.member AND d.fold = f.k WHERE o.level = 1)"
SKILL = """feats AS (SELECT k, variable, feat_idx, sum((truth - pred) * (truth - pred)) AS e, var_pop(truth) * count(*) AS t, sum(((truth - pred) / scale) * ((truth - pred) / scale)) AS en, var_pop((truth - mean) / scale) * count(*) AS tn, count(*) AS n FROM held GROUP BY ALL),
skill AS (SELECT k, variable, 1 - sum(e) / sum(t) AS r2_phys, avg(sqrt(e / n)) AS rmse_phys, 1 - sum(en) / sum(tn) AS r2_norm, avg(sqrt(en / n)) AS rmse_norm FROM feats GROUP BY k, variable)"""
UNITS = ("r2_phys", "rmse_phys", "r2_norm", "rmse_norm")


def _held(spark, d):
    return regression.kfold_eval(_training(spark, d, 1), _folds(spark, d), 5, 1)


@query("kfold_eval", recursive("SELECT k, variable, " + ", ".join(f"round({u}, 6) AS {u}" for u in UNITS) + " FROM skill", *fit_ctes(1, 1, True), HELD, SKILL))
def kfold_eval(spark, d):
    """Five folds of the middle level, all 44 outputs and 19 parameters, in both unit systems."""
    return rounded(regression.skill_both_units(_held(spark, d), ["k", "variable"]), *UNITS)


@query("kfold_predictions", recursive("SELECT k, variable, feat_idx, member, round(truth, 6) AS truth, round(pred, 6) AS pred, round((truth - mean) / scale, 6) AS truth_norm, round((pred - mean) / scale, 6) AS pred_norm FROM held", *fit_ctes(1, 1, True), HELD))
def kfold_predictions(spark, d):
    return rounded(_held(spark, d), "truth", "pred", "truth_norm", "pred_norm")


def _lower(ctes: list[str]) -> list[str]:
    """The CTEs of a second fit beside the first one, under other names."""
    return [re.sub(r"\b(train|gram|ridge|xrows|xty|aug|el|fit)\b", r"low_\1", c) for c in ctes if not c.startswith(("folds", "phi"))]


THREE = """low_held AS (SELECT f.variable, f.feat_idx, o.member, o.value AS truth, list_dot_product(f.coef, p.phi) AS pred FROM low_fit f JOIN outputs o ON o.variable = f.variable AND o.feat_idx = f.feat_idx JOIN phi p ON p.member = o.member JOIN folds d ON d.member = o.member AND d.fold = f.k WHERE o.level = 1),
three AS (SELECT 'surrogate' AS predictor, variable, feat_idx, truth, pred FROM held UNION ALL SELECT 'lower surrogate', variable, feat_idx, truth, pred FROM low_held UNION ALL SELECT 'lower run', h.variable, h.feat_idx, h.truth, o.value FROM held h JOIN outputs o USING (variable, feat_idx, member) WHERE o.level = 0)"""


@query("holdout_baselines", recursive("SELECT predictor, variable, round(1 - sum(sse) / sum(sst), 6) AS r2, round(avg(sqrt(sse / n)), 6) AS rmse FROM (SELECT predictor, variable, feat_idx, count(*) AS n, sum((truth - pred) * (truth - pred)) AS sse, var_pop(truth) * count(*) AS sst FROM three GROUP BY ALL) GROUP BY ALL", *fit_ctes(1, 1, True), *_lower(fit_ctes(1, 0, True, loose=True)), HELD, THREE))
def holdout_baselines(spark, d):
    """Held-out members of the middle level by its own surrogate, by the lowest level's surrogate that saw none of their points, and by the lowest level's run there."""
    from zonalis.operators.metrics import baselines

    columns = ["member", *K, "truth", "pred"]
    held = settled(_held(spark, d).select("k", *columns))
    models = regression.fold_models(_training(spark, d, 0), _folds(spark, d), 1)
    low = regression.predict_poly(models, _x(spark, d).join(_folds(spark, d).withColumnRenamed("fold", "k"), "member"), 1, ["k"]).select("member", *K, F.col("mean").alias("pred"))
    truth = held.select("member", *K, "truth")
    run = _level(spark, d, 0).select("member", *K, F.col("value").alias("pred"))
    three = {"surrogate": held.select(columns), "lower surrogate": truth.join(low, ["member", *K]).select(columns), "lower run": truth.join(run, ["member", *K]).select(columns)}
    return rounded(baselines(three, ["variable"], ["feat_idx"]), "r2", "rmse")


@query("kfold_quadratic")
def kfold_quadratic(spark, d):
    """Folds of the lowest level under the quadratic: as many members as the terms need."""
    from zonalis.operators.splits import kfold_assign

    t = _training(spark, d, 0)
    folds = kfold_assign(t.select("member").distinct(), 5, 2)
    return rounded(regression.skill_both_units(regression.kfold_eval(t, folds, 5, 2), ["k", "variable"]), *UNITS)


GRID = "pgrid AS (SELECT param, CAST(g AS INTEGER) AS g, lo + (hi - lo) * g / 4e0 AS v FROM (SELECT param, min(value) AS lo, max(value) AS hi FROM params GROUP BY param), (SELECT unnest(range(5)) AS g))"
#: The same averages, by brute force: the model's terms averaged over the members with two parameters replaced.
PD = f"""pts AS (SELECT a, b, va, vb, list_transform(range(1, {regression.n_terms(P, 2) + 1}), lambda i: CAST(s[i] AS DOUBLE)) AS s FROM (SELECT a.param AS a, b.param AS b, a.v AS va, b.v AS vb, [avg(1e0)] || [{', '.join(f'avg(CASE WHEN a.param = {i} THEN a.v WHEN b.param = {i} THEN b.v ELSE e[{i + 1}] END)' for i in range(P))}] || [{', '.join(f'avg(CASE WHEN a.param = {i} THEN a.v WHEN b.param = {i} THEN b.v ELSE e[{i + 1}] END * CASE WHEN a.param = {j} THEN a.v WHEN b.param = {j} THEN b.v ELSE e[{j + 1}] END)' for i in range(P) for j in range(i, P))}] AS s FROM pgrid a JOIN pgrid b ON a.param < b.param, vectors GROUP BY ALL))"""


@query("partial_dependence", recursive("SELECT variable, feat_idx, CAST(a AS INTEGER) AS p1, CAST(b AS INTEGER) AS p2, round(va, 6) AS v1, round(vb, 6) AS v2, round(list_dot_product(coef, s), 6) AS value FROM fit, pts", *fit_ctes(2, 0, False), GRID, PD))
def partial_dependence(spark, d):
    """Every pair of the 19 parameters on a grid of 5 by 5, for each output: the fitted quadratic averaged over all members."""
    p = fx.params(spark, d)
    box = p.groupBy("param").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    grid = box.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("param", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("g") / 4.0).alias("value"))
    out = regression.partial_dependence(_quadratic(spark, d), _x(spark, d), P, grid)
    return rounded(out.select("variable", "feat_idx", F.col("a").alias("p1"), F.col("b").alias("p2"), F.col("va").alias("v1"), F.col("vb").alias("v2"), "value"), "v1", "v2", "value")


# Sensitivity under the quadratic: all 19 parameters, all 44 outputs.
BOX = "box AS (SELECT list(lo ORDER BY param) AS lo, list(hi ORDER BY param) AS hi, list(m ORDER BY param) AS mid FROM (SELECT param, min(value) AS lo, max(value) AS hi, avg(value) AS m FROM params GROUP BY param))"
IDS = "ids AS (SELECT i FROM (SELECT unnest(range((SELECT count(*) FROM embeddings))) AS i))"
ROOTS = str([float(q) for q in sensitivity.primes(2 * P)])
BASE = f"base AS (SELECT i AS row, list(u ORDER BY k) AS u FROM (SELECT i, k, lo[k % {P} + 1] + ((i + 1) * sqrt(q) - floor((i + 1) * sqrt(q))) * (hi[k % {P} + 1] - lo[k % {P} + 1]) AS u FROM ids, box, (SELECT unnest(range({2 * P})) AS k, unnest({ROOTS}) AS q)) GROUP BY i)"
DESIGN = f"design AS (SELECT row, CAST(m AS INTEGER) AS matrix, list_transform(range(1, {P + 1}), lambda k: CASE WHEN m = -2 OR m = k - 1 THEN u[k + {P}] ELSE u[k] END) AS x FROM base, (SELECT unnest(range(-2, {P})) AS m))"


def _box(spark, d):
    return fx.params(spark, d).groupBy("param").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def _base(spark, d):
    return sensitivity.saltelli_base(spark, fx.read(spark, d, "embeddings").count(), _box(spark, d), P)


@query("saltelli_design", fx.sql("SELECT row, matrix, " + ", ".join(f"round(x[{k + 1}], 6) AS x{k}" for k in range(P)) + " FROM design", BOX, IDS, BASE, DESIGN))
def saltelli_design(spark, d):
    """As many base rows as members, in the sampled box of all 19 parameters."""
    s = sensitivity.saltelli_design(_base(spark, d), P)
    x = [f"x{k}" for k in range(P)]
    return rounded(s.select("row", "matrix", *(F.get("x", F.lit(k)).alias(n) for k, n in enumerate(x))), *x)


SCORED = f"""scored AS MATERIALIZED (SELECT variable, feat_idx, row, matrix, list_dot_product(coef, phi) AS value FROM fit, (SELECT row, matrix, {phi_sql(2, 'x')} AS phi FROM design)),
ab AS MATERIALIZED (SELECT h.variable, h.feat_idx, h.row, h.matrix AS param, h.value AS h, a.value AS a, b.value AS b FROM scored h JOIN scored a USING (variable, feat_idx, row) JOIN scored b USING (variable, feat_idx, row) WHERE h.matrix >= 0 AND a.matrix = -1 AND b.matrix = -2)"""
SOBOL = """spread AS (SELECT variable, feat_idx, var_pop(value) AS var FROM scored WHERE matrix < 0 GROUP BY ALL),
sob AS (SELECT variable, feat_idx, param, avg(b * (h - a)) / any_value(var) AS s1, 0.5e0 * avg((a - h) * (a - h)) / any_value(var) AS st, any_value(var) AS var FROM ab JOIN spread USING (variable, feat_idx) GROUP BY ALL)"""
SURROGATE = fit_ctes(2, 0, False)


def _scored(spark, d):
    return regression.saltelli_scores(_base(spark, d), _quadratic(spark, d), 2)


@query("sobol_indices", recursive("SELECT variable, feat_idx, param, round(s1, 6) AS s1, round(st, 6) AS st, round(var, 6) AS var FROM sob", BOX, IDS, BASE, DESIGN, *SURROGATE, SCORED, SOBOL))
def sobol_indices(spark, d):
    return rounded(sensitivity.sobol_indices(_scored(spark, d), K), "s1", "st", "var")


@query("sobol_summary", recursive("SELECT variable, param, round(sum(st * var) / sum(var), 6) AS st, round(sum(s1 * var) / sum(var), 6) AS s1 FROM sob GROUP BY ALL", BOX, IDS, BASE, DESIGN, *SURROGATE, SCORED, SOBOL))
def sobol_summary(spark, d):
    return rounded(sensitivity.sobol_summary(sensitivity.sobol_indices(_scored(spark, d), K)), "st", "s1")


POISSON = " + ".join(f"CASE WHEN u >= {sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))!r}e0 THEN 1 ELSE 0 END" for k in range(12))
WEIGHTS = f"w AS MATERIALIZED (SELECT i AS row, r, {POISSON} AS w FROM (SELECT i, r, CAST(('0x' || substr(md5(CAST(i AS VARCHAR) || ':' || CAST(r AS VARCHAR) || ':0'), 1, 8)) AS BIGINT) / 4294967296e0 AS u FROM ids, (SELECT unnest(range(20)) AS r)))"
BOOT = """whole AS (SELECT variable, feat_idx, r, sum(w) AS n, sum(w * value) AS s, sum(w * value * value) AS ss FROM scored JOIN w USING (row) WHERE matrix = -1 GROUP BY ALL),
again AS (SELECT variable, feat_idx, param, r, 0.5e0 * sum(w * (a - h) * (a - h)) AS d FROM ab JOIN w USING (row) GROUP BY ALL)"""


@query("sobol_bootstrap", recursive("SELECT variable, feat_idx, param, round(1.96e0 * stddev_samp(d / n / (ss / n - (s / n) * (s / n))), 6) AS st_conf FROM again JOIN whole USING (variable, feat_idx, r) GROUP BY ALL", BOX, IDS, BASE, DESIGN, *SURROGATE, SCORED, WEIGHTS, BOOT))
def sobol_bootstrap(spark, d):
    return rounded(sensitivity.sobol_bootstrap(_scored(spark, d), K, 20), "st_conf")


# The cost of the quadratic's predictions against the observations, in units of each output's spread.
def cost_sql(x: str, source: str, keys: str) -> str:
    """(keys, cost) of the points x of a table."""
    return f"SELECT {keys}, 0.5e0 * sum(((list_dot_product(coef, phi) - obs) / scale) * ((list_dot_product(coef, phi) - obs) / scale)) AS cost FROM (SELECT {keys}, {phi_sql(2, x)} AS phi FROM {source}), fit JOIN observed USING (variable, feat_idx) GROUP BY {keys}"


def _cost(spark, d):
    from zonalis.operators.scaling import fit_standard

    scale = fit_standard(_level(spark, d, 0), K).select(*K, "scale")
    return regression.gaussian_cost(_quadratic(spark, d), fx.observed(spark, d), scale, 2)


def _middle(spark, d):
    """One row: the mean of each parameter, its box and the width of a step."""
    b = fx.params(spark, d).groupBy("param").agg(F.avg("value").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = b.agg(F.array_sort(F.collect_list(F.struct("param", "m", "lo", "hi"))).alias("b"))
    return b.select(F.transform("b", lambda z: z["m"]).alias("x0"), F.transform("b", lambda z: (z["hi"] - z["lo"]) * 0.05).alias("eps"), F.transform("b", lambda z: z["lo"]).alias("lo"), F.transform("b", lambda z: z["hi"]).alias("hi"))


def _hessian(spark, d):
    probes = sensitivity.stencil(_middle(spark, d), P).withColumn("cand_id", (F.col("i") + 1) * 1000 + (F.col("j") + 1) * 10 + (F.col("si") + 1) * 3 + F.col("sj") + 1)
    return sensitivity.hessian(probes.join(_cost(spark, d)(probes), "cand_id"))


PROBES = f"""steps AS (SELECT lo, hi, mid, list_transform(range(1, {P + 1}), lambda k: greatest(least((hi[k] - lo[k]) * 0.05e0, mid[k] - lo[k], hi[k] - mid[k]), 1e-10)) AS h FROM box),
ij AS (SELECT i, j, s, t FROM (SELECT unnest(range({P})) AS i), (SELECT unnest(range({P})) AS j), (SELECT unnest([-1, 1]) AS s), (SELECT unnest([-1, 0, 1]) AS t) WHERE (i < j AND t <> 0) OR (i = j AND t = 0) UNION ALL SELECT -1, -1, 0, 0),
probes AS (SELECT i, j, s, t, list_transform(range(1, {P + 1}), lambda k: mid[k] + CASE WHEN k = i + 1 THEN s * h[k] ELSE 0 END + CASE WHEN k = j + 1 AND i <> j THEN t * h[k] ELSE 0 END) AS x FROM ij, steps)"""
HESSIAN = f"""pc AS ({cost_sql('x', 'probes', 'i, j, s, t')}),
hess AS (SELECT i, j, sum(CASE WHEN i = j THEN cost - (SELECT cost FROM pc WHERE i < 0) ELSE cost * s * t / 4e0 END) / any_value(h[i + 1] * h[j + 1]) AS h FROM pc, steps WHERE i >= 0 GROUP BY i, j)"""


@query("hessian_stencil", recursive("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(h, 6) AS h FROM hess", BOX, *SURROGATE, PROBES, HESSIAN))
def hessian_stencil(spark, d):
    """All 19 parameters around their means; the cost is that of all 44 predictions against the observations."""
    return rounded(_hessian(spark, d), "h")


def _uncertainty(spark, d):
    m = _middle(spark, d).select(F.col("x0").alias("x"), "lo", "hi")
    return sensitivity.covariance(_hessian(spark, d), m, P)


INVERSE = f"""hrows AS (SELECT i, list(h ORDER BY j) || list_transform(range({P}), lambda c: CASE WHEN c = i THEN 1e0 ELSE 0e0 END) AS row FROM (SELECT i, j, h FROM hess UNION ALL SELECT j, i, h FROM hess WHERE i < j) GROUP BY i),
inv(s, m) AS (SELECT 0, list(row ORDER BY i) FROM hrows UNION ALL SELECT s + 1, list_transform(m, lambda r, i: CASE WHEN i = s + 1 THEN piv ELSE list_transform(list_zip(r, piv), lambda z: z[1] - r[s + 1] * z[2]) END) FROM (SELECT *, list_transform(m[s + 1], lambda v: v / m[s + 1][s + 1]) AS piv FROM inv WHERE s < {P})),
cov AS (SELECT list_transform(m, lambda r: r[{P + 1}:]) AS c FROM inv WHERE s = {P}),
sound AS (SELECT CASE WHEN len(list_filter(range(1, {P + 1}), lambda k: c[k][k] <= 0)) = 0 THEN c END AS c FROM cov)"""


@query("param_uncertainty", recursive(f"SELECT CAST(k AS INTEGER) AS param, false AS at_bound, round(sqrt(c[k + 1][k + 1]), 6) AS stderr FROM sound, (SELECT unnest(range({P})) AS k)", BOX, *SURROGATE, PROBES, HESSIAN, INVERSE))
def param_uncertainty(spark, d):
    return rounded(sensitivity.uncertainty_table(_uncertainty(spark, d), P), "stderr")


@query("param_correlation", recursive(f"SELECT CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j, round(c[a + 1][b + 1] / sqrt(c[a + 1][a + 1] * c[b + 1][b + 1]), 6) AS corr FROM sound, (SELECT unnest(range({P})) AS a), (SELECT unnest(range({P})) AS b) WHERE a < b", BOX, *SURROGATE, PROBES, HESSIAN, INVERSE))
def param_correlation(spark, d):
    return rounded(sensitivity.correlation_table(_uncertainty(spark, d), P), "corr")


# Blocks of three parameters of every member, in one job: the curvature of a member's own cost, where the middle one may lie at its bound.
TRIPLES = """tri AS (SELECT member, CAST(t AS INTEGER) AS t, 2e0 + abs(e[3 * t + 1]) AS h00, e[3 * t + 1] AS h01, e[3 * t + 2] AS h02, 2e0 + abs(e[3 * t + 2]) AS h11, e[3 * t + 3] AS h12, 2e0 + abs(e[3 * t + 3]) AS h22, least(e[3 * t + 2] - lo[3 * t + 2], hi[3 * t + 2] - e[3 * t + 2]) <= 0.1e0 * (hi[3 * t + 2] - lo[3 * t + 2]) AS pin FROM vectors, box, (SELECT unnest(range(6)) AS t)),
det AS (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS d, h00 * h22 - h02 * h02 AS d2 FROM tri)"""


@query("block_uncertainty", fx.sql("SELECT member, t, CAST(k AS INTEGER) AS param, pin AND k = 1 AS at_bound, round(sqrt(CASE WHEN pin THEN CASE k WHEN 0 THEN h22 / d2 WHEN 2 THEN h00 / d2 END ELSE CASE k WHEN 0 THEN (h11 * h22 - h12 * h12) / d WHEN 1 THEN d2 / d ELSE (h00 * h11 - h01 * h01) / d END END), 6) AS stderr FROM det, (SELECT unnest(range(3)) AS k)", BOX, TRIPLES))
def block_uncertainty(spark, d):
    b = _middle(spark, d).select(F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    r = fx.vectors(spark, d).crossJoin(F.broadcast(b)).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(5))))
    e = lambda k: F.get("e", F.col("t") * 3 + k)
    big = lambda k: F.abs(e(k)) + 2.0
    entries = [(0, 0, big(0)), (0, 1, e(0)), (0, 2, e(1)), (1, 1, big(1)), (1, 2, e(2)), (2, 2, big(2))]
    h = r.select("member", "t", F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("h")) for i, j, v in entries))))
    three = lambda c: F.slice(c, F.col("t") * 3 + 1, 3)
    mid = lambda c: F.get(three(c), F.lit(1))
    # Only the middle one is held to its box.
    points = r.select("member", "t", F.array(F.lit(0.5), mid("e"), F.lit(0.5)).alias("x"), F.array(F.lit(0.0), mid("blo"), F.lit(0.0)).alias("lo"), F.array(F.lit(1.0), mid("bhi"), F.lit(1.0)).alias("hi"))
    return rounded(sensitivity.uncertainty_table(sensitivity.covariance(h, points, 3, ["member", "t"], near=0.1), 3, ["member", "t"]), "stderr")


# Profiles: a quadratic whose parameters are coupled by twos, so that each profile has a closed form.
CURVE = f"""cur AS (SELECT param, m, lo, hi, (1e0 + sd) * CASE WHEN param % 4 = 3 THEN 0.05e0 ELSE 1e0 END AS h FROM (SELECT param, avg(value) AS m, min(value) AS lo, max(value) AS hi, stddev_pop(value) AS sd FROM params GROUP BY param)),
eff AS (SELECT a.param, a.m, a.lo, a.hi, sqrt(0.01e0 / (a.h - coalesce(0.64e0 * a.h * b.h / (4e0 * b.h), 0))) AS d FROM cur a LEFT JOIN cur b ON b.param = a.param + 1 - 2 * (a.param % 2) AND a.param < {P - 1})"""


@query("profile_scan", fx.sql("SELECT CAST(param AS INTEGER) AS param, CAST(s AS INTEGER) AS direction, round(CASE WHEN s > 0 THEN least(m + d, hi) ELSE greatest(m - d, lo) END, 6) AS crossing, CASE WHEN s > 0 THEN m + d > hi ELSE m - d < lo END AS open FROM eff, (SELECT unnest([-1, 1]) AS s)", CURVE))
def profile_scan(spark, d):
    """Both sides of all 19 parameters, the 18 others minimised."""
    b = fx.params(spark, d).groupBy("param").agg(F.avg("value").alias("value"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.stddev_pop("value").alias("sd"))
    b = settled(b.withColumn("h", (1.0 + F.col("sd")) * F.when(F.col("param") % 4 == 3, 0.05).otherwise(1.0)))
    c = settled(b.agg(F.array_sort(F.collect_list(F.struct("param", "value", "h"))).alias("b")))

    def score(points):
        p = points.crossJoin(F.broadcast(c))
        gap = F.zip_with("x", "b", lambda x, z: F.struct((x - z["value"]).alias("g"), z["h"].alias("h")))
        p = p.select("cand_id", gap.alias("g"))
        own = F.aggregate("g", F.lit(0.0), lambda s, z: s + z["h"] * z["g"] * z["g"])
        pairs = F.transform(F.sequence(F.lit(0), F.lit(P - 3), F.lit(2)), lambda i: 0.8 * F.sqrt(F.get("g", i)["h"] * F.get("g", i + 1)["h"]) * F.get("g", i)["g"] * F.get("g", i + 1)["g"])
        return p.select("cand_id", (own + F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)).alias("cost"))

    out = sensitivity.profile_scan(score, b.select("param", "value", "lo", "hi"), P, 0.01)
    return rounded(out.select("param", "direction", "crossing", "open"), "crossing")


@query("search_multistart")
def search_multistart(spark, d):
    """Every member's parameters start a search in all 19 of them, for the least cost of all 44 predictions: until steps end, 25 rounds at most."""
    from zonalis.operators import search

    starts = _x(spark, d).withColumnRenamed("member", "start_idx")
    return search.search_multistart(starts, _cost(spark, d), _box(spark, d), rounds=25, tol=0.05)
