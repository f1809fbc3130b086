"""Queries: search, sensitivity, uncertainty, error estimates, comparisons and surrogate fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonalis.functions.lineage import removed, scratch, settled
from zonalis.operators import compare, errors, search, sensitivity, surrogate, zrg
from zonalis.sources import fixtures as fx

from .registry import query, rounded
from .skill_queries import PAIRS, K, _level, _pairs, _x

#: The sampled ranges of all parameters, as one row of lists.
BOX = "box AS (SELECT list(lo ORDER BY param) AS lo, list(hi ORDER BY param) AS hi FROM (SELECT param, min(value) AS lo, max(value) AS hi FROM params GROUP BY param))"
XS = [f"x{k}" for k in range(fx.N_PARAMS)]


def _box(spark, d):
    return fx.params(spark, d).groupBy("param").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def _split(df, *more):
    return rounded(df.select(*more, *(F.get("x", F.lit(k)).alias(n) for k, n in enumerate(XS))), *XS)


def _u(key: str, k: str, seed: int) -> str:
    return f"CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':' || CAST({k} AS VARCHAR) || ':{seed}'), 1, 8)) AS BIGINT) / 4294967296e0"


IDS = "ids AS (SELECT i FROM (SELECT unnest(range((SELECT count(*) FROM embeddings))) AS i))"


def _drawn(i: str, first: str) -> str:
    return f"list_transform(range({fx.N_PARAMS}), lambda k: lo[k + 1] + {_u(i, f'({first} + k)', 7)} * (hi[k + 1] - lo[k + 1]))"


X_COLUMNS = ", ".join(f"round(x[{k + 1}], 6) AS x{k}" for k in range(fx.N_PARAMS))


@query("starts_uniform", fx.sql(f"SELECT start_idx, seed, {X_COLUMNS} FROM (SELECT i AS start_idx, CAST(floor({_u('i', str(fx.N_PARAMS), 7)} * 2147483648e0) AS BIGINT) AS seed, {_drawn('i', '0')} AS x FROM ids, box)", BOX, IDS))
def starts_uniform(spark, d):
    """As many starts as members, in the sampled box of all 19 parameters."""
    n = fx.read(spark, d, "embeddings").count()
    return _split(search.starts_uniform(spark, n, _box(spark, d), 7), "start_idx", "seed")


@query("starts_feasible", fx.sql(f"SELECT start_idx, draw, {X_COLUMNS} FROM (SELECT i AS start_idx, CAST(draw AS INTEGER) AS draw, {_drawn('i', f'draw * {fx.N_PARAMS}')} AS x FROM firsts, box)", BOX, IDS,
                                 f"firsts AS (SELECT i, min(k) AS draw FROM ids, box, (SELECT unnest(range(64)) AS k) WHERE lo[1] + {_u('i', f'(k * {fx.N_PARAMS})', 7)} * (hi[1] - lo[1]) <= lo[2] + {_u('i', f'(k * {fx.N_PARAMS} + 1)', 7)} * (hi[2] - lo[2]) GROUP BY i)"))
def starts_feasible(spark, d):
    """The first two parameters keep their order."""
    ids = fx.results(spark, d).select("start_idx")
    return _split(search.starts_feasible(ids, _box(spark, d), (0, 1), 7).withColumn("draw", F.col("draw").cast("int")), "start_idx", "draw")


@query("rank_starts", fx.sql("SELECT CAST(row_number() OVER (ORDER BY cost, start_idx) AS INTEGER) AS rank, start_idx, round(cost, 6) AS cost FROM results ORDER BY cost, start_idx LIMIT 10"))
def rank_starts(spark, d):
    return rounded(search.rank_starts(fx.results(spark, d), 10).select("rank", "start_idx", "cost"), "cost")


@query("best_per_group", fx.sql("SELECT seed, start_idx, round(cost, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY cost, start_idx) AS r FROM results) WHERE r = 1"))
def best_per_group(spark, d):
    return rounded(search.best_per_group(fx.results(spark, d), ["seed"]).select("seed", "start_idx", "cost"), "cost")


@query("combine_sweep", fx.sql("SELECT CAST(row_number() OVER (ORDER BY cost, seed, start_idx) AS INTEGER) AS rank, seed, start_idx, round(cost, 6) AS cost FROM results ORDER BY cost, seed, start_idx LIMIT 25"))
def combine_sweep(spark, d):
    r = fx.results(spark, d)
    return rounded(search.combine_sweep([r.where("seed < 5"), r.where("seed >= 5")], 25).select("rank", "seed", "start_idx", "cost"), "cost")


@query("barcode_table", fx.sql("SELECT CAST(row_number() OVER (PARTITION BY p ORDER BY cost, start_idx) AS INTEGER) AS rank, CAST(p AS INTEGER) AS param, round(least(greatest(x[p + 1], 0e0), 1e0), 6) AS value, round(cost, 6) AS cost FROM (SELECT * FROM results ORDER BY cost, start_idx LIMIT 10), (SELECT unnest(range(19)) AS p)"))
def barcode_table(spark, d):
    return rounded(search.barcode_table(fx.results(spark, d), 10), "value", "cost")


@query("near_best_stats", fx.sql("SELECT round(best, 6) AS best, round(md, 6) AS median, round(worst, 6) AS worst, (SELECT count(*) FROM results WHERE cost <= best + 0.5e0 * abs(best)) AS n_near, (SELECT round(max(w), 6) FROM (SELECT p, max(x[p + 1]) - min(x[p + 1]) AS w FROM results, (SELECT unnest(range(19)) AS p) WHERE cost <= best + 0.5e0 * abs(best) GROUP BY p)) AS spread FROM (SELECT min(cost) AS best, median(cost) AS md, max(cost) AS worst FROM results)"))
def near_best_stats(spark, d):
    return rounded(search.near_best_stats(fx.results(spark, d), 0.5), "best", "median", "worst", "spread")


@query("near_best_delta", fx.sql("SELECT start_idx, seed, cost <= min(cost) OVER (PARTITION BY seed) + 0.2e0 AS near FROM results"))
def near_best_delta(spark, d):
    return search.near_best_delta(fx.results(spark, d), "seed", 0.2).select("start_idx", "seed", "near")


@query("warm_chain_rounds", fx.sql("SELECT round, CASE WHEN count(p) = 0 THEN NULL WHEN count(p) < count(*) THEN 'Infinity'::DOUBLE ELSE round(max(abs(sigma - p) / greatest(abs(p), 0.05e0)), 6) END AS change, coalesce(count(p) = count(*) AND max(abs(sigma - p) / greatest(abs(p), 0.05e0)) <= 0.02e0, false) AS converged FROM (SELECT *, lag(sigma) OVER (PARTITION BY variable, block ORDER BY round) AS p FROM calibration_rounds) GROUP BY round"))
def warm_chain_rounds(spark, d):
    return rounded(search.warm_chain_rounds(fx.calibration_rounds(spark, d), ["variable", "block"], 0.02), "change")


@query("cov_slices", fx.sql("SELECT member, round(c / (a * c - b * b), 6) AS vii, round(a / (a * c - b * b), 6) AS vjj, round(-b / (a * c - b * b), 6) AS vij, round(1 / a, 6) AS naive_i, round(1 / c, 6) AS naive_j FROM (SELECT member, 2e0 + abs(e[1]) AS a, e[2] AS b, 2e0 + abs(e[3]) AS c FROM vectors)"))
def cov_slices(spark, d):
    e = lambda k: F.get("e", F.lit(k))
    p = fx.vectors(spark, d).select("member", (F.abs(e(0)) + 2.0).alias("hii"), e(1).alias("hij"), (F.abs(e(2)) + 2.0).alias("hjj"))
    return rounded(sensitivity.cov_slices(p).drop("hii", "hij", "hjj"), "vii", "vjj", "vij", "naive_i", "naive_j")


SLICES = "sl AS (SELECT CAST(param AS INTEGER) AS param, dir AS direction, CAST(s AS INTEGER) AS step, dir * s * 0.25e0 AS value, (1e0 + sd) * dir * s * 0.25e0 * dir * s * 0.25e0 AS cost FROM (SELECT param, stddev_pop(value) AS sd FROM params GROUP BY param), (SELECT unnest([-1, 1]) AS dir), (SELECT unnest(range(9)) AS s))"


def _slices(spark, d):
    s = fx.params(spark, d).groupBy("param").agg(F.stddev_pop("value").alias("sd"))
    s = s.withColumn("direction", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(8))))
    v = F.col("direction") * F.col("step") * 0.25
    return s.select("param", "direction", "step", v.alias("value"), ((1.0 + F.col("sd")) * v * v).alias("cost"))


CROSS = "cr AS (SELECT param, direction, coalesce(min(v0 + (value - v0) * (-o0) / (o - o0)) FILTER (WHERE step = st), any_value(direction) * 2e0) AS crossing, any_value(st) IS NULL AS open FROM (SELECT *, min(step) FILTER (WHERE o > 0) OVER (PARTITION BY param, direction) AS st FROM (SELECT *, cost - 0.5e0 AS o, lag(value) OVER w AS v0, lag(cost - 0.5e0) OVER w AS o0 FROM sl WINDOW w AS (PARTITION BY param, direction ORDER BY step))) GROUP BY param, direction)"


@query("profile_crossing", fx.sql("SELECT param, direction, round(crossing, 6) AS crossing, open FROM cr", SLICES, CROSS))
def profile_crossing(spark, d):
    return rounded(sensitivity.profile_crossing(_slices(spark, d), 0.5), "crossing")


@query("profile_table", fx.sql("SELECT param, round(0.5e0, 6) AS value, round((max(crossing) FILTER (WHERE direction < 0) + 2e0) / 4e0, 6) AS lo, round((max(crossing) FILTER (WHERE direction > 0) + 2e0) / 4e0, 6) AS hi, bool_or(direction < 0 AND open) AS open_lo, bool_or(direction > 0 AND open) AS open_hi FROM cr GROUP BY param", SLICES, CROSS))
def profile_table(spark, d):
    c = sensitivity.profile_crossing(_slices(spark, d), 0.5)
    ids = c.select("param").distinct()
    out = sensitivity.profile_table(c, ids.withColumn("value", F.lit(0.0)), ids.withColumns({"lo": F.lit(-2.0), "hi": F.lit(2.0)}))
    return rounded(out, "value", "lo", "hi")


RES = "res AS (SELECT variable, block, obs - mean AS r, var AS gp_var, 0.01e0 AS obs_var, 1e0 + feat_idx AS w FROM cost_blocks)"
VB = ["variable", "block"]


def _res(spark, d):
    from .skill_queries import _cost_rows

    return _cost_rows(spark, d).select(*VB, (F.col("obs") - F.col("mean")).alias("r"), F.col("var").alias("gp_var"), F.lit(0.01).alias("obs_var"), (F.col("feat_idx") + 1.0).alias("w"))


@query("sigma_moment", fx.sql("SELECT variable, block, round(greatest(sum(w * (r * r - gp_var - obs_var)) / sum(w), 0e0), 6) AS s2 FROM res GROUP BY ALL", RES))
def sigma_moment(spark, d):
    return rounded(errors.sigma_moment(_res(spark, d), VB), "s2")


# The same estimate by bisection of the slope: the bracket of the best of 25 values, then sixty halvings.
START = """lim AS (SELECT variable, block, greatest(10e0 * max(r * r), 10e0 * max(gp_var + obs_var), 1e-3) AS top FROM res GROUP BY ALL),
pts AS (SELECT variable, block, k, CASE WHEN k = 0 THEN 0e0 ELSE exp(ln(1e-8) + (ln(top) - ln(1e-8)) * (k - 1) / 23e0) END AS s FROM lim, (SELECT unnest(range(25)) AS k)),
bestk AS (SELECT variable, block, min(struct_pack(f := f, k := k)).k AS k FROM (SELECT variable, block, k, sum(w * (TERM)) / sum(w) AS f FROM pts JOIN (SELECT * FROM res) USING (variable, block), LATERAL (SELECT greatest(gp_var + obs_var + s, 1e-6) AS v) GROUP BY ALL) GROUP BY ALL),
halve(variable, block, step, lo, hi) AS (SELECT b.variable, b.block, 0, x.s, y.s FROM bestk b JOIN pts x ON x.variable = b.variable AND x.block = b.block AND x.k = greatest(b.k - 1, 0) JOIN pts y ON y.variable = b.variable AND y.block = b.block AND y.k = least(b.k + 1, 24)
UNION ALL SELECT variable, block, step + 1, CASE WHEN g >= 0 THEN lo ELSE mid END, CASE WHEN g >= 0 THEN mid ELSE hi END FROM (SELECT h.variable, h.block, any_value(step) AS step, any_value(lo) AS lo, any_value(hi) AS hi, any_value((lo + hi) / 2e0) AS mid, sum(w * CASE WHEN gp_var + obs_var + (lo + hi) / 2e0 < 1e-6 THEN 0 ELSE SLOPE END) AS g FROM halve h JOIN res r ON r.variable = h.variable AND r.block = h.block, LATERAL (SELECT greatest(gp_var + obs_var + (lo + hi) / 2e0, 1e-6) AS v) WHERE step < 60 GROUP BY h.variable, h.block)),
ends AS (SELECT variable, block, (lo + hi) / 2e0 AS s FROM halve WHERE step = 60),
mle AS (SELECT variable, block, any_value(s) AS s2, sum(w * (TERM)) / sum(w) AS nll FROM ends JOIN res USING (variable, block), LATERAL (SELECT greatest(gp_var + obs_var + s, 1e-6) AS v) GROUP BY ALL)"""


def _mle_sql(term: str, slope: str) -> str:
    return "WITH RECURSIVE " + fx.sql("SELECT variable, block, round(s2, 6) AS s2, round(nll, 6) AS nll FROM mle", RES, START.replace("TERM", term).replace("SLOPE", slope)).removeprefix("WITH ")


@query("sigma_mle", _mle_sql("0.5e0 * r * r / v + 0.5e0 * ln(2e0 * pi() * v)", "0.5e0 / v - 0.5e0 * r * r / (v * v)"))
def sigma_mle(spark, d):
    return rounded(errors.sigma_mle(_res(spark, d), VB).drop("passes"), "s2", "nll")


@query("sigma_mle_student_t", _mle_sql("0.5e0 * ln(v) + 2.5e0 * ln(1e0 + r * r / (4e0 * v)) - lgamma(2.5e0) + lgamma(2e0) + 0.5e0 * ln(4e0 * pi())", "0.5e0 / v - 2.5e0 * r * r / (v * (4e0 * v + r * r))"))
def sigma_mle_student_t(spark, d):
    return rounded(errors.sigma_mle(_res(spark, d), VB, likelihood="student_t").drop("passes"), "s2", "nll")


@query("sigma_mle_grid", fx.sql("SELECT variable, block, round(min(struct_pack(n := nll, s := s2)).s, 6) AS s2, round(min(nll), 6) AS nll FROM (SELECT variable, block, s2, sum(w * (0.5e0 * r * r / greatest(gp_var + obs_var + s2, 1e-6) + 0.5e0 * ln(2e0 * pi() * greatest(gp_var + obs_var + s2, 1e-6)))) / sum(w) AS nll FROM res, (SELECT unnest(range(21)) * 0.05e0 AS s2) GROUP BY ALL) GROUP BY ALL", RES))
def sigma_mle_grid(spark, d):
    """One pass on 21 given values."""
    r = _res(spark, d)
    grid = r.select(*VB).distinct().select(*VB, F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k")).select(*VB, (F.col("k") * 0.05).alias("s2"))
    return rounded(errors.sigma_grid(r, grid, VB), "s2", "nll")


@query("residual_step", fx.sql("SELECT variable, block, round(sqrt(avg((obs - mean) * (obs - mean))), 6) AS rms_residual, round(sqrt(avg(var)), 6) AS rms_sd, round(avg((obs - mean) * (obs - mean) / ((var + 0.1e0) * 2e0)), 6) AS chi2 FROM cost_blocks GROUP BY ALL"))
def residual_step(spark, d):
    from .skill_queries import _cost_rows

    return rounded(errors.residual_step(_cost_rows(spark, d).withColumn("extra", F.lit(0.1)), VB, dof=4.0), "rms_residual", "rms_sd", "chi2")


@query("residual_step_weighted", fx.sql("SELECT variable, block, round(sqrt(sum(w * (obs - mean) * (obs - mean)) / sum(w)), 6) AS rms_residual, round(sqrt(sum(w * var) / sum(w)), 6) AS rms_sd, round(sum(w * (obs - mean) * (obs - mean) / ((var + 0.1e0) * 2e0)) / sum(w), 6) AS chi2 FROM (SELECT *, 1e0 / (1e0 + feat_idx) AS w FROM cost_blocks) GROUP BY ALL"))
def residual_step_weighted(spark, d):
    """The same with weights of the locations within a block."""
    from .skill_queries import _cost_rows

    rows = _cost_rows(spark, d).withColumns({"extra": F.lit(0.1), "w": 1.0 / (1.0 + F.col("feat_idx"))})
    return rounded(errors.residual_step(rows, VB, dof=4.0), "rms_residual", "rms_sd", "chi2")


@query("sigma_phys_equiv", fx.sql("SELECT variable, round(median(0.3e0 * sd), 6) AS sigma_phys FROM (SELECT variable, feat_idx, stddev_pop(value) AS sd FROM outputs WHERE level = 0 GROUP BY ALL) GROUP BY variable"))
def sigma_phys_equiv(spark, d):
    from zonalis.operators.scaling import fit_standard

    s = fit_standard(_level(spark, d, 0), K)
    return rounded(errors.sigma_phys_equiv(s.select("variable").distinct().withColumn("sigma", F.lit(0.3)), s, ["variable"]), "sigma_phys")


def _calibration(spark, d):
    """The optimum is the candidate of least cost under the current sigmas; residuals are taken there. The global block is fixed."""
    from .skill_queries import _cost_rows

    rows, x = _cost_rows(spark, d), fx.vectors(spark, d).select(F.col("member").alias("cand_id"), F.slice("e", 1, fx.N_PARAMS).alias("x"))

    def optimise(sigma):
        r = rows.join(F.broadcast(sigma), VB).withColumn("var", F.col("var") + F.col("sigma") ** 2)
        c = r.groupBy("cand_id").agg(F.avg((F.col("mean") - F.col("obs")) ** 2 / F.col("var") + F.log("var")).alias("cost"))
        return c.orderBy("cost", "cand_id").limit(1).join(x, "cand_id")

    def residuals(best):
        r = rows.join(F.broadcast(best.select("cand_id")), "cand_id")
        return r.select(*VB, (F.col("obs") - F.col("mean")).alias("r"), F.col("var").alias("gp_var"), F.lit(0.0).alias("obs_var"), F.lit(1.0).alias("w"))

    blocks = settled(rows.select(*VB).distinct())
    return optimise, residuals, blocks.withColumn("sigma", F.lit(0.25)), blocks.where("block = 'global'").withColumn("sigma", F.lit(0.3))


def _rounds_sql(rounds: int) -> list[str]:
    """One group of CTEs for each round; a round after the converged one is empty."""
    out = ["sig0 AS (SELECT DISTINCT variable, block, CASE WHEN block = 'global' THEN 0.3e0 ELSE 0.25e0 END AS sigma FROM cost_blocks)"]
    for n in range(rounds):
        after = f", (SELECT max(x) AS x0 FROM round{n - 1} WHERE NOT converged) WHERE x0 IS NOT NULL" if n else ""
        moved = f"list_max(list_transform(list_zip(x, x0), lambda z: abs(z[1] - z[2])))" if n else "NULL::DOUBLE"
        change = "max(abs(sigma_next - sigma_used) / greatest(abs(sigma_used), 0.1e0)) OVER ()" if n else "NULL::DOUBLE"
        out += [
            f"best{n} AS (SELECT cand_id, cost, e[1:19] AS x FROM (SELECT cand_id, avg((mean - obs) * (mean - obs) / (var + sigma * sigma) + ln(var + sigma * sigma)) AS cost FROM cost_blocks JOIN sig{n} USING (variable, block) GROUP BY cand_id ORDER BY cost, cand_id LIMIT 1) JOIN vectors ON member = cand_id)",
            f"next{n} AS (SELECT variable, block, CASE WHEN block = 'global' THEN 0.3e0 ELSE sqrt(greatest(avg((obs - mean) * (obs - mean) - var), 0)) END AS sigma_next FROM cost_blocks JOIN best{n} USING (cand_id) GROUP BY variable, block)",
            f"raw{n} AS (SELECT {n} AS round, variable, block, s.sigma AS sigma_used, sigma_next, block = 'global' AS fixed, x, cost, {moved} AS dtheta FROM next{n} JOIN sig{n} s USING (variable, block), best{n}{after})",
            f"round{n} AS MATERIALIZED (SELECT *, coalesce(dtheta < 0.02e0 AND dsigma < 0.1e0, false) AS converged FROM (SELECT *, {change} AS dsigma FROM raw{n}))",
            f"sig{n + 1} AS (SELECT variable, block, sigma_next AS sigma FROM round{n})"]
    return [*out, "calib AS (" + " UNION ALL ".join(f"SELECT * FROM round{n}" for n in range(rounds)) + ")"]


CALIB = ("round", *VB, "fixed", "converged")


@query("calibrate_loop", fx.sql("SELECT round, variable, block, fixed, converged, round(sigma_used, 6) AS sigma_used, round(sigma_next, 6) AS sigma_next, round(cost, 6) AS cost, round(dtheta, 6) AS dtheta, round(dsigma, 6) AS dsigma FROM calib", *_rounds_sql(5)))
def calibrate_loop(spark, d):
    """Two rounds, then a second call that goes on from what the first one stored."""
    optimise, residuals, start, fixed = _calibration(spark, d)
    path = scratch(spark)
    for rounds in (2, 5):
        log = errors.calibrate_loop(optimise, residuals, VB, start, fixed, method="moment", rounds=rounds, path=path)
    log = settled(log)
    removed(spark, path)
    return rounded(log.select(*CALIB, "sigma_used", "sigma_next", "cost", "dtheta", "dsigma"), "sigma_used", "sigma_next", "cost", "dtheta", "dsigma")


def _scaled_sql(f: float) -> str:
    return f"SELECT {f!r}e0 AS factor, cost, list_max(d) AS dtheta_max, sqrt(list_sum(list_transform(d, lambda v: v * v)) / 19e0) AS dtheta_rms FROM (SELECT cost, list_transform(list_zip(e[1:19], (SELECT any_value(x) FROM lastr)), lambda z: abs(z[1] - z[2])) AS d FROM (SELECT cand_id, avg((mean - obs) * (mean - obs) / (var + s * s) + ln(var + s * s)) AS cost FROM cost_blocks JOIN (SELECT variable, block, CASE WHEN converged THEN sigma_used ELSE sigma_next END * CASE WHEN fixed THEN 1e0 ELSE {f!r}e0 END AS s FROM lastr) USING (variable, block) GROUP BY cand_id ORDER BY cost, cand_id LIMIT 1) JOIN vectors ON member = cand_id)"


@query("calibrate_sensitivity", fx.sql("SELECT factor, round(cost, 6) AS cost, round(dtheta_max, 6) AS dtheta_max, round(dtheta_rms, 6) AS dtheta_rms FROM (" + " UNION ALL ".join(_scaled_sql(f) for f in (0.5, 2.0)) + ")", *_rounds_sql(5), "lastr AS (SELECT * FROM calib WHERE round = (SELECT max(round) FROM calib))"))
def calibrate_sensitivity(spark, d):
    optimise, residuals, start, fixed = _calibration(spark, d)
    log = errors.calibrate_loop(optimise, residuals, VB, start, fixed, method="moment", rounds=5)
    return rounded(errors.sigma_sensitivity(optimise, log, VB), "cost", "dtheta_max", "dtheta_rms")


@query("calibrate_mle")
def calibrate_mle(spark, d):
    """The same loop with the estimator that is consistent with a Student-t cost."""
    optimise, residuals, start, fixed = _calibration(spark, d)
    log = errors.calibrate_loop(optimise, residuals, VB, start, fixed, rounds=2, likelihood="student_t", tol=1e-6)
    return rounded(log.select(*CALIB, "sigma_used", "sigma_next"), "sigma_used", "sigma_next")


FULL = "good AS (SELECT product, ncol FROM daily GROUP BY ALL HAVING count(value) >= 5)"


@query("footprint_mean", fx.sql("SELECT product, round(sum(value * (1e0 + ncol % 5)) / sum(1e0 + ncol % 5), 6) AS value FROM daily SEMI JOIN good USING (product, ncol) GROUP BY product", FULL))
def footprint_mean(spark, d):
    e = fx.daily(spark, d)
    area = e.select("ncol").distinct().select("ncol", (1.0 + F.col("ncol") % 5).alias("area"))
    return rounded(errors.footprint_mean(e, area, ["product"], n_times=5), "value")


@query("error_propagation", "WITH e AS (SELECT l_partkey AS ncol, month(l_shipdate) AS m, avg(l_tax) AS sigma FROM lineitem GROUP BY ALL), x AS (SELECT m, sum(p_size * sigma) / sum(p_size) AS f, sqrt(sum(p_size * sigma * p_size * sigma)) / sum(p_size) AS i FROM e JOIN part ON ncol = p_partkey GROUP BY m) SELECT round(avg(f), 6) AS correlated, round(sqrt(sum(i * i)) / 12, 6) AS independent FROM x")
def error_propagation(spark, d):
    e = fx.read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("ncol"), F.month("l_shipdate").alias("month")).agg(F.avg("l_tax").alias("sigma"))
    return rounded(errors.error_propagation(e.join(fx.grid(spark, d), "ncol")), "correlated", "independent")


@query("cos_lat_mean", fx.sql("SELECT snapshot, variable, round(sum(value * cos(radians(lat))) / sum(CASE WHEN value IS NOT NULL THEN cos(radians(lat)) END), 6) AS value FROM obs_field JOIN grid USING (ncol) GROUP BY ALL"))
def cos_lat_mean(spark, d):
    return rounded(errors.cos_lat_mean(fx.obs_field(spark, d).join(fx.grid(spark, d), "ncol"), ["snapshot", "variable"]), "value")


@query("obs_error_fraction", fx.sql("SELECT variable, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS scale, round(0.2e0 / stddev_pop(value), 6) AS fraction FROM outputs WHERE level = 0 AND feat_idx = 10 GROUP BY variable"))
def obs_error_fraction(spark, d):
    from zonalis.operators.scaling import fit_standard

    s = fit_standard(_level(spark, d, 0).where("feat_idx = 10"), ["variable"])
    spec = s.select("variable", F.lit(0.2).alias("error"))
    return rounded(errors.obs_error_fraction(spec, s).select("variable", "mean", "scale", "fraction"), "mean", "scale", "fraction")


SCEN = "sc AS (SELECT 's' || cand_id AS scenario, variable, feat_idx, mean AS pred, obs FROM cost_blocks)"


def _scenarios(spark, d):
    from .skill_queries import _cost_rows

    return _cost_rows(spark, d).select(F.concat(F.lit("s"), F.col("cand_id").cast("string")).alias("scenario"), *K, F.col("mean").alias("pred"), "obs")


RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY variable, feat_idx ORDER BY abs(pred - obs), scenario) AS rank, count(*) OVER (PARTITION BY variable, feat_idx) AS n FROM sc)"


@query("closest_to_obs", fx.sql("SELECT scenario, variable, feat_idx, CAST(rank AS INTEGER) AS rank, CASE WHEN rank = 1 THEN 'closest' WHEN rank = n THEN 'furthest' ELSE 'middle' END AS label FROM rk", SCEN, RANKED))
def closest_to_obs(spark, d):
    return compare.closest_to_obs(_scenarios(spark, d), K).select("scenario", *K, "rank", "label")


@query("closest_counts", fx.sql("SELECT variable, scenario, CAST(count(*) FILTER (WHERE rank = 1) AS BIGINT) AS n_closest FROM rk GROUP BY ALL", SCEN, RANKED))
def closest_counts(spark, d):
    return compare.closest_counts(_scenarios(spark, d), ["variable"], ["feat_idx"])


@query("error_extremes", fx.sql("SELECT variable, scenario, round(max(abs(obs - pred)), 6) AS most, round(min(abs(obs - pred)), 6) AS least, round(avg(abs(obs - pred)), 6) AS mean FROM sc GROUP BY ALL", SCEN))
def error_extremes(spark, d):
    return rounded(compare.error_extremes(_scenarios(spark, d), ["variable"]), "most", "least", "mean")


@query("anomaly_to_default", fx.sql("SELECT member, variable, feat_idx, round(value - control, 6) AS anomaly FROM (SELECT member, variable, feat_idx, value, max(value) FILTER (WHERE member = 0) OVER (PARTITION BY variable, feat_idx) AS control FROM outputs WHERE level = 2)"))
def anomaly_to_default(spark, d):
    top = _level(spark, d, 2)
    return rounded(compare.anomaly_to_default(top, top.where("member = 0"), K).select("member", *K, "anomaly"), "anomaly")


@query("param_comparison", fx.sql("SELECT param, round(max(u) FILTER (WHERE member = 0), 6) AS r0_value, round(max(v) FILTER (WHERE member = 0), 6) AS r0_physical, bool_or(u <= 1e-3 OR u >= 1 - 1e-3) FILTER (WHERE member = 0) AS r0_at_bound, round(max(u) FILTER (WHERE member = 1), 6) AS r1_value, round(max(v) FILTER (WHERE member = 1), 6) AS r1_physical, bool_or(u <= 1e-3 OR u >= 1 - 1e-3) FILTER (WHERE member = 1) AS r1_at_bound FROM (SELECT member, param, value AS v, (value - lo) / (hi - lo) AS u FROM params JOIN (SELECT param, min(value) AS lo, max(value) AS hi FROM params GROUP BY param) USING (param)) GROUP BY param"))
def param_comparison(spark, d):
    p = fx.params(spark, d)
    box = p.groupBy("param").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    pts = p.where("member < 2").join(F.broadcast(box), "param").select("param", F.concat(F.lit("r"), F.col("member").cast("string")).alias("run"), ((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("value"), F.col("value").alias("physical"))
    return rounded(compare.param_comparison(pts, ["r0", "r1"]), "r0_value", "r0_physical", "r1_value", "r1_physical")


@query("level_spread_compare", fx.sql("SELECT variable, feat_idx, round(avg(value) FILTER (WHERE level = 0), 6) AS mean_a, round(avg(value) FILTER (WHERE level = 1), 6) AS mean_b, min(value) FILTER (WHERE level = 0) <= max(value) FILTER (WHERE level = 1) AND min(value) FILTER (WHERE level = 1) <= max(value) FILTER (WHERE level = 0) AS overlap FROM outputs GROUP BY ALL"))
def level_spread_compare(spark, d):
    a, b = (zrg.ensemble_spread(_level(spark, d, n), K) for n in (0, 1))
    return rounded(compare.level_spread_compare(a, b, K).select(*K, "mean_a", "mean_b", "overlap"), "mean_a", "mean_b")


@query("calib_param_path", fx.sql("SELECT CAST(member AS INTEGER) AS round, param, round(value, 6) AS value, value - lo <= 1e-3 * (hi - lo) OR hi - value <= 1e-3 * (hi - lo) AS at_bound FROM params JOIN (SELECT param, min(value) AS lo, max(value) AS hi FROM params GROUP BY param) USING (param)"))
def calib_param_path(spark, d):
    p = fx.params(spark, d)
    box = p.groupBy("param").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    r = _x(spark, d).select(F.col("member").cast("int").alias("round"), "x")
    return rounded(compare.calib_param_path(r, box), "value")


# Surrogates: the fits that the tests hold against numpy; here on the first outputs of the top levels.
def _training(spark, d, levels, feats="variable = 0 and feat_idx < 2"):
    x = fx.vectors(spark, d).select("member", F.slice("e", 1, 4).alias("x"))
    rows = fx.outputs(spark, d).where(feats).where(F.col("level").isin(*levels)).where("level > 0 or member % 2 = 0")
    return rows.join(x, "member").select("variable", "feat_idx", "level", "member", "x", F.col("value").alias("y"))


@query("fit_models_gp")
def fit_models_gp(spark, d):
    return surrogate.fit_models(_training(spark, d, [1]), steps=15).drop("model")


@query("fit_models_ar1")
def fit_models_ar1(spark, d):
    return surrogate.fit_models(_training(spark, d, [1, 2]), steps=10).drop("model")


@query("fit_models_nlevel")
def fit_models_nlevel(spark, d):
    low = surrogate.fit_models(_training(spark, d, [1]), steps=8).checkpoint()
    return surrogate.refit_models(_training(spark, d, [1, 2]), low, freeze_lower=True, steps=5).drop("model")


@query("predict_batch")
def predict_batch(spark, d):
    models = surrogate.fit_models(_training(spark, d, [2]), steps=8)
    cand = fx.vectors(spark, d).select(F.col("member").alias("cand_id"), F.slice("e", 1, 4).alias("x"))
    return surrogate.predict_batch(models, cand)


@query("model_hyper_table")
def model_hyper_table(spark, d):
    return surrogate.model_hyper_table(surrogate.fit_models(_training(spark, d, [1, 2]), steps=5))


@query("fit_linear", fx.sql("SELECT o.variable, o.feat_idx, round(regr_slope(o.value, p.value), 6) AS slope, round(regr_intercept(o.value, p.value), 6) AS intercept FROM outputs o JOIN params p USING (member) WHERE o.level = 0 AND p.param = 0 GROUP BY ALL"))
def fit_linear(spark, d):
    t = _level(spark, d, 0).withColumnRenamed("value", "y").join(fx.params(spark, d).where("param = 0").select("member", F.col("value").alias("x")), "member")
    return rounded(surrogate.fit_linear_sums(t), "slope", "intercept")


@query("fit_forest")
def fit_forest(spark, d):
    t = _training(spark, d, [1], "variable = 0 and feat_idx = 0")
    from pyspark.ml.functions import array_to_vector

    return surrogate.fit_forest(t, trees=5, depth=4).transform(t.select("member", "y", array_to_vector("x").alias("features"))).select("member", "y", "prediction")


@query("project_best", fx.sql("SELECT p.variable, p.feat_idx, round(p.mean * s.scale + s.m, 6) AS pred, round(sqrt(var) * s.scale, 6) AS sd, round(obs, 6) AS obs, round(c.value, 6) AS control FROM predictions p JOIN (SELECT variable, feat_idx, avg(value) AS m, stddev_pop(value) AS scale FROM outputs WHERE level = 0 GROUP BY ALL) s USING (variable, feat_idx) JOIN observed USING (variable, feat_idx) JOIN (SELECT variable, feat_idx, value FROM outputs WHERE level = 0 AND member = 1) c USING (variable, feat_idx) WHERE cand_id = (SELECT start_idx FROM results ORDER BY cost, start_idx LIMIT 1)"))
def project_best(spark, d):
    from zonalis.operators.scaling import fit_standard

    best = search.rank_starts(fx.results(spark, d), 1).select(F.col("start_idx").alias("cand_id"))
    s = fit_standard(_level(spark, d, 0), K).withColumnRenamed("mean", "center")
    control = _level(spark, d, 0).where("member = 1").select(*K, F.col("value").alias("control"))
    return rounded(surrogate.project_best(fx.predictions(spark, d), best, s, fx.observed(spark, d), control), "pred", "sd", "obs", "control")


@query("in_sample_skill", fx.sql("SELECT variable, round(1 - sum(sse) / sum(sst), 6) AS r2 FROM (SELECT variable, feat_idx, sum((truth - pred * f.b - f.a) * (truth - pred * f.b - f.a)) AS sse, var_pop(truth) * count(*) AS sst FROM pairs JOIN (SELECT variable, feat_idx, regr_slope(truth, pred) AS b, regr_intercept(truth, pred) AS a FROM pairs GROUP BY ALL) f USING (variable, feat_idx) GROUP BY ALL) GROUP BY variable", PAIRS))
def in_sample_skill(spark, d):
    """A line fitted on all rows, scored on the same rows."""
    from zonalis.operators.metrics import r2_variance_weighted

    p = _pairs(spark, d)
    fit = surrogate.fit_linear_sums(p.select(*K, F.col("pred").alias("x"), F.col("truth").alias("y")))
    p = p.join(F.broadcast(fit), K).withColumn("pred", F.col("pred") * F.col("slope") + F.col("intercept"))
    return rounded(r2_variance_weighted(p, ["variable"], ["feat_idx"]), "r2")


@query("cross_surrogate_eval")
def cross_surrogate_eval(spark, d):
    """The best point of each run, predicted by one common surrogate."""
    best = search.best_per_group(fx.results(spark, d), ["seed"]).select(F.col("start_idx").alias("cand_id"), F.slice("x", 1, 4).alias("x"))
    return surrogate.predict_batch(surrogate.fit_models(_training(spark, d, [2]), steps=5), best)

