"""Surrogates as grouped Spark fits: one regression for each output feature.

Training rows are (variable, feat_idx, level, member, x array<double>, y). A group is one feature,
at most a few thousand members; Spark spreads the features, folds and levels. Models are rows
(variable, feat_idx, model binary) and predictions are made where the models are.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "variable int, feat_idx int, n int, nll double, rho array<double>, variances array<double>, lengths array<double>, noises array<double>, model binary"

#: Rows and columns of matrices that are worked on together.
BLOCK = 512


def _kernel(a: np.ndarray, b: np.ndarray, var: float, length: np.ndarray) -> np.ndarray:
    p, q = a / length, b / length
    d = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * p @ q.T
    return var * np.exp(-0.5 * np.maximum(d, 0))


def _lower_solved(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with low @ x = b, by blocks of rows."""
    x = np.array(b)
    for i in range(0, len(low), BLOCK):
        x[i:i + BLOCK] -= low[i:i + BLOCK, :i] @ x[:i]
        x[i:i + BLOCK] = np.linalg.solve(low[i:i + BLOCK, i:i + BLOCK], x[i:i + BLOCK])
    return x


def _upper_solved(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with low.T @ x = b."""
    x = np.array(b)
    for i in reversed(range(0, len(low), BLOCK)):
        j = i + BLOCK
        x[i:j] -= low[j:, i:j].T @ x[j:]
        x[i:j] = np.linalg.solve(low[i:j, i:j].T, x[i:j])
    return x


def _times_lower(a: np.ndarray, low: np.ndarray) -> np.ndarray:
    """a times the leading square of a lower triangle."""
    out = np.empty_like(a)
    for i in range(0, a.shape[1], BLOCK):
        out[:, i:i + BLOCK] = a[:, i:] @ low[i:a.shape[1], i:i + BLOCK][:, :a.shape[1] - i]
    return out


class Chain:
    """Levels t = 0..T-1 with f_t = rho_{t-1} f_{t-1} + d_t, each d_t a Gaussian process; T = 1 is a plain one.

    Parameters are logs of variance, lengths and noise of each level and the rho of each step.
    """

    def __init__(self, x: list[np.ndarray], y: list[np.ndarray], iso_top: bool = False):
        self.x, self.shift = x, float(np.mean(y[-1]))
        self.y = np.concatenate([v - self.shift for v in y])
        self.level = np.repeat(np.arange(len(x)), [len(v) for v in x])
        self.points, self.iso_top, self.t = np.vstack(x), iso_top, len(x)
        p, spread = self.points.shape[1], max(float(self.y.var()), 1e-6)
        self.var = np.full(self.t, np.log(spread))
        self.var[1:] -= np.log(4.0)
        self.length = np.full((self.t, p), np.log(0.5 * np.sqrt(p)))
        self.noise = np.full(self.t, np.log(spread * 1e-2))
        self.rho = np.ones(self.t - 1)

    def _cov(self, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
        """Products of the rho between two levels times the shared chain below the lower one."""
        out = np.zeros((len(a), len(b)))
        for t in range(self.t):
            i, j = np.flatnonzero(la >= t), np.flatnonzero(lb >= t)
            if len(i) and len(j):
                k = _kernel(a[i], b[j], np.exp(self.var[t]), np.exp(self.length[t]))
                scale = lambda lv: np.array([np.prod(self.rho[t:u]) for u in lv])
                out[np.ix_(i, j)] += k * scale(la[i])[:, None] * scale(lb[j])[None, :]
        return out

    def _solve(self) -> float:
        """The factor of the covariance, made in place by blocks of columns: one square matrix is all that a fit holds."""
        n = len(self.y)
        prior = np.array([sum(np.exp(self.var[s]) * np.prod(self.rho[s:u]) ** 2 for s in range(u + 1)) for u in range(self.t)])[self.level]
        extra = np.exp(self.noise)[self.level] + 1e-10 + 1e-8 * prior.sum() / n
        self.chol = None
        chol = np.zeros((n, n))
        for i in range(0, n, BLOCK):
            j = min(i + BLOCK, n)
            chol[i:, i:j] = self._cov(self.points[i:], self.level[i:], self.points[i:j], self.level[i:j])
            chol[np.arange(i, j), np.arange(i, j)] += extra[i:j]
            for k in range(i, n, BLOCK):
                chol[k:k + BLOCK, i:j] -= chol[k:k + BLOCK, :i] @ chol[i:j, :i].T
            chol[i:j, i:j] = np.linalg.cholesky(chol[i:j, i:j])
            if j < n:
                chol[j:, i:j] = np.linalg.solve(chol[i:j, i:j], chol[j:, i:j].T).T
        self.chol = chol
        self.alpha = _upper_solved(chol, _lower_solved(chol, self.y[:, None]))[:, 0]
        return float(0.5 * self.y @ self.alpha + np.log(np.diag(chol)).sum() + 0.5 * n * np.log(2 * np.pi))

    def _vector(self) -> np.ndarray:
        return np.concatenate([self.var, self.length.ravel(), self.noise, self.rho])

    def _set(self, v: np.ndarray) -> None:
        t, p = self.length.shape
        self.var, self.length = v[:t].copy(), v[t:t + t * p].reshape(t, p).copy()
        self.noise, self.rho = v[t + t * p:2 * t + t * p].copy(), np.clip(v[2 * t + t * p:], 1e-6, 5.0)
        if self.iso_top:
            self.length[-1] = self.length[-1].mean()

    def fit(self, steps: int = 40, frozen: np.ndarray | None = None) -> Chain:
        """Bounded ascent of the marginal likelihood: sign-based steps that grow and shrink by coordinate."""
        v = self._vector()
        free = np.ones(len(v), dtype=bool) if frozen is None else ~frozen
        best, best_v, size = np.inf, v, np.full(len(v), 0.2)
        last = np.zeros(len(v))
        for _ in range(steps):
            self._set(v)
            try:
                value = self._solve()
            except np.linalg.LinAlgError:
                v, size = best_v.copy(), size / 4
                continue
            if value < best:
                best, best_v = value, self._vector()
            g = self._gradient()
            g[~free] = 0
            same = np.sign(g) * np.sign(last)
            size = np.clip(np.where(same > 0, size * 1.2, np.where(same < 0, size * 0.5, size)), 1e-4, 0.5)
            last = np.where(same < 0, 0, g)
            v = self._vector() - np.sign(last) * size
            low, high = self._bounds()
            v = np.clip(v, low, high)
        self._set(best_v)
        self.nll = self._solve()
        return self

    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        t, p = self.length.shape
        s = np.log(max(float(self.y.var()), 1e-6))
        low = np.concatenate([np.full(t, s - 12), np.full(t * p, np.log(0.05)), np.full(t, s - 16), np.full(t - 1, 1e-6)])
        high = np.concatenate([np.full(t, s + 5), np.full(t * p, np.log(50.0)), np.full(t, s + 1), np.full(t - 1, 5.0)])
        return low, high

    def _gradient(self) -> np.ndarray:
        """Exact gradient of the negative log-likelihood in the order of _vector."""
        n, low = len(self.y), self.chol
        self.chol = None  # The factor gives its place to its inverse.
        for i in range(0, n, BLOCK):
            j = min(i + BLOCK, n)
            own = np.linalg.inv(low[i:j, i:j])
            if i:
                low[i:j, :i] = -own @ _times_lower(low[i:j, :i], low)
            low[i:j, i:j] = np.tril(own)
        t, p = self.length.shape
        g_var, g_len, g_noise, g_rho = np.zeros(t), np.zeros((t, p)), np.zeros(t), np.zeros(max(t - 1, 0))
        for i in range(0, n, BLOCK):
            j = min(i + BLOCK, n)
            w = 0.5 * (low[i:, i:j].T @ low[i:, :j] - np.outer(self.alpha[i:j], self.alpha[:j]))
            g_noise += np.bincount(self.level[i:j], np.exp(self.noise)[self.level[i:j]] * w[np.arange(j - i), np.arange(i, j)], t)
            w[:, :i] *= 2  # The other side of the diagonal.
            for s in range(t):
                r, c = np.flatnonzero(self.level[i:j] >= s), np.flatnonzero(self.level[:j] >= s)
                if not len(r):
                    continue
                a, b, la, lb = self.points[i:j][r], self.points[c], self.level[i:j][r], self.level[c]
                scale = np.array([np.prod(self.rho[s:u]) for u in range(t)])
                wk = w[np.ix_(r, c)] * _kernel(a, b, np.exp(self.var[s]), np.exp(self.length[s])) * scale[la][:, None] * scale[lb][None, :]
                g_var[s] += wk.sum()
                for k in range(p):
                    d = (a[:, k][:, None] - b[:, k][None, :]) / np.exp(self.length[s, k])
                    g_len[s, k] += (wk * d * d).sum()
                for u in range(s, t - 1):
                    g_rho[u] += (wk.sum(1) @ (la > u) + wk.sum(0) @ (lb > u)) / self.rho[u]
        if self.iso_top:
            g_len[-1] = g_len[-1].sum() / p
        return np.concatenate([g_var, g_len.ravel(), g_noise, g_rho])

    def predict(self, x: np.ndarray, level: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        lv = np.full(len(x), self.t - 1 if level is None else level)
        k = self._cov(x, lv, self.points, self.level)
        half = _lower_solved(self.chol, k.T)
        prior = sum(np.exp(self.var[s]) * np.prod(self.rho[s:lv[0]]) ** 2 for s in range(lv[0] + 1)) if len(x) else 0.0
        return k @ self.alpha + self.shift, np.maximum(prior - (half * half).sum(0), 1e-12)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, points=self.points, level=self.level, y=self.y, shift=self.shift, var=self.var, length=self.length, noise=self.noise, rho=self.rho, iso=self.iso_top)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Chain:
        z = np.load(io.BytesIO(raw))
        self = cls.__new__(cls)
        self.points, self.level, self.y, self.shift = z["points"], z["level"], z["y"], float(z["shift"])
        self.var, self.length, self.noise, self.rho, self.iso_top = z["var"], z["length"], z["noise"], z["rho"], bool(z["iso"])
        self.t = len(self.var)
        self.nll = self._solve()
        return self


def _fit_group(rows: pd.DataFrame, top_kernel: str, steps: int, earlier: bytes | None = None, freeze: bool = False) -> pd.DataFrame:
    rows = rows[rows["y"].notna()].sort_values(["level", "member"])
    levels = sorted(rows["level"].unique())
    x = [np.array(rows.loc[rows["level"] == v, "x"].tolist(), dtype=float) for v in levels]
    y = [rows.loc[rows["level"] == v, "y"].to_numpy(dtype=float) for v in levels]
    iso = len(levels) > 1 and (top_kernel == "iso" or (top_kernel == "auto" and len(x[-1]) < 3 * x[-1].shape[1]))
    model = Chain(x, y, iso)
    frozen = None
    if earlier is not None:
        old = Chain.load(earlier)
        k = min(old.t, model.t)
        model.var[:k], model.length[:k], model.noise[:k] = old.var[:k], old.length[:k], old.noise[:k]
        model.rho[:max(k - 1, 0)] = old.rho[:max(k - 1, 0)]
        if freeze:
            t, p = model.length.shape
            lower = np.arange(t) < min(k, t - 1)
            frozen = np.concatenate([lower, np.repeat(lower, p), lower, np.arange(t - 1) < k - 1])
    model.fit(steps, frozen)
    return pd.DataFrame({
        "variable": [int(rows["variable"].iloc[0])], "feat_idx": [int(rows["feat_idx"].iloc[0])], "n": [len(model.y)], "nll": [model.nll], "rho": [model.rho.tolist()],
        "variances": [np.exp(model.var).tolist()], "lengths": [np.exp(model.length).ravel().tolist()], "noises": [np.exp(model.noise).tolist()], "model": [model.dump()]})


def _spread(rows: DataFrame) -> DataFrame:
    """Features in tasks of their own: their rows are few bytes and much work, so Spark would put them together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "variable", "feat_idx")


def fit_models(training: DataFrame, top_kernel: str = "auto", steps: int = 40) -> DataFrame:
    """One model for each (variable, feat_idx); one level gives a plain process, more give the chain."""
    return _spread(training).groupBy("variable", "feat_idx").applyInPandas(lambda rows: _fit_group(rows, top_kernel, steps), MODEL)


def refit_models(training: DataFrame, earlier: DataFrame, freeze_lower: bool = False, top_kernel: str = "auto", steps: int = 20) -> DataFrame:
    """Fits that start from earlier models, with the lower levels' parameters frozen on request."""

    def both(rows: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame()
        return _fit_group(rows, top_kernel, steps, bytes(old["model"].iloc[0]) if len(old) else None, freeze_lower)

    return training.groupBy("variable", "feat_idx").cogroup(earlier.groupBy("variable", "feat_idx")).applyInPandas(both, MODEL)


def predict_batch(models: DataFrame, candidates: DataFrame, level: int | None = None, chunk: int = 4096) -> DataFrame:
    """(cand_id, variable, feat_idx, mean, var) for all candidates (cand_id, x) and models.

    Candidates are packed into chunks, and chunks meet models as rows: both sides stay distributed.
    """
    packed = candidates.withColumn("chunk", F.pmod(F.xxhash64("cand_id"), F.lit(1 << 20)))
    n = F.lit(max(1, chunk))
    packed = packed.withColumn("slot", F.floor(F.col("chunk") / n)).groupBy("slot").agg(F.collect_list("cand_id").alias("ids"), F.collect_list("x").alias("xs"))
    both = models.select("variable", "feat_idx", "model").crossJoin(packed)
    # A model is factored once in a task, for all of the task's chunks.
    both = both.repartition(64, "variable", "feat_idx", F.pmod("slot", F.lit(8))).sortWithinPartitions("variable", "feat_idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw_now, model = None, None
        for pdf in batches:
            for v, f, raw, ids, xs in zip(pdf["variable"], pdf["feat_idx"], pdf["model"], pdf["ids"], pdf["xs"], strict=True):
                if raw_now != bytes(raw):
                    raw_now, model = bytes(raw), None
                    model = Chain.load(raw_now)
                x = np.array([np.asarray(x, dtype=float) for x in xs])
                for i in range(0, len(x), BLOCK):
                    mean, var = model.predict(x[i:i + BLOCK], level)
                    yield pd.DataFrame({"cand_id": ids[i:i + BLOCK], "variable": v, "feat_idx": f, "mean": mean, "var": var})

    return both.select("variable", "feat_idx", "model", "ids", "xs").mapInPandas(run, "cand_id bigint, variable int, feat_idx int, mean double, var double")


def model_hyper_table(models: DataFrame) -> DataFrame:
    """Per variable: means of the discrepancy's share of variance, rho, length and noise at the top level."""
    top = F.element_at("variances", -1)
    below = F.when(F.size("rho") > 0, F.element_at("rho", -1) ** 2 * F.element_at("variances", 1)).otherwise(F.lit(0.0))
    rows = models.select("variable", F.try_divide(top, top + below).alias("share"), F.when(F.size("rho") > 0, F.element_at("rho", -1)).alias("rho"),
                         (F.aggregate("lengths", F.lit(0.0), lambda s, v: s + v) / F.size("lengths")).alias("length"), F.element_at("noises", -1).alias("noise"))
    return rows.groupBy("variable").agg(*(f(c).alias(f"{c}_{n}") for c in ("share", "rho", "length", "noise") for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))))


def fit_linear_sums(training: DataFrame) -> DataFrame:
    """(variable, feat_idx, slope, intercept) of the one-parameter form; training: x (a number), y."""
    s = training.groupBy("variable", "feat_idx").agg(F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("v"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    slope = F.try_divide("c", "v")
    return s.select("variable", "feat_idx", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def fit_forest(training: DataFrame, trees: int = 20, depth: int = 6, seed: int = 0):
    """A random forest for one output, by the library's distributed trees; training: (x array<double>, y)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    rows = training.select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def project_best(predictions: DataFrame, best: DataFrame, scaler: DataFrame, obs: DataFrame, default: DataFrame) -> DataFrame:
    """Prediction at the best candidate in physical units, beside observation and control run."""
    p = predictions.join(F.broadcast(best.select("cand_id")), "cand_id").join(F.broadcast(scaler), ["variable", "feat_idx"])
    p = p.select("variable", "feat_idx", (F.col("mean") * F.col("scale") + F.col("center")).alias("pred"), (F.sqrt("var") * F.col("scale")).alias("sd"))
    return p.join(obs, ["variable", "feat_idx"], "left").join(default, ["variable", "feat_idx"], "left")
