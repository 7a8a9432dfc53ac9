"""Scaling, projection, clustering and mixtures of feature rows, as sums over the rows and small solves on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import kernels as K

VECTOR = T.ArrayType(T.DoubleType())


def _sums(df: DataFrame, column: str, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of f of their matrix: each batch is summed on its executor, the batches' sums as an aggregate, by place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                part = np.asarray(f(np.stack(b[column].to_numpy()).astype(float)), float).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "s": total})

    rows = df.select(column).mapInPandas(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return np.array([r["s"] for r in rows])


def moments(df: DataFrame, column: str = "x") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and population covariance."""
    p = len(df.first()[column])
    s = _sums(df, column, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()]))
    n, m = s[0], s[1 : p + 1] / s[0]
    return int(n), m, s[p + 1 :].reshape(p, p) / n - np.outer(m, m)


def _mapped(x: Column, f: Callable[[np.ndarray], np.ndarray], kind: T.DataType = VECTOR) -> Column:
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        out = f(np.stack(s.to_numpy()).astype(float)) if len(s) else np.zeros((0, 1))
        return pd.Series(list(out), index=s.index)

    return run(x)


def standardise(df: DataFrame, column: str = "x", reference: Column | None = None, eps: float = 0.0) -> DataFrame:
    """Rows less the mean, over the population sd, both of the reference rows (default: all); a constant column is divided by 1."""
    _, m, c = moments(df if reference is None else df.where(reference), column)
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    sd = sd + eps if eps else np.where(sd < 1e-12, 1, sd)
    return df.withColumn(column, _mapped(F.col(column), lambda x: (x - m) / sd))


def principal_components(df: DataFrame, column: str = "x", k: int | None = None, whiten: bool = False, reference: Column | None = None, positive: list[int] | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(df with `pc`, axes as rows, shares of the variance). The frame is the reference rows'.

    Signs: the loading of column positive[i] is made positive on axis i; on other axes the loading of largest size is.
    """
    n, m, c = moments(df if reference is None else df.where(reference), column)
    values, vectors = np.linalg.eigh(c * n / max(n - 1, 1))
    order = np.argsort(-values)[: k or len(values)]
    axes, kept = vectors[:, order].T, np.maximum(values[order], 0)
    for i, a in enumerate(axes):
        j = positive[i] if positive and i < len(positive) else int(np.argmax(np.abs(a)))
        if a[j] < 0:
            axes[i] = -a
    scale = np.sqrt(np.maximum(kept, 1e-12)) if whiten else np.ones(len(order))
    return df.withColumn("pc", _mapped(F.col(column), lambda x: (x - m) @ axes.T / scale)), axes, kept / max(values.sum(), 1e-300)


def dimensions_for(shares: np.ndarray, part: float = 0.90) -> int:
    return int(np.searchsorted(np.cumsum(shares), part - 1e-12) + 1)


def k_means(df: DataFrame, k: int, column: str = "x", restarts: int = 4, seed: int = 0) -> DataFrame:
    """df with `cluster`; the restart of least within-cluster squares."""
    rows = df.withColumn("_v", array_to_vector(F.col(column).cast(VECTOR)))
    models = [KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="cluster").fit(rows) for i in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).drop("_v")


def posteriors(x: np.ndarray, state: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(responsibilities, log density of each row, Mahalanobis squares) under a mixture of normal or Student-t components."""
    n, p = x.shape
    logs, squares = np.empty((n, len(state["pi"]))), np.empty((n, len(state["pi"])))
    for j, (w, m, c) in enumerate(zip(state["pi"], state["mu"], state["cov"], strict=True)):
        low = np.linalg.cholesky(c)
        q = np.linalg.solve(low, (x - m).T)
        squares[:, j] = (q * q).sum(axis=0)
        half = np.log(np.diag(low)).sum()
        nu = state["nu"][j]
        if math.isinf(nu):
            logs[:, j] = -0.5 * (p * math.log(2 * math.pi) + squares[:, j]) - half
        else:
            logs[:, j] = math.lgamma((nu + p) / 2) - math.lgamma(nu / 2) - 0.5 * p * math.log(nu * math.pi) - half - 0.5 * (nu + p) * np.log1p(squares[:, j] / nu)
        logs[:, j] += math.log(max(w, 1e-300))
    top = logs.max(axis=1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
    return np.exp(logs - total[:, None]), total, squares


def _nu(rest: float, p: int, nu: float) -> float:
    """Root in [0.5, 200] of the degrees-of-freedom equation."""

    def f(v: float) -> float:
        d = K.digamma(np.array([v / 2, (nu + p) / 2]))
        return float(-d[0] + math.log(v / 2) + 1 + rest + d[1] - math.log((nu + p) / 2))

    a, b = 0.5, 200.0
    if f(a) * f(b) > 0:
        return b if f(b) > 0 else a
    for _ in range(60):
        m = (a + b) / 2
        a, b = (m, b) if f(m) > 0 else (a, m)
    return (a + b) / 2


def mixture(df: DataFrame, k: int, column: str = "x", student: bool = False, prior: dict | None = None, restarts: int = 3, rounds: int = 60, ridge: float = 1e-3, tolerance: float = 1e-4, seed: int = 0) -> tuple[dict, float]:
    """The mixture of highest likelihood of some restarts, and that log likelihood.

    Each round adds up the rows' sufficient statistics on the executors and solves for the components on the driver; rows stay where
    they are. student: t components, each with its own degrees of freedom. prior: {"mu": (k, p), "beta", "nu", "psi": (p, p),
    "alpha"}, with which the components are the most probable ones given the prior.
    """
    n, m, c = moments(df, column)
    p = len(m)
    start = df.select(column).orderBy(F.xxhash64(F.col(column), F.lit(seed))).limit(200 * k).toPandas()[column]
    sample = np.stack(start.to_numpy()).astype(float)
    best: tuple[dict, float] | None = None
    for r in range(1 if prior else restarts):
        rng = np.random.default_rng(seed + r)
        if prior:
            mu = np.array(prior["mu"], float)
        else:
            mu = [sample[rng.integers(len(sample))]]
            while len(mu) < k:
                d = np.min([((sample - q) ** 2).sum(axis=1) for q in mu], axis=0)
                mu.append(sample[rng.choice(len(sample), p=d / d.sum())] if d.sum() > 0 else sample[rng.integers(len(sample))])
            mu = np.array(mu)
        state = {"pi": np.full(k, 1 / k), "mu": mu, "cov": np.array([c / k + ridge * np.eye(p)] * k), "nu": np.full(k, 30.0 if student else math.inf)}
        last = -math.inf
        for _ in range(rounds):

            def statistics(x: np.ndarray, state: dict = state) -> np.ndarray:
                g, total, squares = posteriors(x, state)
                u = np.ones_like(g)
                for j, nu in enumerate(state["nu"]):
                    if not math.isinf(nu):
                        u[:, j] = (nu + p) / (nu + squares[:, j])
                w = g * u
                second = np.stack([(x * w[:, [j]]).T @ x for j in range(k)])
                return np.concatenate([[total.sum()], g.sum(axis=0), w.sum(axis=0), (g * (np.log(u) - u)).sum(axis=0), (w.T @ x).ravel(), second.ravel()])

            s = _sums(df, column, statistics)
            ll, a, w, rest = s[0], s[1 : k + 1], s[k + 1 : 2 * k + 1], s[2 * k + 1 : 3 * k + 1]
            first, second = s[3 * k + 1 : 3 * k + 1 + k * p].reshape(k, p), s[3 * k + 1 + k * p :].reshape(k, p, p)
            a_safe, w_safe = np.maximum(a, 1e-10), np.maximum(w, 1e-10)
            if prior:
                beta, nu0, psi, alpha = prior["beta"], prior["nu"], np.array(prior["psi"], float), prior["alpha"]
                mu = (first + beta * np.array(prior["mu"])) / (w_safe + beta)[:, None]
                cov = []
                for j in range(k):
                    d = mu[j] - np.array(prior["mu"][j])
                    centred = second[j] - np.outer(first[j], mu[j]) - np.outer(mu[j], first[j]) + w[j] * np.outer(mu[j], mu[j])
                    cov.append((psi + centred + beta * np.outer(d, d)) / (a_safe[j] + nu0 + p + 2) + 1e-9 * np.eye(p))
                pi = (a + alpha - 1 + 1e-12) / (n + k * (alpha - 1) + k * 1e-12)
            else:
                mu = first / w_safe[:, None]
                cov = [(second[j] - np.outer(first[j], mu[j]) - np.outer(mu[j], first[j]) + w[j] * np.outer(mu[j], mu[j])) / a_safe[j] + ridge * np.eye(p) for j in range(k)]
                pi = a_safe / a_safe.sum()
            nu = np.array([_nu(rest[j] / a_safe[j], p, state["nu"][j]) for j in range(k)]) if student else state["nu"]
            state = {"pi": pi, "mu": mu, "cov": np.array(cov), "nu": nu}
            if abs(ll - last) <= tolerance * max(1, abs(ll)):
                last = ll
                break
            last = ll
        if best is None or last > best[1]:
            best = state, float(last)
    return best


def assign(df: DataFrame, state: dict, column: str = "x") -> DataFrame:
    """df with `posterior` (sums to 1) and `cluster` (its first greatest place)."""
    out = df.withColumn("posterior", _mapped(F.col(column), lambda x: posteriors(x, state)[0]))
    return out.withColumn("cluster", (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))


def out_of_distribution(df: DataFrame, reference: DataFrame, column: str = "x", part: float = 0.99) -> DataFrame:
    """df with `distance` (Mahalanobis under the reference rows' shrunk covariance) and `outside` (beyond the reference's `part` quantile).

    Shrinkage toward the mean variance, with the weight that Ledoit and Wolf give, from sums over the rows.
    """
    n, m, c = moments(reference, column)
    p = len(m)
    fourth = _sums(reference, column, lambda x: np.array([(((x - m) ** 2).sum(axis=1) ** 2).sum()]))[0] / n
    target = np.trace(c) / p
    d2 = ((c - target * np.eye(p)) ** 2).sum() / p
    b2 = min((fourth - (c * c).sum()) / n / p, d2)
    shrink = b2 / d2 if d2 > 0 else 0.0
    inverse = np.linalg.inv((1 - shrink) * c + shrink * target * np.eye(p))
    distance = lambda x: np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x - m, inverse, x - m), 0))
    far = reference.select(_mapped(F.col(column), distance, T.DoubleType()).alias("d")).agg(F.percentile("d", F.lit(part))).first()[0]
    return df.withColumn("distance", _mapped(F.col(column), distance, T.DoubleType())).withColumn("outside", F.col("distance") > far)
