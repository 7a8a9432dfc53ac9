"""Skew-t mixtures, one-dimensional bimodality scans, random convolution features and densities."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import kernels as K
from tidewatch.operators.learn import _mapped, _nu, _sums, mixture, moments


def _mills(a: np.ndarray) -> np.ndarray:
    """Normal density over distribution; for a under -8 by its asymptotic series."""
    far = a < -8
    near = np.where(far, 0.0, a)
    cdf = np.maximum(K.normal_cdf(near), 1e-10)
    out = np.exp(-0.5 * near * near) / math.sqrt(2 * math.pi) / cdf
    low = np.where(far, a, -9.0)
    return np.where(far, -low / (1 - 1 / (low * low) + 3 / low**4), out)


def skew_posteriors(x: np.ndarray, state: dict) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(responsibilities, log densities, per component (weights u, first and second moments of the half-normal factor)).

    A row of component j is mu + delta |w| / sqrt(u) + normal / sqrt(u), u a gamma variable of the degrees of freedom.
    """
    n, p = x.shape
    k = len(state["pi"])
    logs, parts = np.empty((n, k)), []
    for j in range(k):
        mu, cov, delta, nu = state["mu"][j], state["cov"][j], state["delta"][j], state["nu"][j]
        omega = cov + np.outer(delta, delta)
        low = np.linalg.cholesky(omega)
        d = x - mu
        z = np.linalg.solve(low, d.T)
        q = (z * z).sum(axis=0)
        inverse_delta = np.linalg.solve(omega, delta)
        m, s2 = d @ inverse_delta, max(1 - float(delta @ inverse_delta), 1e-10)
        scale = np.sqrt((nu + p) / (nu + q))
        a = m / math.sqrt(s2) * scale
        # The skewing factor's t distribution is taken as a normal one of matched scale beyond 30 degrees of freedom.
        df = nu + p
        skew = np.log(np.maximum(K.normal_cdf(a * (1 - 1 / (4 * df)) / np.sqrt(1 + a * a / (2 * df))), 1e-217))
        logs[:, j] = math.log(max(state["pi"][j], 1e-300)) + math.log(2) + math.lgamma((nu + p) / 2) - math.lgamma(nu / 2) - 0.5 * p * math.log(nu * math.pi) - np.log(np.diag(low)).sum() - 0.5 * (nu + p) * np.log1p(q / nu) + np.maximum(skew, -500)
        u = (nu + p) / (nu + q)
        r = _mills(a)
        sd = math.sqrt(s2) / np.sqrt(u)
        first = m + sd * r
        second = m * m + sd * sd + m * sd * r
        parts.append((u, np.maximum(first, 0), np.maximum(second, 1e-10)))
    top = logs.max(axis=1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
    return np.exp(logs - total[:, None]), total, parts


def skew_mixture(df: DataFrame, k: int, column: str = "x", rounds: int = 40, ridge: float = 1e-3, tolerance: float = 1e-4, seed: int = 0) -> tuple[dict, float]:
    """A mixture of skew-t components from a Student-t start; one pass over the rows a round.

    The covariance needs the new mean and skew; as its statistic is a square of them, it is expanded into the pass's sums.
    """
    n, m, c = moments(df, column)
    p = len(m)
    start, _ = mixture(df, k, column, student=True, restarts=1, rounds=15, ridge=ridge, seed=seed)
    state = {**start, "delta": np.full((k, p), 1e-2) * np.sqrt(np.diag(c))}
    last = -math.inf
    for _ in range(rounds):

        def statistics(x: np.ndarray, state: dict = state) -> np.ndarray:
            g, total, parts = skew_posteriors(x, state)
            out = [np.array([total.sum()]), g.sum(axis=0)]
            for j, (u, first, second) in enumerate(parts):
                w = g[:, j] * u
                out += [np.array([w.sum(), (w * first).sum(), (w * second).sum(), (g[:, j] * (np.log(u) - u)).sum()]), w @ x, (w * first) @ x, ((x * w[:, None]).T @ x).ravel()]
            return np.concatenate(out)

        s = _sums(df, column, statistics)
        ll, a, at = s[0], np.maximum(s[1 : k + 1], 1e-10), k + 1
        mu, cov, delta, nu = [], [], [], []
        for j in range(k):
            w, w1, w2, rest = s[at : at + 4]
            sx, sx1 = s[at + 4 : at + 4 + p], s[at + 4 + p : at + 4 + 2 * p]
            xx = s[at + 4 + 2 * p : at + 4 + 2 * p + p * p].reshape(p, p)
            at += 4 + 2 * p + p * p
            bottom = max(w * w2 - w1 * w1, 1e-10)
            d = (w * sx1 - w1 * sx) / bottom
            o = (sx - d * w1) / max(w, 1e-10)
            around = xx - np.outer(sx, o) - np.outer(o, sx) + w * np.outer(o, o)
            cross = np.outer(sx1 - w1 * o, d)
            cov.append((around - cross - cross.T + w2 * np.outer(d, d)) / a[j] + ridge * np.eye(p))
            mu.append(o)
            delta.append(d)
            nu.append(_nu(rest / a[j], p, state["nu"][j]))
        state = {"pi": a / a.sum(), "mu": np.array(mu), "cov": np.array(cov), "delta": np.array(delta), "nu": np.array(nu)}
        if abs(ll - last) <= tolerance * max(1, abs(ll)):
            break
        last = ll
    return state, float(ll)


def assign_skewed(df: DataFrame, state: dict, column: str = "x") -> DataFrame:
    out = df.withColumn("posterior", _mapped(F.col(column), lambda x: skew_posteriors(x, state)[0]))
    return out.withColumn("cluster", (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))


def two_normals(x: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """(BIC of one normal less that of two, the lesser one's weight)."""
    n = len(x)
    one = -0.5 * n * (math.log(2 * math.pi * max(x.var(), 1e-12)) + 1)
    m, s, w = np.quantile(x, [0.25, 0.75]), np.full(2, max(x.std(), 1e-6)), np.full(2, 0.5)
    ll = -math.inf
    for _ in range(rounds):
        logs = np.log(w) - 0.5 * np.log(2 * np.pi * s * s) - 0.5 * ((x[:, None] - m) / s) ** 2
        top = logs.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        g = np.exp(logs - total[:, None])
        w = np.maximum(g.sum(axis=0), 1e-10) / n
        m = (g * x[:, None]).sum(axis=0) / (n * w)
        s = np.sqrt((g * (x[:, None] - m) ** 2).sum(axis=0) / (n * w) + 1e-6)
        if abs(total.sum() - ll) < 1e-8 * abs(ll):
            break
        ll = float(total.sum())
    return (-2 * one + 2 * math.log(n)) - (-2 * ll + 5 * math.log(n)), float(w.min())


def bimodality_scan(df: DataFrame, value: str, order: str, shares: tuple[float, ...] = (1.0, 0.8, 0.6, 0.4), draws: int = 200, seed: int = 0) -> DataFrame:
    """For the highest `share` of a table by `order`: n, dip, its p-value against uniform samples, BIC gain of two normals, lesser weight, and whether two modes are found.

    A share is a task, which holds its two columns; the uniform samples, made where they are used, are dealt out one by one.
    """
    total = df.count()
    sizes = [max(3, round(share * total)) for share in shares]

    def measured(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["i"].iloc[0])
        x = pdf.sort_values([order, value], ascending=False, kind="stable")[value].to_numpy(float)[: sizes[i]]
        gain, least = two_normals(x)
        return pd.DataFrame([(i, shares[i], len(x), K.dip(x), gain, least)], columns=["i", "share", "n", "dip", "gain", "least"])

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = [min(sizes[i], total) for i in b["i"]]
            yield pd.DataFrame({"i": b["i"], "null_dip": [K.dip(K.random(seed, n, d).uniform(size=n)) for n, d in zip(size, b["draw"], strict=True)]})

    spark = df.sparkSession
    each = F.explode(F.array(*[F.lit(i) for i in range(len(shares))])).alias("i")
    own = df.select(F.col(value), F.col(order), each).groupBy("i").applyInPandas(lambda pdf: measured(pdf), "i int, share double, n int, dip double, gain double, least double")
    jobs = len(shares) * draws
    null = spark.range(0, jobs, 1, max(1, min(jobs, 100))).select((F.col("id") % len(shares)).cast("int").alias("i"), F.floor(F.col("id") / len(shares)).cast("int").alias("draw")).mapInPandas(drawn, "i int, null_dip double")
    found = own.join(null.groupBy("i").agg(F.collect_list("null_dip").alias("null_dips")), "i", "left")
    p = (1 + F.coalesce(F.size(F.filter("null_dips", lambda v: v >= F.col("dip"))), F.lit(0))) / (1 + draws)
    two = (F.col("p") < 0.05) & (F.col("gain") > 0) & (F.col("least") >= 0.10) & (F.col("n") >= 50)
    return found.withColumn("p", p).select("share", "n", "dip", "p", "gain", "least", two.alias("bimodal"))


def random_kernels(n: int, length: int, seed: int = 0) -> list[tuple[np.ndarray, float, int]]:
    """(weights, bias, dilation) of random convolution kernels of lengths from 7 to 101 that fit a curve."""
    g, out = K.random(seed, length), []
    for _ in range(n):
        size = int(g.choice([s for s in (7, 9, 11, 25, 51, 101) if s < length]))
        w = g.standard_normal(size)
        out.append((w - w.mean(), float(g.uniform(-1, 1)), int(2 ** g.uniform(0, math.log2((length - 1) / (size - 1))))))
    return out


def convolved(x: Column, length: int, n: int = 100, seed: int = 0) -> Column:
    """Two values for each of n random kernels over curves of one length, ends mirrored: the greatest response, and the share above zero."""
    kernels = random_kernels(n, length, seed)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(series: pd.Series) -> pd.Series:
        m = np.stack(series.to_numpy()).astype(float)
        out = np.empty((len(m), 2 * n))
        for i, (w, bias, step) in enumerate(kernels):
            half = (len(w) - 1) * step // 2
            padded = np.pad(m, ((0, 0), (half, half)), "reflect")
            at = np.arange(padded.shape[1] - (len(w) - 1) * step)[:, None] + np.arange(len(w)) * step
            y = padded[:, at] @ w + bias
            out[:, 2 * i], out[:, 2 * i + 1] = y.max(axis=1), (y > 0).mean(axis=1)
        return pd.Series(list(out), index=series.index)

    return run(x)


def density(df: DataFrame, value: str, by: list[str], grid: list[float]) -> DataFrame:
    """Gaussian kernel density on a small grid with the bandwidth n^(-1/5) * sd, scaled to a greatest value of 1 in each group."""
    from pyspark.sql import Window

    facts = df.groupBy(*by).agg(F.count(value).alias("_n"), F.stddev_samp(value).alias("_s")).withColumn("_h", F.col("_s") * F.pow("_n", F.lit(-0.2)))
    rows = df.join(F.broadcast(facts), by).withColumn("g", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    d = rows.groupBy(*by, "g").agg(F.sum(F.exp(-0.5 * F.pow((F.col("g") - F.col(value)) / F.col("_h"), F.lit(2)))).alias("d"))
    return d.withColumn("density", F.col("d") / F.max("d").over(Window.partitionBy(*by))).drop("d")
