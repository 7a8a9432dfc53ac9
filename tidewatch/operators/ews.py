"""Early-warning signals with matched surrogates, and likelihood detection of a transition."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import kernels as K


def rolled(x: np.ndarray, smoother: str = "gaussian", sigma_part: float = 8, window_part: float = 3, metric: str = "residual") -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(places, variances, lag-1 correlations, takeoff) of trailing windows over a series' residuals, or over its first differences.

    Places run from 0 to 1. The takeoff is where the smoothed min-max series rises fastest.
    """
    n = len(x)
    x = K.minmax(x)
    trend = K.lowess(x) if smoother == "lowess" else K.gaussian(x, max(2, int(n / sigma_part)))
    takeoff = int(np.argmax(np.gradient(trend))) / (n - 1)
    r = np.diff(x) if metric == "difference" else x - trend
    shift = n - len(r)
    w = max(5, int(n / window_part))
    at, var, ac = [], [], []
    for i in range(w, len(r) + 1):
        part = r[i - w : i]
        if part.std() < (1e-12 if metric == "difference" else 1e-10):
            continue
        at.append((i - 1 + shift) / (n - 1))
        var.append(part.var())
        ac.append(K.lag1_halves(part))
    return np.array(at), np.array(var), np.array(ac), takeoff


def trend_before(at: np.ndarray, value: np.ndarray, takeoff: float, least: int = 4) -> float:
    """Kendall's tau of a rolling statistic up to the takeoff; NaN for under `least` windows."""
    if not len(at):
        return math.nan
    pre = at <= max(takeoff, at[0] + 1e-9)
    return K.kendall(value[pre]) if pre.sum() >= least else math.nan


def surrogate(x: np.ndarray, kind: str, rng: np.random.Generator) -> np.ndarray:
    """The smoothed trend with noise of the residuals' size: `iid`, or `ar1` of their lag-1 correlation."""
    n = len(x)
    x = K.minmax(x)
    trend = K.gaussian(x, max(2, n // 8))
    r = x - trend
    noise = rng.standard_normal(n)
    if kind == "ar1":
        phi = float(np.clip(K.lag1(r), 0, 0.95)) if n > 5 else 0.0
        for i in range(1, n):
            noise[i] = phi * noise[i - 1] + noise[i]
    return trend + noise / (noise.std() + 1e-12) * r.std()


def signals(df: DataFrame, surrogates: int = 0, kinds: tuple[str, ...] = ("iid", "ar1"), seed: int = 0, least: int = 12, **how) -> DataFrame:
    """Pre-takeoff trends of each series (series_id, v): tau_var, tau_ac, t_takeoff, and for each kind of surrogate the share of them with a trend as high (p_*) and with a rising one (up_*).

    Draws depend on the seed, the series' id and the surrogate's number only.
    """
    names = [f"{k}_{kind}_{m}" for kind in kinds if surrogates for k in ("p", "up") for m in ("var", "ac")]
    schema = "series_id string, n int, t_takeoff double, tau_var double, tau_ac double" + "".join(f", {c} double" for c in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, v in zip(b["series_id"], b["v"], strict=True):
                x = np.asarray(v, float)
                if len(x) < least or np.ptp(x) <= 0:
                    continue
                at, var, ac, takeoff = rolled(x, **how)
                tau = [trend_before(at, s, takeoff) for s in (var, ac)]
                row = {"series_id": name, "n": len(x), "t_takeoff": takeoff, "tau_var": tau[0], "tau_ac": tau[1]}
                for j, kind in enumerate(kinds if surrogates else ()):
                    null = []
                    for m in range(surrogates):
                        s_at, s_var, s_ac, s_takeoff = rolled(surrogate(x, kind, K.random(seed, zlib.crc32(str(name).encode()), j, m)), **how)
                        null.append([trend_before(s_at, s_var, s_takeoff), trend_before(s_at, s_ac, s_takeoff)])
                    null = np.array(null)
                    for c, m in enumerate(("var", "ac")):
                        known = null[:, c][np.isfinite(null[:, c])]
                        row[f"p_{kind}_{m}"] = float((known >= tau[c]).mean()) if len(known) and np.isfinite(tau[c]) else math.nan
                        row[f"up_{kind}_{m}"] = float((known > 0).mean()) if len(known) else math.nan
                out.append(row)
            yield pd.DataFrame(out, columns=["series_id", "n", "t_takeoff", "tau_var", "tau_ac", *names])

    return df.select(F.col("series_id").cast("string"), "v").mapInPandas(run, schema)


def sensitivity(df: DataFrame, sigma_parts: tuple[float, ...] = (12, 8, 6, 4), window_parts: tuple[float, ...] = (4, 3, 2)) -> DataFrame:
    """Share of series with a rising trend for each smoother and window width: one row a cell, in one pass over the series."""
    cells = [(s, w) for s in (*sigma_parts, "lowess") for w in window_parts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in b["v"]:
                x = np.asarray(v, float)
                if len(x) < 12 or np.ptp(x) <= 0:
                    continue
                for s, w in cells:
                    at, var, ac, takeoff = rolled(x, "lowess" if s == "lowess" else "gaussian", 8 if s == "lowess" else s, w)
                    out.append((str(s), float(w), trend_before(at, var, takeoff), trend_before(at, ac, takeoff)))
            yield pd.DataFrame(out, columns=["smoother", "window", "tau_var", "tau_ac"])

    taus = df.select("v").mapInPandas(run, "smoother string, window double, tau_var double, tau_ac double")
    up = lambda c: F.avg(F.when(~F.isnan(c), (F.col(c) > 0).cast("double")))
    return taus.groupBy("smoother", "window").agg(F.count(F.lit(1)).alias("n"), up("tau_var").alias("up_var"), up("tau_ac").alias("up_ac"))


def approach_to_peak(v: np.ndarray) -> np.ndarray:
    """The part of a series from its first value at half of the peak up to the peak."""
    peak = int(np.argmax(v))
    return v[int(np.argmax(v >= 0.5 * v[peak])) : peak + 1]


# --- likelihoods -------------------------------------------------------------------------------------------------


def _ar(r: np.ndarray, rho: np.ndarray | float, var: np.ndarray | float) -> float:
    e = r[1:] - rho * r[:-1]
    return float(0.5 * (np.log(2 * np.pi * var) + e * e / var).sum()) if np.ndim(var) else float(0.5 * (len(e) * math.log(2 * math.pi * var) + (e * e).sum() / var))


def deviance(x: np.ndarray) -> dict[str, float] | None:
    """Fits of a constant-rate process, of one whose return rate dips at the takeoff, and of one with state-dependent noise to a series' residuals.

    deviance = 2 (nll constant - nll dip); bic_* = 2 nll + parameters * log(n - 1). None for fewer than 12 points or no residual variance.
    """
    n = len(x)
    if n < 12:
        return None
    x = K.minmax(x)
    trend = K.gaussian(x, max(2, n // 8))
    r = x - trend
    sd = float(r.std())
    if sd < 1e-9:
        return None
    r = r / sd
    place = np.abs(np.linspace(0, 1, n) - int(np.argmax(np.gradient(trend))) / (n - 1))[1:]
    dt = 1 / (n - 1)
    state = np.clip(trend * (1 - trend), 1e-3, None)[1:]

    def constant(p: np.ndarray) -> float:
        rho = 0.999 / (1 + math.exp(-min(max(p[0], -50), 50)))
        return _ar(r, rho, math.exp(min(max(p[1], -50), 50)) * (1 - rho * rho))

    def dipping(p: np.ndarray) -> float:
        rate = np.clip(math.exp(min(p[0], 20)) + math.exp(min(p[1], 20)) * place, 1e-4, 60)
        rho = np.exp(-rate * dt)
        return _ar(r, rho, np.maximum(math.exp(min(max(p[2], -50), 50)) * (1 - rho * rho), 1e-12))

    def scaled(p: np.ndarray) -> float:
        rho = 0.999 / (1 + math.exp(-min(max(p[0], -50), 50)))
        return _ar(r, rho, math.exp(min(max(p[1], -50), 50)) * state * (1 - rho * rho))

    def best(f, starts):
        return min(K.nelder_mead(f, np.array(s, float), 600)[1] for s in starts)

    ou = best(constant, [(0, 0), (2, 0), (-2, 0)])
    dip = best(dipping, [(0, 2, 0), (2, 2, 0), (1, 4, 0)])
    mult = best(scaled, [(0, 1), (2, 1), (-2, 1)])
    log_n = math.log(n - 1)
    return {"deviance": 2 * (ou - dip), "bic_ou": 2 * ou + 2 * log_n, "bic_dip": 2 * dip + 3 * log_n, "bic_mult": 2 * mult + 2 * log_n, "sd": sd, "phi": K.lag1(r), "n": n}


def detections(df: DataFrame) -> DataFrame:
    """series_id, n, deviance, phi, sd, the three BICs, and picks_dip (the dipping rate has the least BIC); series without a fit are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [{"series_id": s, **d} for s, v in zip(b["series_id"], b["v"], strict=True) if (d := deviance(np.asarray(v, float)))]
            yield pd.DataFrame(out, columns=["series_id", "n", "deviance", "phi", "sd", "bic_ou", "bic_dip", "bic_mult"])

    found = df.select(F.col("series_id").cast("string"), "v").mapInPandas(run, "series_id string, n int, deviance double, phi double, sd double, bic_ou double, bic_dip double, bic_mult double")
    return found.withColumn("picks_dip", (F.col("bic_dip") < F.col("bic_ou")) & (F.col("bic_dip") < F.col("bic_mult")))


def null_pool(df: DataFrame, draws: int = 1200, seed: int = 0) -> DataFrame:
    """Deviances of AR(1) surrogates of the series: (n, deviance). Series are drawn with replacement by number, each draw seeded by its own number."""
    # As many series as draws at most, the first by a hash, are numbered; a draw takes one of them.
    each = df.select(F.col("series_id").cast("string"), "v").orderBy(F.xxhash64("series_id", F.lit(seed)), "series_id").limit(draws)
    dealt = each.withColumn("k", F.row_number().over(Window.orderBy("series_id")) - 1)
    picks = df.sparkSession.range(draws).select("id", F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(max(each.count(), 1))).alias("k"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, s, v in zip(b["id"], b["series_id"], b["v"], strict=True):
                d = deviance(surrogate(np.asarray(v, float), "ar1", K.random(seed, zlib.crc32(s.encode()), int(i))))
                if d:
                    out.append((d["n"], d["deviance"]))
            yield pd.DataFrame(out, columns=["n", "deviance"])

    return picks.join(dealt, "k").select("id", "series_id", "v").mapInPandas(run, "n int, deviance double")


def p_values(found: DataFrame, pool: DataFrame, near: int = 8, wide: int = 24, least: int = 60) -> DataFrame:
    """(1 + surrogates at least as high) / (1 + surrogates), over surrogates of about the same length: within `near`, or `wide` where those are fewer than `least`."""
    lengths = pool.groupBy(F.col("n").alias("pn"), F.col("deviance").alias("pd")).agg(F.count(F.lit(1)).alias("m"))
    pairs = found.select("series_id", "n", "deviance").join(lengths, F.abs(F.col("n") - F.col("pn")) <= wide, "left")
    close = F.abs(F.col("n") - F.col("pn")) <= near
    hit = F.col("pd") >= F.col("deviance")
    sums = pairs.groupBy("series_id", "n", "deviance").agg(F.sum(F.when(close, F.col("m")).otherwise(0)).alias("m_near"), F.coalesce(F.sum("m"), F.lit(0)).alias("m_wide"), F.sum(F.when(close & hit, F.col("m")).otherwise(0)).alias("h_near"), F.coalesce(F.sum(F.when(hit, F.col("m"))), F.lit(0)).alias("h_wide"))
    narrow = F.col("m_near") >= least
    p: Column = (1 + F.when(narrow, F.col("h_near")).otherwise(F.col("h_wide"))) / (1 + F.when(narrow, F.col("m_near")).otherwise(F.col("m_wide")))
    return sums.select("series_id", "n", "deviance", p.alias("p"))
