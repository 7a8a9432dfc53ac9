"""Labelled ground truth: stochastic normal forms, matched nulls and observation models, one seeded row each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import kernels as K

SADDLE_NODE, TRANSCRITICAL, NULL = 0, 1, 2

Drift = Callable[[float, float, dict], float]
#: Drift of each process: (state, time from 0 to 1, parameters).
DRIFTS: dict[str, Drift] = {
    "saddle_node": lambda x, s, p: p["mu0"] + (p["mu1"] - p["mu0"]) * s + p["a2"] * x * x + p["a3"] * x**3,
    "transcritical": lambda x, s, p: p["mu"] * x - p["a2"] * x * x + p.get("a3", 0.0) * x**3,
    "expsat": lambda x, s, p: p["r"] * (1 - x),
    "ramp": lambda x, s, p: p["c"] if x < 1 else 0.0,
    "partial": lambda x, s, p: p["r"] * (p["x_sat"] - x),
}


def integrate(drift: Drift, x0: float, p: dict, rng: np.random.Generator, n: int = 500, t_end: float = 50.0, sigma: float = 0.02, phi: float = 0.6) -> np.ndarray:
    """Euler-Maruyama steps with AR(1) noise, held within ten of zero."""
    dt = t_end / (n - 1)
    x, noise, out = x0, 0.0, np.empty(n)
    step = rng.standard_normal(n)
    for i in range(n):
        out[i] = x
        noise = phi * noise + step[i]
        x = min(10.0, max(-10.0, x + drift(x, i / (n - 1), p) * dt + sigma * noise * dt**0.5))
    return out


def ar1(rng: np.random.Generator, n: int, phi: float = 0.7) -> np.ndarray:
    """AR(1) noise that starts at 0."""
    e, out = rng.standard_normal(n), np.zeros(n)
    for i in range(1, n):
        out[i] = phi * out[i - 1] + e[i]
    return out


#: Noise-free null curves on t from 0 to 1.
TEMPLATES: dict[str, Callable[[np.ndarray, np.random.Generator], np.ndarray]] = {
    "linear": lambda t, g: t,
    "exponential": lambda t, g: np.expm1(g.uniform(2, 5) * t),
    "ramp_expsat": lambda t, g: 1 - np.exp(-g.uniform(2, 6) * t),
    "sigmoid": lambda t, g: K.logistic(t, g.uniform(6, 15), g.uniform(0.3, 0.7)) ** g.uniform(0.5, 2),
    "logistic": lambda t, g: K.logistic(t, g.uniform(6, 20), g.uniform(0.3, 0.7)),
}


#: Ranges of the parameters, lengths, spans and noise that the processes are drawn from, and when a class's curves may
#: turn. A saddle-node's drive sweeps from -speed * r^2 to r^2; it starts near the branch that ends there, and must reach `ESCAPES`.
SADDLE_NODE_RANGES = {"r": (0.05, 0.35), "a3": (-0.05, 0.05), "speed": (0.3, 5.0), "start": (0.90, 1.10)}
TRANSCRITICAL_RANGES = {"mu": (0.3, 4.0), "a2": (0.8, 2.0), "a3": (-0.5, 0.5), "start": (0.005, 0.05)}
LENGTHS, SPANS, NOISE_MEMORY = (15, 80), (5.0, 20.0), (0.0, 0.9)
NOISE_LEVELS = (0.005, 0.01, 0.02, 0.05, 0.10, 0.15, 0.20)
TURNS = {SADDLE_NODE: (0.50, 1.01), TRANSCRITICAL: (-0.01, 0.65), NULL: (-0.01, 1.01)}
ESCAPES = 4.0


def draw(label: int, kind: str, rng: np.random.Generator, n: int = 500, noise: float = 0.03) -> np.ndarray:
    """One candidate of a class, its raw values: n of a null, whose template `kind` names, and as many as drawn of a process."""
    if label == NULL:
        x = K.minmax(TEMPLATES[kind](np.linspace(0, 1, n), rng))
        e = ar1(rng, n)
        return K.minmax(x + noise * e / (np.abs(e).max() + 1e-12))
    own = {"n": int(rng.integers(*LENGTHS)), "t_end": rng.uniform(*SPANS), "sigma": rng.choice(NOISE_LEVELS), "phi": rng.uniform(*NOISE_MEMORY)}
    p = {k: rng.uniform(*v) for k, v in (SADDLE_NODE_RANGES if label == SADDLE_NODE else TRANSCRITICAL_RANGES).items()}
    if label == TRANSCRITICAL:
        return integrate(DRIFTS["transcritical"], p["start"], p, rng, **own)
    p |= {"mu0": -p["speed"] * p["r"] ** 2, "mu1": p["r"] ** 2, "a2": 1.0}
    return integrate(DRIFTS["saddle_node"], -float(np.sqrt(-p["mu0"])) * p["start"], p, rng, **own)


def turn(u: np.ndarray) -> float:
    """When a curve rises fastest, from 0 to 1."""
    rise = np.diff(u)
    return int(np.argmax(rise)) / len(rise)


def valid(x: np.ndarray, label: int, points: int = 500) -> np.ndarray | None:
    """The curve of raw values x on `points` places, from 0 to 1, or None if it isn't one of its class.

    It must be finite, within ten, move by 0.05 or more, escape if it is a saddle-node, end on a visible plateau unless it is a null, and
    turn when its class does.
    """
    if not np.isfinite(x).all() or np.abs(x).max() > 10 or np.ptp(x) < 0.05 or label == SADDLE_NODE and x.max() < ESCAPES:
        return None
    u = K.resample(K.minmax(x), points)
    if label != NULL and (np.abs(u[-max(3, int(0.15 * points)) :] - u.max()) > 0.05 * u.max()).any():
        return None
    low, high = TURNS[label]
    return K.minmax(u) if low < turn(u) < high else None


def benchmark(spark: SparkSession, n: int, kind: str = "logistic", points: int = 500, seed: int = 0, tries: int = 400) -> DataFrame:
    """n valid series of each class: series_id, label, kind, x (min-max normalised).

    Number i of a class is the first valid one of up to `tries` candidates, each seeded by its class, number and try; where none is
    valid, the job fails, so that no class comes short. Tables do not depend on the number of partitions. kind "mixed" takes the templates in turn.
    """
    kinds = sorted(TEMPLATES) if kind == "mixed" else [kind]
    ids = spark.range(3 * n).select((F.col("id") % 3).cast("int").alias("label"), F.floor(F.col("id") / 3).alias("number"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for label, number in zip(b["label"], b["number"], strict=True):
                own = kinds[int(number) % len(kinds)] if label == NULL else ""
                curves = (valid(draw(int(label), own, K.random(seed, int(label), int(number), i), points), int(label), points) for i in range(tries))
                x = next((x for x in curves if x is not None), None)
                if x is None:
                    raise ValueError(f"no valid curve of class {label} in {tries} tries")
                out.append((f"{label}-{number}", int(label), own, x.tolist()))
            yield pd.DataFrame(out, columns=["series_id", "label", "kind", "x"])

    return ids.mapInPandas(run, "series_id string, label int, kind string, x array<double>")


#: How a curve is seen: (curve, generator) to the observed curve of the same length.
OBSERVATIONS: dict[str, Callable[[np.ndarray, np.random.Generator], np.ndarray]] = {
    "full": lambda x, g: x,
    "points30": lambda x, g: K.resample(x[np.round(np.linspace(0, len(x) - 1, 30)).astype(int)], len(x)),
    "points15": lambda x, g: K.resample(x[np.round(np.linspace(0, len(x) - 1, 15)).astype(int)], len(x)),
    "smoothed": lambda x, g: K.gaussian(x, max(1, len(x) / 8)),
    "noisy": lambda x, g: x + 0.05 * ar1(g, len(x), 0.5),
    "real_like": lambda x, g: K.resample(K.minmax((x + 0.02 * ar1(g, len(x), 0.5))[np.round(np.linspace(0, len(x) - 1, 25)).astype(int)]), len(x)),
}


def observed(df: DataFrame, conditions: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Each curve under each condition: the columns of df with `condition`, x replaced and min-max normalised."""
    import zlib

    names = conditions or list(OBSERVATIONS)
    rows = df.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in names])))
    schema = rows.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["x"] = [K.minmax(OBSERVATIONS[c](np.asarray(x, float), K.random(seed, zlib.crc32(s.encode()), zlib.crc32(c.encode())))).tolist() for s, c, x in zip(b["series_id"], b["condition"], b["x"], strict=True)]
            yield b

    return rows.mapInPandas(run, schema)


def scaling_exponent(spark: SparkSession, mus: list[float], x0: float = 1e-3, dt: float = 0.01, steps: int = 200_000) -> DataFrame:
    """Relaxation time of the noise-free transcritical form to 90 % of its equilibrium, and the slope of its logarithm over log(mu)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for mu in b["mu"]:
                x, i = x0, 0
                while x < 0.9 * mu and i < steps:
                    x, i = x + dt * (mu * x - x * x), i + 1
                out.append((float(mu), i * dt))
            yield pd.DataFrame(out, columns=["mu", "time"])

    times = spark.createDataFrame([(float(m),) for m in mus], "mu double").mapInPandas(run, "mu double, time double")
    return times.withColumn("slope", F.regr_slope(F.ln("time"), F.ln("mu")).over(Window.partitionBy()))


#: Noise levels of the classes, and of the three regimes in which the drive is observed.
NOISE_LEVELS = (0.01, 0.02, 0.05, 0.1)
REGIMES = {"low": (0.01, 0.02), "canonical": NOISE_LEVELS, "marginalised": NOISE_LEVELS}
STAGES = ("stable", "walk", "walk_gated")


def _rises(x: np.ndarray, height: float) -> bool:
    """Rises by 0.3 of the height, ends at 0.7 to 1.6 of it, and ends high in its own range."""
    return bool(np.isfinite(x).all() and x[-1] - x[0] >= 0.3 * height and 0.7 * height <= x[-1] <= 1.6 * height and x[-1] - x.min() >= 0.7 * np.ptp(x))


def twin(kind: str, stage: str, rng: np.random.Generator) -> np.ndarray | None:
    """A null that follows a template under the classes' own noise, or None where it fails its gates.

    stable: pulled back to the template at a constant rate, with the height and rate of a transcritical series; walk: noise adds up;
    walk_gated: a walk that rises as the classes do.
    """
    n, t_end = int(rng.integers(15, 80)), rng.uniform(5, 20)
    shape = K.minmax(TEMPLATES[kind](np.linspace(0, 1, n), rng))
    dt = t_end / (n - 1)
    noise = np.array(ar1(rng, n, rng.uniform(0, 0.9))) * rng.choice(NOISE_LEVELS) * dt**0.5
    if stage == "stable":
        rate = rng.uniform(0.3, 4)
        height = rate / rng.uniform(0.8, 2)
        keep = np.exp(-rate * dt)
    else:
        rate, height, keep = 0.0, 1.0, 1.0
    off = np.zeros(n)
    for i in range(1, n):
        off[i] = keep * off[i - 1] + noise[i]
    x = height * shape + off
    if stage == "walk":
        return x if np.ptp(x) >= 0.05 else None
    if not _rises(x, height):
        return None
    return x if stage == "walk_gated" or (np.abs(x[-max(3, int(0.15 * n)) :] - x.max()) <= 0.05 * abs(x.max())).all() else None


def multiplicative(rng: np.random.Generator, n: int = 100, sigma: float = 0.1) -> np.ndarray:
    """A logistic curve with noise that grows with x (1 - x), held within 0 to 1.3."""
    t = np.linspace(0, 1, n)
    x = K.logistic(t, rng.uniform(6, 20), rng.uniform(0.3, 0.7))
    return np.clip(x + sigma * np.sqrt(x * (1 - x) + 1e-3) * ar1(rng, n), 0, 1.3)


def _bulk(spark: SparkSession, n: int, tries: int, groups: list[str], make: Callable[[str, np.random.Generator], dict | None], schema: str, seed: int) -> DataFrame:
    """The first n candidates that `make` accepts in each group, each seeded by its group and number: (name, number, made columns)."""
    ids = spark.range(len(groups) * n * tries).select((F.col("id") % len(groups)).cast("int").alias("g"), F.floor(F.col("id") / len(groups)).alias("number"))
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for g, number in zip(b["g"], b["number"], strict=True):
                made = make(groups[int(g)], K.random(seed, 977, int(g), int(number)))
                if made is not None:
                    out.append((groups[int(g)], int(number), *[made[c] for c in columns]))
            yield pd.DataFrame(out, columns=["name", "number", *columns])

    made = ids.mapInPandas(run, f"name string, number long, {schema}")
    rank = F.row_number().over(Window.partitionBy("name").orderBy("number"))
    return made.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def null_twins(spark: SparkSession, n: int, kind: str = "logistic", stages: tuple[str, ...] = STAGES, points: int = 500, seed: int = 0, tries: int = 12) -> DataFrame:
    """n nulls of each stage: name, number, x (min-max normalised on `points` places)."""

    def make(stage: str, rng: np.random.Generator) -> dict | None:
        own = sorted(TEMPLATES)[int(rng.integers(len(TEMPLATES)))] if kind == "mixed" else kind
        x = twin(own, stage, rng)
        return None if x is None else {"x": K.resample(K.minmax(x), points).tolist()}

    return _bulk(spark, n, tries, list(stages), make, "x array<double>", seed)


def driven(spark: SparkSession, n: int, regime: str = "canonical", seed: int = 0, tries: int = 12) -> DataFrame:
    """n series of each class with the drive that made them: name (saddle_node, transcritical), number, t, x, mu.

    marginalised: a window of 80 to 100 % of each series, thinned to 10 to 25 observations.
    """

    def make(name: str, rng: np.random.Generator) -> dict | None:
        steps, t_end = int(rng.integers(15, 80)), rng.uniform(5, 20)
        sigma, phi = float(rng.choice(REGIMES[regime])), rng.uniform(0, 0.9)
        if name == "saddle_node":
            p = {"mu0": -rng.uniform(0.3, 1), "mu1": rng.uniform(0.5, 2), "a2": 1.0, "a3": -rng.uniform(0.2, 0.5)}
            mu, x0, height = np.linspace(p["mu0"], p["mu1"], steps), -float(np.sqrt(-p["mu0"])), -p["a2"] / p["a3"]
        else:
            p = {"mu": rng.uniform(0.3, 4), "a2": rng.uniform(0.8, 2)}
            mu, x0, height = np.full(steps, p["mu"]), rng.uniform(0.005, 0.05), p["mu"] / p["a2"]
        x, t = integrate(DRIFTS[name], x0, p, rng, steps, t_end, sigma, phi), np.linspace(0, t_end, steps)
        if np.abs(x).max() > 9 or not _rises(x, height):
            return None
        if regime == "marginalised":
            a, b = int(rng.uniform(0, 0.15) * steps), int(rng.uniform(0.8, 1) * steps)
            if b - a < 10:
                return None
            at = np.unique(np.linspace(a, b - 1, min(b - a, int(rng.integers(10, 26)))).astype(int))
            t, x, mu = t[at], x[at], mu[at]
            if np.ptp(x) < 0.3 * height:
                return None
        return {"t": t.tolist(), "x": x.tolist(), "mu": mu.tolist()}

    return _bulk(spark, n, tries, ["saddle_node", "transcritical"], make, "t array<double>, x array<double>, mu array<double>", seed)


#: Names of what a drive tells: its net change, trend, share below zero, three couplings with the state, and its least value.
DRIVE_FEATURES = ["net_change", "trend", "below_zero", "additive", "multiplicative", "together", "least"]


def drive_features(x: np.ndarray, mu: np.ndarray) -> list[float]:
    """DRIVE_FEATURES of one series; a correlation with a constant side is 0."""
    x, top = K.minmax(x), np.abs(mu).max() + 1e-12
    step, state, drive = np.diff(x), x[:-1], mu[:-1]

    def r(a: np.ndarray, b: np.ndarray) -> float:
        return float(np.corrcoef(a, b)[0, 1]) if a.std() > 1e-12 and b.std() > 1e-12 else 0.0

    return [float((mu[-1] - mu[0]) / top), K.kendall(mu), float((mu < 0).mean()), r(step, drive), r(step, drive * state), r(x, mu), float(mu.min() / top)]


def with_drive_features(df: DataFrame) -> DataFrame:
    """Rows of `driven` as name, number and one vector of drive features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["name", "number"]].copy()
            out["f"] = [drive_features(np.asarray(x, float), np.asarray(m, float)) for x, m in zip(b["x"], b["mu"], strict=True)]
            yield out

    return df.select("name", "number", "x", "mu").mapInPandas(run, "name string, number long, f array<double>")
