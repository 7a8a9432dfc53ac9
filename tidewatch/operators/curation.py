"""Curation: long series through ordered gates into typed curves, rejects with reasons, near-duplicate removal and nested tiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import kernels as K
from tidewatch.operators import windows as W

#: What may be said of a rejected series, in the order of the gates.
REASONS = ["too few observations", "unfilled gap", "rising phase mostly falls", "rising phase too short", "segment too short", "too little variation"]


def gate(df: DataFrame, disruptions: DataFrame, least: int = 10, longest_gap: int = 5, rising: float = 0.40, drop: float = 0.15, decline_rows: int = 5, band: float = 0.05, plateau_rows: int = 3, variation: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) of long series (series_id, t, v with nulls for missing).

    kept: series_id, t, x (min-max normalised), series_type, n_obs, n_filled. A series with a structural decline ends at its peak;
    one with a plateau ends with it; any other keeps all its rows. rejected: series_id and the first gate that it failed. What several
    gates read is persisted, as partitions of whole series, so that each step runs once.
    """
    df = df.persist()
    first = df.groupBy("series_id").agg(F.count("v").alias("known"))
    filled = W.fill_gaps(W.trim_ends(df.where(F.col("t").isNotNull())), longest_gap)
    rows = W.indexed(filled).withColumn("peak", F.max("v").over(W.series())).withColumn("at", W.first_peak()).withColumn("_d", F.col("v") - F.lag("v").over(W.ordered())).persist()
    facts = rows.groupBy("series_id").agg(F.count_if(F.col("v").isNull()).alias("holes"), F.max("at").alias("at"), F.avg(F.when((F.col("i") <= F.col("at")) & (F.col("i") > 0), (F.col("_d") >= 0).cast("double"))).alias("up"), F.count_if("filled").alias("n_filled"))
    whole = rows.join(facts.where(F.col("holes") == 0).select("series_id"), "series_id", "left_semi").select("series_id", "t", "v").persist()
    fall = W.structural_declines(whole, disruptions, drop, decline_rows).select("series_id", F.lit(True).alias("falls"))
    # The plateau's run is counted from the peak on, so its last place is that of the peak plus first_i + n - 1.
    flat = W.saturation_runs(whole, band, plateau_rows).select("series_id", (F.col("first_i") + F.col("n") - 1).alias("flat_end"))
    typed = rows.join(fall, "series_id", "left").join(flat, "series_id", "left")
    kind = F.when(F.col("falls"), "declining_structural").when(F.col("flat_end").isNotNull(), "saturating").otherwise("pre_saturation")
    end = F.when(F.col("falls"), F.col("at")).when(F.col("flat_end").isNotNull(), F.col("at") + F.col("flat_end")).otherwise(F.col("n") - 1)
    final = typed.withColumn("series_type", kind).withColumn("_end", end).where(F.col("i") <= F.col("_end"))
    scaled = W.minmax(final).persist()
    sizes = scaled.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_obs"), (F.max("x") - F.min("x")).alias("spread"))
    facts = first.join(facts, "series_id", "left").join(sizes, "series_id", "left")
    reason = (
        F.when((F.col("known") < least), REASONS[0])
        .when(F.coalesce("holes", F.lit(1)) > 0, REASONS[1])
        .when(F.col("up") < rising, REASONS[2])
        .when(F.col("at") + 1 < least, REASONS[3])
        .when(F.col("n_obs") < least, REASONS[4])
        .when(F.col("spread") < variation, REASONS[5])
    )
    judged = facts.withColumn("reason", reason).persist()
    ok = judged.where(F.col("reason").isNull()).select("series_id", "n_obs", "n_filled")
    return scaled.join(ok, "series_id").select("series_id", "t", "x", "series_type", "n_obs", "n_filled"), judged.where(F.col("reason").isNotNull()).select("series_id", "reason")


def drop_near_copies(df: DataFrame, by: list[str], order: str = "ord", least: float = 0.9999) -> DataFrame:
    """Of series whose curves x correlate by `least` or more within a group, the first by `order`; a dropped one drops no other.

    Flat curves are copies of each other if they are equal; curves of different lengths are none. A group's rows stream through one task,
    in order; it holds the curves that it has kept, and compares a batch with all of them at once.
    """

    def grouped(b: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
        for key, part in b.groupby(by, dropna=False, sort=False):
            yield tuple(None if pd.isna(v) else v for v in (key if isinstance(key, tuple) else (key,))), part

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, {}
        for b in batches:
            for key, part in grouped(b):
                if key != now:
                    now, kept = key, {}
                for low in range(0, len(part), 1024):
                    yield _first_of_copies(part[low : low + 1024], kept, least)

    return df.repartition(*by).sortWithinPartitions(*by, order).mapInPandas(run, df.schema)


class _Kept:
    """Curves of one length that were kept: as they are, and centred, of norm 1; each in a table that doubles when it is full."""

    def __init__(self, width: int):
        self.n, self.curves, self.units, self.flat = 0, np.zeros((64, width)), np.zeros((64, width)), np.zeros(64, bool)

    def add(self, x: np.ndarray, unit: np.ndarray, flat: bool) -> None:
        if self.n == len(self.flat):
            self.curves, self.units, self.flat = (np.concatenate([v, np.zeros_like(v)]) for v in (self.curves, self.units, self.flat))
        self.curves[self.n], self.units[self.n], self.flat[self.n] = x, unit, flat
        self.n += 1


def _first_of_copies(part: pd.DataFrame, kept: dict[int, _Kept], least: float) -> pd.DataFrame:
    """The rows of part, in order, that are copies of no kept curve and of none before them in part; they are added to kept, by length."""
    keep = np.zeros(len(part), bool)
    curves = [np.asarray(x, float) for x in part["x"]]
    sizes = np.array([x.size for x in curves])
    for width in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == width)
        before = kept.setdefault(width, _Kept(width))
        x = np.stack([curves[i].ravel() for i in own])
        sd = x.std(axis=1) if width else np.zeros(len(own))
        flat = sd < 1e-12
        z = x - x.mean(axis=1, keepdims=True) if width else x
        z = z / np.where(flat, 1, np.sqrt((z * z).sum(axis=1)))[:, None]

        def same(i: int, y: np.ndarray, near: bool) -> bool:
            return bool(np.allclose(x[i], y)) if near else bool(np.corrcoef(x[i], y)[0, 1] >= least)  # noqa: B023

        # Within rounding of the bound, and for flat curves, pairs are compared as such.
        first = before.n
        found = z @ before.units[:first].T
        with_flat = np.flatnonzero(before.flat[:first])
        found[:, with_flat] = -2
        settled = ((found >= least + 1e-9) & ~flat[:, None]).any(axis=1)
        for i, at in enumerate(own.tolist()):
            if settled[i]:
                continue
            r = np.concatenate([found[i], before.units[first : before.n] @ z[i]])
            if flat[i]:
                copy = any(same(i, y, True) for y in before.curves[: before.n])
            else:
                apart = before.flat[: before.n]
                copy = bool((r[~apart] >= least + 1e-9).any()) or any(same(i, before.curves[j], False) for j in np.flatnonzero(~apart & (np.abs(r - least) < 1e-9))) or any(same(i, before.curves[j], True) for j in np.flatnonzero(apart))
            if not copy:
                keep[at] = True
                before.add(x[i], z[i], bool(flat[i]))
    return part[keep]


def shape_scores(df: DataFrame, low: tuple[float, float] = (0.5, 0.0), high: tuple[float, float] = (80.0, 1.0)) -> DataFrame:
    """series_id, r2_logistic, r2_linear, s_score (their difference; 0 where no logistic fits), rise, residual: of arrays v."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s, v in zip(b["series_id"], b["v"], strict=True):
                x = np.asarray(v, float)
                if len(x) < 6 or np.ptp(x) <= 0:
                    continue
                x = K.minmax(x, 0)
                t = np.linspace(0, 1, len(x))
                total = float(((x - x.mean()) ** 2).sum()) + 1e-12
                line = float(1 - ((x - np.polyval(np.polyfit(t, x, 1), t)) ** 2).sum() / total)
                p = K.fit_logistic(t, x, (10.0, float(t[int(np.argmax(x >= 0.5))])), low, high)
                curve = float(1 - ((x - K.logistic(t, *p)) ** 2).sum() / total) if p else line
                rest = x - K.gaussian(x, max(3, len(x) // 8))
                n10 = max(1, len(x) // 10)
                out.append((s, curve, line, curve - line, float(x[-n10:].mean() - x[:n10].mean()), float(rest.var() / (x.var() + 1e-10))))
            yield pd.DataFrame(out, columns=["series_id", "r2_logistic", "r2_linear", "s_score", "rise", "residual"])

    return df.select("series_id", "v").mapInPandas(run, "series_id string, r2_logistic double, r2_linear double, s_score double, rise double, residual double")


def no_transition(scores: DataFrame) -> DataFrame:
    """Add c1 (rise under 0.5), c2 (no s-shape; true where unknown), c3 (residual over 0.5), headline (c1 or c3) and strict (c1 and c3)."""
    c1, c2, c3 = F.col("rise") < 0.5, ~F.coalesce(F.col("s_score") > 0, F.lit(False)), F.col("residual") > 0.5
    return scores.withColumns({"c1": c1, "c2": c2, "c3": c3, "headline": c1 | c3, "strict": c1 & c3})


def tiers(df: DataFrame, rules: dict[str, tuple[str | None, Column]], key: str = "series_id") -> DataFrame:
    """Nested tiers: (tier, key). rules: tier -> (the tier it narrows, or None for all, and a condition)."""
    conditions: dict[str, Column] = {}
    for name, (above, rule) in rules.items():
        conditions[name] = rule if above is None else conditions[above] & rule
    member = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(member).alias("tier")).select("tier", key)


def rank_cap(df: DataFrame, base: str, score: str, key: str, most: int = 10) -> DataFrame:
    """Up to `most` rows by score: first one of each base, then a second one of each."""
    w = Window.partitionBy(base).orderBy(F.desc(score), key)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= 2).orderBy("turn", F.desc(score), key).limit(most)
