"""Growth rates and curve gates of long series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.windows import as_of, crossing, first_peak, indexed, series


def geometric_growth(df: DataFrame, base: float = 0.10, shortest: float = 2.0) -> DataFrame:
    """Compound growth to the peak, percent a step of t, from the crossing of base * peak, or from the first row if that is over it already."""
    rows = indexed(df).withColumn("_at", first_peak()).withColumn("_peak", F.max("v").over(series()))
    ends = rows.groupBy("series_id").agg(F.min_by("t", "i").alias("t_first"), F.min_by("v", "i").alias("v_first"), F.max("_peak").alias("peak"), F.min(F.when(F.col("i") == F.col("_at"), F.col("t"))).alias("t_peak"))
    hit = crossing(rows.where(F.col("i") <= F.col("_at")).select("series_id", "t", "v"), base * F.max("v").over(series()))
    joined = ends.join(hit, "series_id", "left")
    early = F.col("v_first") >= base * F.col("peak")
    start = F.when(early, F.col("t_first").cast("double")).otherwise(F.coalesce("t_cross", F.col("t_peak").cast("double")))
    ratio = F.when(early, F.col("peak") / F.greatest("v_first", F.lit(1e-12))).otherwise(1 / base)
    rate = (F.pow(ratio, 1 / F.greatest(F.col("t_peak") - start, F.lit(shortest))) - 1) * 100
    return joined.select("series_id", "t_peak", start.alias("t_start"), rate.alias("growth"))


def peak_growth(df: DataFrame, width: int = 3, floor: float = 0.10, shortest: int = 2) -> DataFrame:
    """Fastest compound growth over windows of up to `width` steps that begin above floor of the range; null if none does."""
    low, high = F.min("v").over(series()), F.max("v").over(series())
    rows = as_of(df, width).withColumn("_low", low).withColumn("_high", high)
    span = F.col("t") - F.col("t0")
    ok = (span >= shortest) & (F.col("v0") >= F.col("_low") + floor * (F.col("_high") - F.col("_low"))) & (F.col("v0") > 0) & (F.col("_high") > F.col("_low"))
    rate = F.when(ok, (F.pow(F.try_divide(F.col("v"), F.col("v0")), 1 / F.greatest(span, F.lit(1))) - 1) * 100)
    return rows.withColumn("_r", rate).groupBy("series_id").agg(F.max("_r").alias("peak_growth"))


def diffusion_time(df: DataFrame, low: float = 0.10, high: float = 0.90, shortest: float = 2.0) -> DataFrame:
    """Steps of t between the interpolated crossings of low and high of the range, `shortest` at least; the last t where one isn't crossed."""
    least, span = F.min("v").over(series()), F.max("v").over(series()) - F.min("v").over(series())
    end = df.groupBy("series_id").agg(F.max("t").cast("double").alias("_end"))
    a, b = (crossing(df, least + part * span).withColumnRenamed("t_cross", name) for part, name in ((low, "_a"), (high, "_b")))
    both = end.join(a, "series_id", "left").join(b, "series_id", "left")
    return both.select("series_id", F.greatest(F.coalesce("_b", "_end") - F.coalesce("_a", "_end"), F.lit(shortest)).alias("dt"))


def compound_rate(df: DataFrame) -> DataFrame:
    """Compound rate between the first and the last row, percent."""
    ends = df.groupBy("series_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by("v", "t").alias("v0"), F.max_by("v", "t").alias("v1"))
    return ends.select("series_id", (100 * (F.pow(F.try_divide(F.col("v1"), F.col("v0")), F.try_divide(F.lit(1.0), F.col("t1") - F.col("t0"))) - 1)).alias("cagr"))


def niche_gate(df: DataFrame, peaks: DataFrame, group: str, least: float = 0.01) -> DataFrame:
    """Drop series whose peak is under `least` of the greatest peak of their group; series without a known peak stay.

    peaks: (series_id, group column, peak).
    """
    leaders = peaks.groupBy(group).agg(F.max("peak").alias("_leader"))
    known = peaks.join(leaders, group, "left")
    small = known.where((F.col("_leader") > 0) & (F.col("peak") < least * F.col("_leader"))).select("series_id")
    return df.join(small, "series_id", "left_anti")


def cumulative_by_status(df: DataFrame, statuses: list[str], horizon: int, status: Column | None = None) -> DataFrame:
    """Running sum of v over a dense axis of t, from each series' first t to the horizon, of rows in the given statuses. df: series_id, t, v, status."""
    status = F.col("status") if status is None else status
    yearly = df.where(status.isin(*statuses) & (F.col("t") <= horizon)).groupBy("series_id", "t").agg(F.sum("v").alias("v"))
    axis = yearly.groupBy("series_id").agg(F.min("t").alias("a")).select("series_id", F.explode(F.sequence("a", F.lit(horizon))).alias("t"))
    total = F.sum(F.coalesce("v", F.lit(0))).over(Window.partitionBy("series_id").orderBy("t"))
    return axis.join(yearly, ["series_id", "t"], "left").select("series_id", "t", total.cast("double").alias("v"))


def shape_class(df: DataFrame) -> DataFrame:
    """Truncated-start if the first value is over 0.35 of the maximum; else Bell if the last is under 0.70 and the peak before 80 % of the rows; else kept."""
    rows = indexed(df).withColumn("_at", first_peak())
    ends = rows.groupBy("series_id").agg(F.min_by("v", "i").alias("a"), F.max_by("v", "i").alias("b"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(F.col("_at") / F.col("n")).alias("p"))
    start, end = (F.try_divide(F.col(c), F.col("hi")) for c in ("a", "b"))
    return ends.select("series_id", F.when(start > 0.35, "Truncated-start").when((end < 0.70) & (F.col("p") < 0.80), "Bell/Declining").otherwise("kept").alias("shape"))
