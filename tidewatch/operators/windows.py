"""Sequence operators on long series (series_id, t, v): each series is a window partition in order of t."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions.columns import correlation


def series() -> WindowSpec:
    return Window.partitionBy("series_id")


def ordered() -> WindowSpec:
    return series().orderBy("t")


def upto() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def indexed(df: DataFrame) -> DataFrame:
    """Add i (place from 0) and n (rows of the series)."""
    return df.withColumn("i", (F.row_number().over(ordered()) - 1).cast("int")).withColumn("n", F.count(F.lit(1)).over(series()).cast("int"))


def first_peak(value: str = "v", place: str = "i") -> Column:
    """Place of the first greatest value of the series."""
    return F.max_by(place, F.struct(F.col(value), -F.col(place))).over(series())


def minmax(df: DataFrame, eps: float | None = None) -> DataFrame:
    """x = (v - min) / (max - min); 0 in a flat series, or with eps: over (max - min + eps)."""
    low, high = F.min("v").over(series()), F.max("v").over(series())
    x = (F.col("v") - low) / (high - low + eps) if eps is not None else F.when(high - low < 1e-10, 0.0).otherwise(F.try_divide(F.col("v") - low, high - low))
    return df.withColumn("x", x)


def maxnorm(df: DataFrame) -> DataFrame:
    return df.withColumn("x", F.try_divide(F.col("v"), F.max("v").over(series())))


def zscore(df: DataFrame, eps: float = 0.0) -> DataFrame:
    """(v - mean) / (population sd + eps); with eps 0 a series without spread divides by 1."""
    sd = F.stddev_pop("v").over(series())
    return df.withColumn("x", (F.col("v") - F.avg("v").over(series())) / (sd + eps if eps else F.when(sd == 0, 1.0).otherwise(sd)))


def winsorise(df: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    bounds = df.groupBy("series_id").agg(F.percentile("v", F.lit(low)).alias("lo"), F.percentile("v", F.lit(high)).alias("hi"))
    return df.join(bounds, "series_id").withColumn("x", F.least(F.greatest("v", "lo"), F.col("hi"))).drop("lo", "hi")


def trim_ends(df: DataFrame) -> DataFrame:
    """Rows from the first to the last non-null value."""
    known = F.when(F.col("v").isNotNull(), F.col("t"))
    return df.withColumn("_a", F.min(known).over(series())).withColumn("_b", F.max(known).over(series())).where(F.col("t").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def fill_gaps(df: DataFrame, longest: int = 5) -> DataFrame:
    """Linear values in inner gaps of up to `longest` rows; adds filled (boolean). Longer gaps stay null."""
    rows = indexed(df)
    known = F.when(F.col("v").isNotNull(), F.col("i"))
    behind, ahead = ordered().rowsBetween(Window.unboundedPreceding, 0), ordered().rowsBetween(0, Window.unboundedFollowing)
    rows = rows.select("*", F.max(known).over(behind).alias("_a"), F.min(known).over(ahead).alias("_b"), F.last("v", True).over(behind).alias("_va"), F.first("v", True).over(ahead).alias("_vb"))
    inside = F.col("v").isNull() & F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_b") - F.col("_a") - 1 <= longest)
    line = F.col("_va") + (F.col("_vb") - F.col("_va")) * F.try_divide(F.col("i") - F.col("_a"), F.col("_b") - F.col("_a"))
    return rows.select("series_id", "t", F.when(inside, line).otherwise(F.col("v")).alias("v"), inside.alias("filled"))


def onset_trim(df: DataFrame, start_max: float | None = 0.10, onset: float = 0.02, back: int = 2) -> DataFrame:
    """Drop series that start above start_max of their maximum, and rows more than `back` before the first value over `onset` of it."""
    rows = indexed(df.where(F.col("v").isNotNull())).withColumn("_max", F.max("v").over(series())).where((F.col("n") >= 3) & (F.col("_max") > 0))
    if start_max is not None:
        rows = rows.withColumn("_first", F.min_by("v", "i").over(series())).where(F.col("_first") <= start_max * F.col("_max"))
    at = F.min(F.when(F.col("v") > onset * F.col("_max"), F.col("i"))).over(series())
    return rows.withColumn("_at", at).where(F.col("i") >= F.col("_at") - back).select("series_id", "t", "v")


def truncate_decline(df: DataFrame, keep: float = 0.90) -> DataFrame:
    """Where a series ends under keep * peak: only its rows up to the first one after the peak that is under keep * peak."""
    rows = indexed(df).withColumn("_peak", F.max("v").over(series())).withColumn("_at", first_peak())
    rows = rows.withColumn("_last", F.max_by("v", "i").over(series()))
    cut = F.min(F.when((F.col("i") > F.col("_at")) & (F.col("v") < keep * F.col("_peak")), F.col("i"))).over(series())
    rows = rows.withColumn("_cut", F.when((F.col("_last") < keep * F.col("_peak")) & (F.col("_at") < F.col("n") - 1), cut))
    return rows.where(F.col("_cut").isNull() | (F.col("i") < F.col("_cut"))).select("series_id", "t", "v")


def runs(df: DataFrame, flag: Column) -> DataFrame:
    """Maximal runs of rows whose flag is true: series_id, first_i, n, t_start, t_end."""
    rows = indexed(df).withColumn("_f", F.coalesce(flag, F.lit(False)))
    island = F.col("i") - F.row_number().over(Window.partitionBy("series_id", "_f").orderBy("t"))
    return rows.withColumn("_g", island).where("_f").groupBy("series_id", "_g").agg(F.min("i").alias("first_i"), F.count(F.lit(1)).alias("n"), F.min("t").alias("t_start"), F.max("t").alias("t_end")).drop("_g")


def saturation_runs(df: DataFrame, band: float = 0.05, least: int = 3) -> DataFrame:
    """The first run, at or after the peak, of `least` rows or more within band * |peak| of the peak."""
    rows = indexed(df).withColumn("_peak", F.max("v").over(series())).withColumn("_at", first_peak()).where(F.col("i") >= F.col("_at")).select("series_id", "t", "v", "_peak")
    found = runs(rows, F.abs(F.col("v") - F.col("_peak")) <= band * (F.abs("_peak") + 1e-10)).where(F.col("n") >= least)
    first = Window.partitionBy("series_id").orderBy("first_i")
    return found.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1).drop("_r")


def structural_declines(df: DataFrame, windows: DataFrame, drop: float = 0.15, least: int = 5) -> DataFrame:
    """Series with `least` successive rows, at or after the peak, more than drop * |peak| below it, whose span of t overlaps none of windows (ws, we): series_id, t_start, t_end of the first."""
    rows = indexed(df).withColumn("_peak", F.max("v").over(series())).withColumn("_at", first_peak()).where(F.col("i") >= F.col("_at"))
    below = ((F.col("_peak") - F.col("v")) / (F.abs("_peak") + 1e-10) > drop).cast("int")
    ahead = ordered().rowsBetween(0, least - 1)
    spans = rows.withColumn("_b", below).select("series_id", F.col("t").alias("t_start"), F.max("t").over(ahead).alias("t_end"), F.min("_b").over(ahead).alias("_all"), F.count(F.lit(1)).over(ahead).alias("_n")).where((F.col("_all") == 1) & (F.col("_n") == least))
    outside = spans.join(F.broadcast(windows), (F.col("t_start") <= F.col("we")) & (F.col("t_end") >= F.col("ws")), "left_anti")
    return outside.groupBy("series_id").agg(F.min(F.struct("t_start", "t_end")).alias("s")).select("series_id", "s.t_start", "s.t_end")


def crossing(df: DataFrame, level: Column, upto: Column | None = None, from_row: int = 1) -> DataFrame:
    """series_id and t of the first row (from the second on) at or over a level, interpolated from the row before.

    level: over the columns of df, constant within a series. upto: a condition on rows that may be hit.
    """
    rows = indexed(df).withColumn("_level", level).withColumn("_v", F.lag("v").over(ordered())).withColumn("_t", F.lag("t").over(ordered()))
    hit = (F.col("i") >= from_row) & (F.col("v") >= F.col("_level"))
    rows = rows.where(hit if upto is None else hit & upto)
    first = rows.groupBy("series_id").agg(F.min_by(F.struct("t", "v", "_t", "_v", "_level"), "i").alias("h")).select("series_id", "h.*")
    between = F.col("_t") + (F.col("_level") - F.col("_v")) / (F.col("v") - F.col("_v")) * (F.col("t") - F.col("_t"))
    return first.select("series_id", F.when(F.col("v") == F.col("_v"), F.col("t").cast("double")).otherwise(between).alias("t_cross"))


def difference(df: DataFrame) -> DataFrame:
    """d = v less the value before; 0 in the first row."""
    return df.withColumn("d", F.col("v") - F.lag("v", 1).over(ordered())).withColumn("d", F.coalesce("d", F.lit(0.0)))


def gradient(df: DataFrame, value: str = "v") -> DataFrame:
    """dx: half the difference of the neighbours in an evenly spaced series; one-sided at the ends."""
    ahead, behind = F.lead(value).over(ordered()), F.lag(value).over(ordered())
    return df.withColumn("dx", F.when(ahead.isNull(), F.col(value) - behind).when(behind.isNull(), ahead - F.col(value)).otherwise((ahead - behind) / 2))


def sign_changes(df: DataFrame) -> DataFrame:
    """Changes of the gradient's sign in each series, and their share."""
    rows = gradient(df).withColumn("_s", F.signum("dx")).withColumn("_p", F.lag("_s").over(ordered()))
    n = F.count_if(F.col("_p").isNotNull() & (F.col("_s") != F.col("_p")))
    return rows.groupBy("series_id").agg(n.alias("n_changes"), (n / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("rate"))


def running_max(df: DataFrame) -> DataFrame:
    return df.withColumn("m", F.max("v").over(upto()))


def rolling(df: DataFrame, width: int, value: str = "v", least_sd: float = 1e-10) -> DataFrame:
    """var, sd and lag-1 correlation (ac1: Pearson of the window's two shifted halves, each with its own mean) over the last `width` rows.

    Only full windows whose population sd is `least_sd` or more are kept. pos = i / (n - 1).
    """
    full, pairs = ordered().rowsBetween(1 - width, 0), ordered().rowsBetween(2 - width, 0)
    rows = indexed(df).withColumn("_lag", F.lag(value).over(ordered()))
    rows = rows.select("*", F.var_pop(value).over(full).alias("var"), F.stddev_pop(value).over(full).alias("sd"), correlation(F.col("_lag"), F.col(value), 0.0, pairs).alias("ac1"))
    return rows.where((F.col("i") >= width - 1) & (F.col("sd") >= least_sd)).select("series_id", "t", "i", "n", F.try_divide(F.col("i"), F.col("n") - 1).alias("pos"), "var", "sd", "ac1")


def kendall(df: DataFrame, value: str, place: str = "t") -> DataFrame:
    """Kendall's tau-b of a value with a place that has no ties, by series: pairs are formed within each series only.

    Series are short (hundreds of rows); a series of n rows makes n (n - 1) / 2 pairs. For long ones use kernels.kendall.
    """
    a = df.select("series_id", F.col(place).alias("_p"), F.col(value).alias("_x"))
    b = df.select("series_id", F.col(place).alias("_q"), F.col(value).alias("_y"))
    pairs = a.join(b, "series_id").where(F.col("_p") < F.col("_q"))
    s = pairs.groupBy("series_id").agg(F.sum(F.signum(F.col("_y") - F.col("_x"))).alias("s"), F.count(F.lit(1)).alias("n0"), F.count_if(F.col("_x") == F.col("_y")).alias("ties"))
    return s.select("series_id", F.try_divide(F.col("s"), F.sqrt(F.col("n0").cast("double") * (F.col("n0") - F.col("ties")))).alias("tau"))


def regrid(df: DataFrame, grid: DataFrame, place: str, value: str, wide: int = 8) -> DataFrame:
    """Linear values of each series at the places g of a small grid; no row outside a series' range.

    Each row spans the half-open stretch up to the next one, and a grid place falls into one stretch.
    """
    w = Window.partitionBy("series_id").orderBy(place)
    spans = df.select("series_id", F.col(place).alias("_a"), F.col(value).alias("_va"), F.lead(place).over(w).alias("_b"), F.lead(value).over(w).alias("_vb"))
    inside = (F.col("g") >= F.col("_a")) & ((F.col("g") < F.col("_b")) | (F.col("_b").isNull() & (F.col("g") == F.col("_a"))))
    at = spans.join(F.broadcast(grid), inside)
    line = F.when(F.col("_b").isNull(), F.col("_va")).otherwise(F.col("_va") + (F.col("_vb") - F.col("_va")) * F.try_divide(F.col("g") - F.col("_a"), F.col("_b") - F.col("_a")))
    return at.select("series_id", "g", line.alias("y"))


def band(df: DataFrame, by: list[str], value: str = "y", least: int = 3) -> DataFrame:
    """Median and 10th and 90th percentile in each group of `least` rows or more."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.percentile(value, F.lit(0.1)).alias("p10"), F.percentile(value, F.lit(0.9)).alias("p90")).where(F.col("n") >= least)


def as_of(df: DataFrame, back: int) -> DataFrame:
    """For each row the first one with t at or after this row's t - back: t0, v0."""
    w = ordered().rangeBetween(-back, 0)
    return df.select("series_id", "t", "v", F.first("t").over(w).alias("t0"), F.first("v").over(w).alias("v0"))


