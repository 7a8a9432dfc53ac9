"""Matching, splitting and resampling by integer hashes, so a pick depends on the row's key alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(key: Column, seed: int = 0) -> Column:
    """A fixed scrambling of whole numbers."""
    return F.pmod(F.pmod(key.cast("long"), F.lit(1_000_003)) * (48_271 + 2 * seed) + key.cast("long"), F.lit(2_147_483_647))


def matched(df: DataFrame, label: str, value: str, key: str, bins: int = 18) -> DataFrame:
    """As many rows of each class in each bin of the value's common range; bins are half-open, so the range's end is in none.

    Ranks run within (bin, class), and a bin holds the least class's count of each.
    """
    ranges = df.groupBy(label).agg(F.min(value).alias("a"), F.max(value).alias("b")).agg(F.max("a").alias("_lo"), F.min("b").alias("_hi"), F.count(F.lit(1)).alias("_k"))
    place = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    rows = df.crossJoin(F.broadcast(ranges)).where((F.col(value) >= F.col("_lo")) & (F.col(value) < F.col("_hi"))).withColumn("bin", place.cast("int"))  # one row of ranges
    least = rows.groupBy("bin", label).agg(F.count(F.lit(1)).alias("n"), F.max("_k").alias("_k")).groupBy("bin").agg(F.min("n").alias("_n"), F.count(F.lit(1)).alias("_c"), F.max("_k").alias("_k")).where(F.col("_c") == F.col("_k")).select("bin", "_n")
    rank = F.row_number().over(Window.partitionBy("bin", label).orderBy(order_key(F.col(key)), key))
    return rows.join(F.broadcast(least), "bin").withColumn("_r", rank).where(F.col("_r") <= F.col("_n")).drop("_lo", "_hi", "_k", "_n", "_r")


def split(df: DataFrame, label: str, key: str, shares: tuple[float, float] = (0.70, 0.15)) -> DataFrame:
    """Add `part`: train, validation or test, whole counts of each class rounded down."""
    w = Window.partitionBy(label)
    rank, n = F.row_number().over(w.orderBy(order_key(F.col(key)), key)), F.count(F.lit(1)).over(w)
    a, b = F.floor(shares[0] * n), F.floor(shares[0] * n) + F.floor(shares[1] * n)
    return df.withColumn("part", F.when(rank <= a, "train").when(rank <= b, "validation").otherwise("test"))


def balanced(df: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """n rows of each class."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(order_key(F.col(key)), key))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def capped_rank(df: DataFrame, base: str, score: str, key: str, cap: int, most: int) -> DataFrame:
    """The `most` rows of highest score with no more than `cap` of one base."""
    rank = F.row_number().over(Window.partitionBy(base).orderBy(F.desc(score), key))
    return df.withColumn("_r", rank).where(F.col("_r") <= cap).orderBy(F.desc(score), key).limit(most).drop("_r")
