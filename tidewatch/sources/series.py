"""Observation tables as long series (series_id, t, v): readers, reshaping, builders over the sales and event tables, writers."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.columns import number
from tidewatch.registry import table

YEARS = (1500, 2100)


def read_text_table(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """A CSV table with all columns as strings. A byte-order mark is dropped, names are trimmed, and `required` ones are matched without case; missing ones are added empty."""
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    have = {c.lower(): c for c in df.columns}
    for name in required or []:
        own = have.get(name.lower())
        df = df.withColumn(name, F.lit("")) if own is None else df.withColumnRenamed(own, name)
    return df


def read_typed_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header and a given schema; nothing is inferred."""
    return spark.read.option("header", True).schema(schema).csv(path)


def year_columns(df: DataFrame, low: int = YEARS[0], high: int = YEARS[1]) -> list[str]:
    """Names that are whole years in a range, in order."""
    return sorted((c for c in df.columns if c.strip().isdigit() and low <= int(c) <= high), key=int)


def wide_to_long(df: DataFrame, ids: list[str], years: list[str] | None = None) -> DataFrame:
    """One row for each id and year: ids, t, v. Cells that aren't numbers give a null v."""
    years = years or year_columns(df)
    cells = df.select(*ids, *[F.col(y).cast("string").alias(y) for y in years]).unpivot(ids, years, "t", "v")
    return cells.select(*ids, F.col("t").cast("int").alias("t"), number(F.col("v")).alias("v"))


def long_to_wide(df: DataFrame, ts: list[int], prefix: str = "") -> DataFrame:
    return df.groupBy("series_id").pivot("t", ts).agg(F.first("v")).select("series_id", *[F.col(str(t)).alias(f"{prefix}{t}") for t in ts])


def to_arrays(df: DataFrame) -> DataFrame:
    """One row a series: series_id, t and v as arrays in order of t; null values are left out."""
    pairs = F.array_sort(F.collect_list(F.struct("t", "v")))
    return df.where(F.col("v").isNotNull()).groupBy("series_id").agg(pairs.alias("p")).select("series_id", F.col("p.t").alias("t"), F.col("p.v").alias("v"))


def to_long(df: DataFrame, value: str = "v") -> DataFrame:
    return df.select("series_id", F.posexplode(value).alias("t", "v"))


def month(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def money(x: Column) -> Column:
    """Exact sums need decimals."""
    return x.cast(T.DecimalType(18, 2))


def running(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return df.select("series_id", "t", F.sum("v").over(Window.partitionBy("series_id").orderBy("t")).cast("double").alias("v"))


def segment_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative order value by market segment and month."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return running(joined.groupBy(F.col("c_mktsegment").alias("series_id"), month(F.col("o_orderdate")).alias("t")).agg(F.sum(money(F.col("o_totalprice"))).alias("v")))


def nation_share(spark: SparkSession, sf_dir: str, status: str = "F") -> DataFrame:
    """Percent of orders in a status, by the customer's nation and month."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy(F.col("c_nationkey").cast("string").alias("series_id"), month(F.col("o_orderdate")).alias("t"))
    counted = joined.agg(F.count_if(F.col("o_orderstatus") == status).alias("part"), F.count(F.lit(1)).alias("whole"))
    return counted.where(F.col("part") > 0).select("series_id", "t", (100.0 * F.col("part") / F.col("whole")).alias("v"))


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed value by event type and day of the year 2024."""
    events = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    return events.groupBy(F.col("event_type").alias("series_id"), F.dayofyear("ts").cast("int").alias("t")).agg(F.sum(money(F.col("value"))).cast("double").alias("v"))


def user_days(spark: SparkSession, sf_dir: str, days: int = 30) -> DataFrame:
    """Events by user and day over a dense calendar; days without events have a null v."""
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    seen = events.groupBy(F.col("user_id").cast("string").alias("series_id"), F.dayofyear("ts").cast("int").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    calendar = seen.select("series_id").distinct().select("series_id", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("t"))
    return calendar.join(seen, ["series_id", "t"], "left")


def write_tiers(df: DataFrame, path: str, column: str = "tier") -> None:
    """One Parquet folder a tier."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_cached_json(spark: SparkSession, path: str, field: str, fallback: float | None = None) -> Column | DataFrame:
    """One field, by its dotted path, of a JSON report; the fallback where the path is missing."""
    df = spark.read.option("multiLine", True).json(path)
    at: T.DataType = df.schema
    for part in field.split("."):
        if not isinstance(at, T.StructType) or part not in at.fieldNames():
            return df.select(F.lit(fallback).alias("value"))
        at = at[part].dataType
    return df.select(F.col(field).alias("value"))


def built(spark: SparkSession, path: str, build: Callable[[], DataFrame], config: dict | None = None) -> DataFrame:
    """The Parquet table at path, built and written if it is absent or incomplete; with a config, one table a distinct config."""
    if config is not None:
        path = f"{path}/{hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_state(spark: SparkSession, state: dict, path: str) -> None:
    """A fitted model's parameters (numbers, texts, lists and arrays of them) as one JSON row."""
    plain = json.dumps(state, default=lambda x: x.tolist(), sort_keys=True)
    spark.createDataFrame([(plain,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_state(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(path).first()["value"])


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report table of `most` rows at most as Markdown; numbers have four significant digits."""
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    rows = [[cell(v) for v in r] for r in df.limit(most).collect()]
    return "\n".join([f"# {title}", "", *("| " + " | ".join(r) + " |" for r in [df.columns, ["-"] * len(df.columns), *rows])]) + "\n"


def write_markdown(df: DataFrame, title: str, path: str) -> None:
    df.sparkSession.createDataFrame([(markdown(df, title),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, x) of the rows of one- or two-dimensional .npy files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                x = x.reshape(len(x), -1)
                yield pd.DataFrame({"path": name, "row": np.arange(len(x)), "x": x.astype(float).tolist()})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, row long, x array<double>")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file under a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
