"""Vector bin packing of documents into shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, number_within

DIMENSIONS = ("bytes", "tokens", "rows")
#: Bytes are to come out evenest; the others follow.
WEIGHTS = (30.0, 1.0, 1.0)


def place(sizes: np.ndarray, capacity: np.ndarray, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """A bin for each unit, the largest unit first: where the dot product of the unit's and the bin's residual vector is highest.

    sizes: (n, d). capacity: (bins, d), each bin's residual vector; it is changed. Both are scaled by the mean residual, so that
    no dimension rules by its unit of measure; `weights` are the dimensions' in the product. Ties go to the lowest bin.
    """
    scale = np.abs(capacity).mean(axis=0)
    scale[scale == 0] = 1
    unit, left = sizes / scale, capacity / scale
    weighted = unit * np.array(weights[: unit.shape[1]])
    out = np.zeros(len(sizes), np.int32)
    for i in np.argsort(-unit.max(axis=1, initial=0), kind="stable").tolist():
        j = int(np.argmax(left @ weighted[i]))
        out[i] = j
        left[j] -= unit[i]
    capacity[:] = left * scale
    return out


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, heavy_share: int = 64, pieces_per_shard: int = 4, block_groups: int = 50_000) -> DataFrame:
    """Deal documents to shards that are near equal in bytes, tokens and rows at once.

    A group is the documents of one text; it is placed whole. Only a group larger than a shard in some dimension is split, by a
    hash of the id, into `pieces_per_shard` pieces for each shard's worth. Units over 1 / (shards * heavy_share) of the whole, of
    which there are at most 3 * shards * heavy_share, are placed on the driver first; the others are dealt by hash into blocks of
    about `block_groups`, and each block fills its equal part of what the shards still lack. Returns id, size, tokens, text_crc32,
    shard, slot (gapless from 0 in its shard, in no particular order).

    A null text has no bytes and is grouped apart from the empty text; null ids are one id. Repeated rows each get a slot. An empty
    table gives an empty result. Other columns are ignored.
    """
    text = F.col(text_col)
    base = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("bytes"),
            F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.unhex(F.coalesce(F.md5(text), F.lit(""))).alias("key"),
        )
    )
    groups = cut(base.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    whole = groups.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMENSIONS], F.count(F.lit(1)).alias("n")).first()
    total = [max(1, whole[d]) for d in DIMENSIONS]
    share = F.greatest(*[F.col(d) / F.lit(float(t)) for d, t in zip(DIMENSIONS, total, strict=True)])

    # At most `shards` groups a dimension are larger than a shard.
    large = groups.where(share * shards > 1).select("key", F.ceil(share * shards * pieces_per_shard).cast("int").alias("pieces"))
    piece = F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("pieces"))).cast("int")
    base = base.join(F.broadcast(large), "key", "left").withColumn("piece", piece).drop("pieces")
    split = base.join(F.broadcast(large.select("key")), "key", "left_semi").groupBy("key", "piece").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    units = groups.join(F.broadcast(large.select("key")), "key", "left_anti").select("key", F.lit(0).alias("piece"), *DIMENSIONS).unionByName(split)

    least = 1 / (shards * heavy_share)
    heavy = units.where(share > least).orderBy("key", "piece").toPandas()
    left = np.tile(np.array([whole[d] for d in DIMENSIONS], float) / shards, (shards, 1))
    heavy["shard"] = place(heavy[list(DIMENSIONS)].to_numpy(float).reshape(-1, len(DIMENSIONS)), left)
    placed = docs.sparkSession.createDataFrame([(bytes(k), int(p), int(s)) for k, p, s in zip(heavy["key"], heavy["piece"], heavy["shard"], strict=True)], "key binary, piece int, shard int")

    blocks = max(1, -(-int(whole["n"]) // block_groups))
    residual = left / blocks

    def fill(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["key", "piece"], kind="stable")
        own = block[list(DIMENSIONS)].to_numpy(float)
        want = np.maximum(residual, 0)
        want *= own.sum(axis=0) / np.maximum(want.sum(axis=0), 1e-9)
        return pd.DataFrame({"key": block["key"], "piece": block["piece"], "shard": place(own, want)})

    light = units.where(share <= least).withColumn("block", F.pmod(F.xxhash64("key", "piece"), F.lit(blocks)))
    dealt = light.groupBy("block").applyInPandas(fill, "key binary, piece int, shard int")
    # Rows of heavy units, of which some have many, meet their few shards without a shuffle.
    at, columns = ["key", "piece"], ["id", F.col("bytes").alias("size"), "tokens", "text_crc32", "shard"]
    heavy_rows = base.join(F.broadcast(placed), at).select(*columns)
    dealt = base.join(F.broadcast(placed), at, "left_anti").join(dealt, at).select(*columns).unionByName(heavy_rows)
    return number_within(cut(dealt), ["shard"], ["id", "text_crc32"], "slot").withColumnRenamed("id", id_col)
