"""Packing by power-of-two decomposition."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, lean, slices, text_batches

VOCABULARY = "byte_bpe_50k.json"


def binary_lengths(n: int, longest: int) -> list[int]:
    """n as a sum of powers of two, the largest first; none is over longest, itself a power of two."""
    out = [longest] * (n // longest)
    rest = n % longest
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


class Encoder:
    """The vocabulary file's ids of a text, as little-endian unsigned 32-bit bytes; a special token's string encodes as that token."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        # A byte-level vocabulary writes bytes as characters: printable ones as themselves, the others from 256 on, in order.
        letters = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in letters)}
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 1024, end_id: int = 0) -> DataFrame:
    """Each document's ids and then end_id, cut into pieces of power-of-two length, the largest first.

    path: the vocabulary file, which each executor reads. Returns id_col, start (the document's ids before the piece), length,
    ids (little-endian unsigned 32-bit), doc_tokens (with end_id), and `_part` and `_at`: the task that cut the piece, and how many of
    its length it had cut before. Null text counts as empty and gives the one id end_id.
    """
    text_batches(docs)
    schema = docs.select(F.col(id_col)).schema.add("start", "long").add("length", "long").add("ids", "binary").add("doc_tokens", "long").add("_part", "integer").add("_at", "long")
    kind = pa.int64() if docs.schema[id_col].dataType.simpleString() == "bigint" else None
    tail = np.array([end_id], "<u4").tobytes()

    @lean
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, cut_so_far = Encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for low, high in slices(texts):
                row, start, length, part, of, place = [], [], [], [], [], []
                for i in range(low, high):
                    raw = encode(texts[i] or "") + tail
                    n, at = len(raw) // 4, 0
                    for size in binary_lengths(n, longest):
                        row.append(i)
                        start.append(at)
                        length.append(size)
                        part.append(raw[4 * at : 4 * (at + size)])
                        of.append(n)
                        place.append(cut_so_far[size])
                        cut_so_far[size] += 1
                        at += size
                own = ids.take(pa.array(row, pa.int64()))
                columns = [own if kind is None else own.cast(kind), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(part, pa.binary()), pa.array(of, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([task] * len(row), pa.int32()), pa.array(place, pa.int64())], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(split, schema)


def sequences(cut_pieces: DataFrame, broadcast_rows: int = 10_000_000) -> DataFrame:
    """Bucket pieces of equal length; each is a sequence of its own, so none crosses documents and none needs padding.

    cut_pieces: a written table or a checkpoint of `pieces`, as it is read again. Ids of a bucket's sequences follow on one another from
    task to task: the bucket of the longest has the first ids. Ids alone are worked out from one row a task and length, so no piece is
    shuffled; those rows are broadcast if there are `broadcast_rows` at most.
    """
    counts = cut(cut_pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n")))
    before = Window.orderBy(F.desc("length"), "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    joined = cut_pieces.join(F.broadcast(starts) if counts.count() <= broadcast_rows else starts, ["_part", "length"])
    return joined.withColumn("sequence_id", F.col("_first") + F.col("_at")).withColumn("offset", F.lit(0).cast("long")).drop("_part", "_at", "_first")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 1024, end_id: int = 0) -> DataFrame:
    """Pack documents into sequences of at most `longest` ids without padding.

    Returns id_col, start, length, ids, doc_tokens, sequence_id and offset. Empty tables give no rows; repeated documents are packed
    once each; other columns are ignored.
    """
    out = sequences(cut(pieces(docs, path, id_col, text_col, longest, end_id)))
    return out.select(id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
