"""What several training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from that copy: lineage ends there, and lost executors cost nothing."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewatch-checkpoint-"))
    return df.checkpoint(eager=True)


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no extra column of the input can clash with an operator's own."""
    return df.select(*[F.col(n) for n in names])


def held(value: Column, name: str) -> Column:
    """A generated column: the optimizer can't inline it, so it is computed once a row however often it is used."""
    return F.explode(F.array(value)).alias(name)


def number_within(df: DataFrame, group: list[str], order: list[str], name: str, chunk_rows: int = 4096) -> DataFrame:
    """Number each group's rows from 0 without gaps; no task holds a whole group.

    Rows are dealt into chunks by a hash of the ordering columns; a chunk's numbers start where the chunks before it end.
    df is read three times, so pass a checkpoint or a written table. Group columns must not be null. Full ties may swap numbers.
    """
    chunks = max(1, df.count() // chunk_rows)
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*group, "_chunk").agg(F.count(F.lit(1)).alias("_n")).select(*group, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*group, "_chunk").orderBy(*order))
    return dealt.withColumn("_in", inside).join(starts, [*group, "_chunk"]).withColumn(name, F.col("_start") + F.col("_in") - 1).drop("_chunk", "_in", "_start")


def sampled(df: DataFrame, by: str, rows: int) -> DataFrame:
    """About `rows` rows of df, 2 * rows at most, picked by a hash of column `by`; all of them where there are fewer."""
    every = max(1, df.count() // rows)
    return df.where(F.pmod(F.xxhash64(F.col(by), F.lit("sample")), F.lit(every)) == 0).limit(2 * rows)


def only(df: DataFrame, ids: DataFrame, most: int = 500_000) -> DataFrame:
    """df's rows with an `id` in ids; ids are broadcast if they are `most` at most, so texts that nobody asks for aren't shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, "id", "left_semi")


def without(df: DataFrame, ids: DataFrame, id_col: str, most: int = 500_000) -> DataFrame:
    """df's rows whose id isn't in ids, a checkpoint or a written table; rows with a null id stay. ids are broadcast if they are `most` at most."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, id_col, "left_anti")


def text_batches(df: DataFrame, rows: int = 2000, size: int = 4 << 20) -> None:
    """Hand rows to Python in batches of `rows` and about `size` bytes at most from now on, so that workers stay small however long the texts are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def lean(run: Callable) -> Callable:
    """run, a function for mapInArrow: at the end of a task, what it has freed goes back to the system, as its worker stays for later tasks."""

    def run_and_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
            trim(0)

    return run_and_trim


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for base in (_ODD, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            out.append(p)
        _powers = tuple(out)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_table(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch: runs of ASCII letters and digits and of any other non-ASCII characters, A-Z lower-cased.

    Returns 64-bit word hashes, each word's first byte and end byte within its own text, for each text the index of its first word
    (one more entry at the end), and each text's byte length. Null counts as empty.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(b) for b in raw], np.int64)
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lengths + 1, out=at[1:])
    buf = np.frombuffer((b"\n".join(raw) + b"\n").translate(_LOWER), np.uint8)
    inside = _WORD[buf]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    first, end = edges[::2], edges[1::2]
    starts = np.searchsorted(first, at)
    if not len(first):
        return np.zeros(0, np.uint64), first, end, starts, lengths
    h = np.empty(len(first), np.uint64)
    i = 0
    while i < len(first):  # blocks of whole words, so that the powers stay few
        low = first[i]
        j = max(i + 1, int(np.searchsorted(first, low + (1 << 17))))
        n = int(end[j - 1] - low)
        powers, inverse = _upto(n)
        values = (buf[low : low + n].astype(np.uint64) + np.uint64(1)) * inside[low : low + n]
        values *= powers[:n]
        own = first[i:j] - low
        h[i:j] = mix(np.add.reduceat(values, own) * inverse[own])
        i = j
    base = np.repeat(at[:-1], np.diff(starts))
    return h, first - base, end - base, starts, lengths


def slices(texts: list, most: int = 3_000_000):
    """Index ranges of a batch whose texts have about `most` characters together; a longer text comes alone."""
    begin = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def table_dir(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
