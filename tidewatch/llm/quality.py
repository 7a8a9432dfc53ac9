"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import lean, mix, sampled, slices, text_batches, word_table


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(chars)] = 1
    return out


_UPPER, _LOWER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(bytes(range(48, 58)))
_SYMBOL, _MARK, _STOP = _class(b"#*$%&|<>@^~=_\\{}[]+/"), _class(b"!?"), _class(b".,;:")
_SPACE, _HIGH = _class(b" \t\r\x0b\x0c"), _class(bytes(range(128, 256)))
#: Own features of a line; a line's vector has them for itself, the line before and the line after.
OWN = 19


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all lines of a batch: features, length in bytes; and for each text its first line (one more entry at the end). A text has one line at least."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    stop = np.flatnonzero(buf == 10)
    start = np.concatenate(([0], stop[:-1] + 1))
    length = stop - start
    text_end = np.cumsum([len(b) + 1 for b in raw])
    first = np.concatenate(([0], np.searchsorted(stop, text_end - 1) + 1))
    n = np.maximum(length, 1).astype(np.float32)
    total = lambda table: np.add.reduceat(table[buf], start)
    upper, lower, high, digit, symbol, mark, dots, space = (total(t) for t in (_UPPER, _LOWER, _HIGH, _DIGIT, _SYMBOL, _MARK, _STOP, _SPACE))
    letters = np.maximum(upper + lower + high, 1)

    h, at, _, starts, _ = word_table(texts)
    base = np.concatenate(([0], text_end[:-1]))
    line = np.searchsorted(stop, at + np.repeat(base, np.diff(starts)))
    words = np.bincount(line, minlength=len(stop)).astype(np.float32)
    key = mix(h ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, index = np.unique(key, return_index=True)
    distinct = np.bincount(line[index], minlength=len(stop)).astype(np.float32)
    again = np.bincount(line[1:][(h[1:] == h[:-1]) & (line[1:] == line[:-1])], minlength=len(stop)).astype(np.float32) if len(h) else np.zeros(len(stop), np.float32)
    w = np.maximum(words, 1)
    last = np.where(length > 0, buf[np.maximum(stop - 1, 0)], 0)
    own = np.stack(
        [
            np.ones(len(stop), np.float32),
            np.log1p(words) / 5,
            (words < 4).astype(np.float32),
            np.minimum(upper / letters * 4, 1),
            (upper > 0.5 * letters).astype(np.float32),
            np.minimum(symbol / w * 2, 1),
            (symbol > 0.3 * w).astype(np.float32),
            np.minimum(mark / w * 2, 1),
            (mark > 0.3 * w).astype(np.float32),
            np.minimum(digit / n * 4, 1),
            np.minimum(dots / w, 1),
            np.minimum(space / n * 3, 1),
            1 - distinct / w,
            (distinct < 0.4 * w).astype(np.float32),
            np.minimum(again / w * 2, 1),
            (again > 0.3 * w).astype(np.float32),
            np.minimum((upper + lower + high) / w / 12, 2),
            np.isin(last, list(b".!?\"'")).astype(np.float32),
            high / letters,
        ],
        axis=1,
    ).astype(np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([own, before, after], axis=1), length.astype(np.float64), first


def marginals(unary: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many chains at once: P(good) of each line, the summed pair marginals (2, 2), and the log partition's sum.

    unary: log potential of good against bad. move: (2, 2) log potentials from a line's state to the next one's; state 1 is good.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, size = first[:-1][order], n[order]
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(steps), side="left")
    shift = np.maximum(unary, 0)
    e = np.stack([np.exp(-shift), np.exp(unary - shift)], axis=1)
    t = np.exp(move)
    alpha, beta, scale = np.empty((len(unary), 2)), np.ones((len(unary), 2)), np.empty(len(unary))
    for s in range(steps):
        i = begin[: live[s]] + s
        a = e[i] if s == 0 else (alpha[i - 1] @ t) * e[i]
        scale[i] = a.sum(axis=1)
        alpha[i] = a / scale[i][:, None]
    pairs = np.zeros((2, 2))
    for s in range(steps - 1, 0, -1):
        i = begin[: live[s]] + s
        back = e[i] * beta[i] / scale[i][:, None]
        beta[i - 1] = back @ t.T
        pairs += (alpha[i - 1].T @ back) * t
    return (alpha * beta)[:, 1], pairs, float(np.log(scale).sum() + shift.sum())


def train(texts: list[str], good: list[int], rounds: int = 300, rate: float = 0.1, decay: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by gradient steps (Adam) on the mean log likelihood of the lines' labels; a line has its document's label."""
    x, _, first = line_features(texts)
    x = x.astype(np.float64)
    y = np.repeat(np.array(good, float), np.diff(first))
    same = np.diff(first) - 1
    seen = np.array([[sum(s for s, g in zip(same, good, strict=True) if not g), 0], [0, sum(s for s, g in zip(same, good, strict=True) if g)]], float)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        p, pairs, _ = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), first)
        grad = np.concatenate([x.T @ (y - p), (seen - pairs).ravel()]) / len(x) - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def fit(labelled: DataFrame, docs: DataFrame, sample_rows: int = 3000, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text") -> tuple[np.ndarray, np.ndarray] | None:
    """Train on the texts of about `sample_rows` labelled ids, twice that at most, picked by a hash of the id. None where nothing is labelled.

    Of several labels of an id the least counts; of several documents with one id, each.
    """
    ids = labelled.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("good"))
    few = sampled(ids, "id", sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id").limit(2 * sample_rows).collect()
    rows.sort(key=lambda r: (str(r["id"]), r["text"] or ""))
    if not rows:
        return None
    return train([r["text"] or "" for r in rows], [r["good"] for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """Add the document's quality, 0 to 1: the mean of its lines' marginals of being good, weighted by their bytes plus one.

    Whole texts are scored. Null and empty texts have one empty line. Without a model the score is 0.5. All columns are kept; a
    column called `name` is replaced.
    """
    kept = docs.drop(name)
    if model is None:
        return kept.withColumn(name, F.lit(0.5))
    text_batches(docs)
    weights, move = model
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])
    column = kept.columns.index(text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).to_pylist()
            for low, high in slices(texts, 600_000):
                x, length, first = line_features(texts[low:high])
                p, _, _ = marginals((x @ weights.astype(np.float32)).astype(float), move, first)
                w = length + 1
                s = np.add.reduceat(p * w, first[:-1]) / np.add.reduceat(w, first[:-1])
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.clip(s, 0, 1), pa.float64())], names=schema.names)

    return kept.mapInArrow(run, schema)
