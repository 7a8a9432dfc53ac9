"""Language identification by multilingual mixture inference."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import sampled, slices, text_batches

BITS = 16
_LETTER = re.compile(r"[^\W\d_]")
_WORDS = np.zeros(256, np.uint8)
for _c in (*range(0x61, 0x7B), *range(0x80, 0x100)):
    _WORDS[_c] = _c
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte trigrams and their leading bigrams, hashed, of all letters of a batch; for each word its first gram; for each text its first word.

    A word is a run of ASCII letters and non-ASCII characters; a word's first grams begin at the gap before it.
    """
    raw = [t.encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=at[1:])
    b = _WORDS[np.frombuffer(b"\n\n" + b"\n".join(raw) + b"\n", np.uint8)].astype(np.uint32)
    inside = b[2:] > 0
    before = b[1:-1]
    two = np.where(before > 0, b[:-2], 0) << np.uint32(8) | before
    pick = np.flatnonzero(inside)
    two = two[pick]
    three = two << np.uint32(8) | b[2:][pick]
    shift = np.uint32(32 - BITS)
    hashed = lambda x: (x * np.uint32(0x9E3779B1)) >> shift
    begins = np.flatnonzero(before[pick] == 0)
    return hashed(three), hashed(two | np.uint32(1 << 24)), begins, np.searchsorted(pick[begins], at)


def train(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """The languages, and for each hashed trigram the log probability of its last byte after the two before it, by language."""
    names = sorted(set(langs))
    table = np.zeros((1 << BITS, len(names)), np.float32)
    for j, name in enumerate(names):
        three, two = np.zeros(1 << BITS), np.zeros(1 << BITS)
        own = [t for t, x in zip(texts, langs, strict=True) if x == name]
        leads = np.zeros(1 << BITS, np.int64)
        for low, high in slices(own):
            a, c, _, _ = grams(own[low:high])
            three += np.bincount(a, minlength=1 << BITS)
            two += np.bincount(c, minlength=1 << BITS)
            leads[a] = c
        # Unseen trigrams have no known lead; they count as seen `alpha` times after an average one.
        table[:, j] = np.log((three + 0.1) / (np.where(three > 0, two[leads], two.sum() / 2000) + 0.1 * 64))
    return names, table


def infer(texts: list[str], table: np.ndarray, rounds: int = 12, penalty: float = 1.0, floor: float = -60.0) -> tuple[np.ndarray, np.ndarray]:
    """Each text's language proportions, and which languages its set has.

    A text's words are drawn from a mixture of languages. Expectation-maximisation estimates the proportions from the words'
    trigram likelihoods. Languages are ranked by their part in the mixture of all; of the sets of the first 1, 2, ... languages the
    one is taken whose log likelihood, less `penalty` * (size - 1) * log(words) for its free proportions, is highest.
    """
    n, m = len(texts), table.shape[1]
    share, chosen = np.zeros((n, m)), np.zeros((n, m), bool)
    three, _, begins, starts = grams(texts)
    count = np.diff(starts)
    rows = np.flatnonzero(count)
    if not len(rows):
        return share, chosen
    scores = np.empty((len(begins), m), np.float64)
    for j in range(m):
        scores[:, j] = np.add.reduceat(table[three, j], begins)
    top = scores.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(scores - top, floor))
    first = starts[:-1][rows]
    doc = np.repeat(np.arange(len(rows)), count[rows])
    words = count[rows][:, None]

    def fit(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pi = mask / mask.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            part = like * pi[doc]
            total = part.sum(axis=1, keepdims=True)
            part /= np.maximum(total, 1e-300)
            pi = np.add.reduceat(part, first, axis=0) / words
        total = (like * pi[doc]).sum(axis=1)
        return pi, np.add.reduceat(np.log(np.maximum(total, 1e-300)), first)

    full, ll = fit(np.ones((len(rows), m)))
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    best, best_pi, best_mask = None, full, np.ones((len(rows), m), bool)
    for size in range(1, m + 1):
        mask = rank < size
        pi, ll = (full, ll) if size == m else fit(mask.astype(float)) if size > 1 else (mask.astype(float), np.add.reduceat(np.log((like * mask[doc]).sum(axis=1) + 1e-300), first))
        value = ll - penalty * (size - 1) * np.log(np.maximum(count[rows], 2))
        if best is None:
            best, best_pi, best_mask = value, pi, mask
        else:
            win = value > best
            best = np.where(win, value, best)
            best_pi = np.where(win[:, None], pi, best_pi)
            best_mask = np.where(win[:, None], mask, best_mask)
    share[rows], chosen[rows] = best_pi, best_mask
    return share, chosen


def fit(labelled: DataFrame, sample_rows: int = 3000, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Train on a sample of about `sample_rows` labelled rows, twice that at most, picked by a hash of the text."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = sampled(rows, "text", sample_rows).collect()
    return train([r["text"] for r in found], [r["lang"] for r in found])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of each whole text: id_col, lang_pred (largest proportion; ties by name), score (that proportion), languages, proportions.

    `languages` is the set that the penalised likelihood selects, `proportions` goes with it. A null text and one without letters
    give `und`, 0.0 and empty lists; so does a model without languages.
    """
    text_batches(docs)
    names, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = docs.select(F.col(id_col)).schema.add("lang_pred", "string").add("score", "double").add("languages", T.ArrayType(T.StringType())).add("proportions", T.ArrayType(T.DoubleType()))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for low, high in slices(texts, 600_000):
                part = [t or "" for t in texts[low:high]]
                lettered = [bool(names) and _LETTER.search(t) is not None for t in part]
                lang, score, sets, shares = ["und"] * len(part), [0.0] * len(part), [[] for _ in part], [[] for _ in part]
                if any(lettered):
                    pi, mask = infer(part, shared.value)
                    for i in np.flatnonzero(lettered & mask.any(axis=1)):
                        own = np.flatnonzero(mask[i])
                        j = int(np.argmax(pi[i]))
                        lang[i], score[i], sets[i], shares[i] = names[j], float(min(1, pi[i, j])), [names[k] for k in own], pi[i, own].tolist()
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(predict, schema)
