"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, held, sampled

#: The white space that parts words, and the symbols that are counted.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOL = "[#*$%&|<>]"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A document is rejected where `rejects`, given the columns of the features in `needs`, is true; null counts as false."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{SPACE}+"))


def word_windows(w: Column) -> Column:
    """Hashes of all windows of three words."""
    n = F.size(w)
    return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))


def repeated(w: Column, h: Column) -> Column:
    """Words in windows that occur twice or more, of words w and their windows' hashes h.

    Most texts repeat no window, which a set of the hashes shows. In others the hashes, with the place in their low bits, are sorted, so
    that equal windows adjoin; the words of adjoining ones are then compared.
    """
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(w)))) - 1

    def places(m: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long"))))

        def of_sorted(s: Column) -> Column:
            hash_at = lambda i: F.get(s, i).bitwiseAND(F.bitwise_not(m))
            place = lambda i: F.get(s, i).bitwiseAND(m).cast("int")
            near = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 2, F.lit(0))), lambda i: hash_at(i) == hash_at(i + 1))
            both = F.transform(near, lambda i: F.struct(place(i).alias("a"), place(i + 1).alias("b")))
            same = F.filter(both, lambda p: (F.get(w, p["a"]) == F.get(w, p["b"])) & (F.get(w, p["a"] + 1) == F.get(w, p["b"] + 1)) & (F.get(w, p["a"] + 2) == F.get(w, p["b"] + 2)))
            return let(same, lambda p: F.array_sort(F.array_distinct(F.concat(F.transform(p, lambda x: x["a"]), F.transform(p, lambda x: x["b"])))))

        return let(keyed, of_sorted)

    def covered(r: Column) -> Column:
        steps = F.transform(r, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(r, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(mask, places), covered))


def line_repeats(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def occurrences(text: Column, characters: str) -> Column:
    """How many characters of the text are of the class `characters`."""
    return (F.size(F.split(text, characters, -1)) - 1).cast("long")


def raw_features(text_col: str = "text") -> dict[str, Column]:
    """Each feature that a rule may need, from the text alone; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {
        "n_words": F.size(split_words(text)).cast("long"),
        "word_chars": F.length(F.array_join(split_words(text), "")).cast("long"),
        "n_symbols": occurrences(text, SYMBOL),
        "n_dup_lines": line_repeats(text),
        "n_repeat_words": let(split_words(text), lambda w: let(word_windows(w), lambda h: repeated(w, h))),
        "n_lines": occurrences(text, "\n") + 1,
        "n_capitals": occurrences(text, "[A-Z]"),
        "n_letters": (F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]+", ""))).cast("long"),
        "n_shouts": occurrences(text, "!"),
    }


def word_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) to whole texts; a null text has none of them.

    n_repeat_words: words in windows of three words that occur twice or more in the text. Columns of these names in
    docs are replaced; its other columns, whatever their names, and all of its rows stay.
    """
    docs = docs.drop(*FEATURES)
    kept = docs.columns
    fresh = "_" * (1 + max((len(c) for c in kept), default=0))
    text = F.coalesce(F.col(text_col), F.lit(""))
    w, h = fresh + "w", fresh + "h"
    hashed = docs.select("*", held(split_words(text), w)).select("*", held(word_windows(F.col(w)), h))
    raw = raw_features(text_col) | {"n_words": F.size(w).cast("long"), "word_chars": F.length(F.array_join(w, "")).cast("long"), "n_repeat_words": repeated(F.col(w), F.col(h))}
    return hashed.select(*[F.col(c) for c in kept], *[raw[f].alias(f) for f in FEATURES])


def cascade_order(sample: DataFrame, rules: list[Rule], features: Mapping[str, Column], repeats: int = 3) -> list[tuple[Rule, float, float]]:
    """The rules by rejections per second, the best first, each with its seconds and its rejected share on a sample.

    A rule's cost is the least time of `repeats` runs over the sample, with all that its features take from the raw text, less that
    of a run without a rule. Times vary, so costs count as powers of two, 1 ms at least; equals go by name. On an empty sample the
    rules go by name.
    """

    def run(rule: Column) -> tuple[float, float]:
        best, share = float("inf"), 0.0
        for _ in range(repeats):
            began = time.perf_counter()
            share = sample.agg(F.avg(F.coalesce(rule, F.lit(False)).cast("int")), F.count(F.lit(1))).first()[0] or 0.0
            best = min(best, time.perf_counter() - began)
        return best, share

    idle, _ = run(F.lit(False))
    found = []
    for rule in rules:
        seconds, share = run(rule.rejects(*[features[f] for f in rule.needs]))
        found.append((rule, 2.0 ** round(math.log2(max(seconds - idle, 1e-3))), share))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def cascade(docs: DataFrame, rules: list[Rule], features: Mapping[str, Column], sample_rows: int = 1000, id_col: str = "doc_id", ready: tuple[str, ...] = (), prepare: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """prepare(docs) with rejected_by: the first rule, in the order of cascade_order, that rejects the row, or null.

    features: each feature's column, from the raw text. CASE WHEN stops at the first true branch, so a row pays for the features of
    the rules up to its rejection only; those named in `ready` are columns that prepare adds for all rows anyway. Costs and
    selectivities are measured on about `sample_rows` raw texts, twice that at most. Whether a row is rejected does not depend on the order.
    """
    sample = cut(sampled(docs, id_col, sample_rows).coalesce(1))
    own = {f: F.col(f) if f in ready else c for f, c in features.items()}
    out = F.lit(None).cast("string")
    for rule, _, _ in reversed(cascade_order(sample, rules, features)):
        out = F.when(F.coalesce(rule.rejects(*[own[f] for f in rule.needs]), F.lit(False)), F.lit(rule.name)).otherwise(out)
    return prepare(docs).withColumn("rejected_by", out)


def production_rules() -> list[Rule]:
    """The rules of the corpus, over raw_features' columns."""
    return [
        Rule("few_words", ("n_words",), lambda n: n < 50),
        Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n),
        Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
        Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c > 18 * n) | (c < 2 * n)),
        Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: (d >= 3) & (2 * d > n)),
        Rule("capitals", ("n_capitals", "n_letters"), lambda c, n: 2 * c > n),
        Rule("shouting", ("n_shouts", "n_words"), lambda s, n: 10 * s > n),
    ]
