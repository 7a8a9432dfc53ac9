"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, held, only

#: Fixed value: what parts words. A-Z are lower-cased first.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in a text that isn't lower-cased.
CASED_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lower, BETWEEN), lambda w: w != "")


#: Bits of a fingerprint that hold its place, counted down so that of equal hashes the last is least; the others but the sign are the hash's.
PLACE_BITS = 28
LAST = (1 << PLACE_BITS) - 1
HASH = (1 << 63) - 1 - LAST


def grams(n: str, hashes: str, k: int) -> Column:
    """Fingerprints of all runs of k words."""
    run = ", ".join(f"get({hashes}, i + {j})" for j in range(k))
    return F.expr(f"CASE WHEN {n} < {k} THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, greatest({n} - {k}, 0)), i -> (xxhash64({run}) & {HASH}L) | ({LAST}L - i)) END")


def winnowed(prints: str, window: int) -> Column:
    """The least fingerprint of each run of `window` ones, each once; none where there are fewer.

    Two texts that share k + window - 1 words share the k-gram that is picked there, at the same place of the shared words.
    """
    run = ", ".join(f"get({prints}, i + {j})" for j in range(window))
    return F.expr(f"CASE WHEN size({prints}) < {window} THEN cast(array() AS array<bigint>) ELSE array_distinct(transform(sequence(0, greatest(size({prints}) - {window}, 0)), i -> least({run}))) END")


def row_key(id_col: str, text_col: str) -> Column:
    """The same for rows of equal id and text only, so that rows that share an id stay apart."""
    told = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (id_col, text_col)]
    return F.unhex(F.md5(F.concat_ws("\x00", *told)))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 8, k: int = 4, broadcast_rows: int = 200_000) -> DataFrame:
    """Where documents share `span` words with benchmark items. Returns (id_col, n_words, spans, item_ids, row_key) for every row of docs.

    spans: [(first word, words)] of occurring windows, in order; item_ids: the items, sorted as strings. A window is `span`
    consecutive words of an item; a shorter item, but for an empty one, is one window. Both sides keep the least k-gram hash of each
    window, which finds every shared window; a found pair counts if all the words agree. Distinct windows of the items are held
    once, each with its list of items, and are broadcast only if there are at most `broadcast_rows` of them. With more of them
    fingerprints alone are joined, and the texts only with those found, one row a text.

    Null texts have no words. Rows that share an id, null ids too, are documents of their own; equal rows give equal ones. A document
    without a hit has empty lists.
    """
    gram = span - k + 1
    hashes = lambda df: df.withColumn("n", F.size("w")).select("*", held(F.transform("w", lambda x: F.xxhash64(x)), "hw"))

    item_words = items.select(F.col(item_col).cast("string").alias("item"), held(words(F.col(item_text_col)), "w")).where(F.size("w") > 0).withColumn("n", F.size("w"))
    long = item_words.where(F.col("n") >= span).select("item", F.explode(F.expr(f"transform(sequence(1, n - {span - 1}), i -> slice(w, i, {span}))")).alias("w"))
    windows = cut(long.unionByName(item_words.where(F.col("n") < span).select("item", "w")).groupBy("w").agg(F.collect_set("item").alias("items")))
    known = hashes(windows).select("*", held(grams("n", "hw", k), "g"))
    place = (F.lit(LAST) - F.col("p").bitwiseAND(LAST)).cast("int")
    picked = known.where(F.col("n") == span).select("w", "items", "n", F.explode(winnowed("g", gram)).alias("p")).select(F.col("w").alias("win"), "items", F.col("n").alias("m"), F.shiftright("p", PLACE_BITS).alias("h"), place.alias("inside"))
    lengths = sorted(r["n"] for r in windows.select(F.size("w").alias("n")).where(F.col("n") < span).distinct().collect())  # fewer than `span` numbers
    index = picked
    for m in lengths:
        short = known.where(F.col("n") == m).select("w", "items", "n", F.explode(grams("n", "hw", m)).alias("p"))
        index = index.unionByName(short.select(F.col("w").alias("win"), "items", F.col("n").alias("m"), F.shiftright("p", PLACE_BITS).alias("h"), F.lit(0).alias("inside")))
    small = windows.count() <= broadcast_rows
    # Not createDataFrame(): its rows would take Python workers on the executors.
    no_words = F.expr("cast(array() AS array<string>)")
    none = docs.sparkSession.range(1).select(no_words.alias("win"), no_words.alias("items"), F.lit(0).alias("m"), F.lit(-1).cast("long").alias("h"), F.lit(0).alias("inside"))

    base = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    split = hashes(base.select("id", "key", held(words(F.col("text")), "w")))
    # Each document also has one fingerprint of its own, which finds the empty window.
    own = F.array(F.lit(-1).cast("long"))
    prints = F.concat(own, winnowed("g", gram), *[grams("n", "hw", m) for m in lengths])
    printed = split.select("id", "key", "w", "n", "hw", held(grams("n", "hw", k), "g"))
    first = F.col("place") - F.col("inside")
    agrees = (F.col("m") == 0) | ((first >= 0) & (F.slice("w", F.greatest(first, F.lit(0)) + 1, F.col("m")) == F.col("win")))
    at = [F.shiftright("p", PLACE_BITS).alias("h"), place.alias("place")]
    counted = [F.first("id").alias("id"), F.max("n").cast("long").alias("n_words"), F.count(F.when(F.col("m") == 0, 1)).alias("rows")]
    if small:
        seen = printed.select("id", "key", "w", "n", F.explode(prints).alias("p")).select("id", "key", "w", "n", *at)
        found = seen.join(F.broadcast(index.unionByName(none)), "h").where(agrees)
        span_of = F.when(F.col("m") > 0, F.struct(first.alias("first"), "m"))
        # A window is met once for each place, so a document has at most as many rows here as words, for each length.
        out = found.groupBy("key").agg(*counted, F.array_sort(F.collect_set(span_of)).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    else:
        seen = printed.select("key", F.explode(prints).alias("p")).select("key", *at).where(F.col("h") >= 0)
        met = cut(seen.join(index, "h").where(first >= 0).select("key", first.alias("first"), "m", "win", "items").groupBy("key").agg(F.collect_set(F.struct("first", "m", "win", "items")).alias("met")))
        texts = only(split.select(F.col("key").alias("id"), "w"), met.select(F.col("key").alias("id"))).select(F.col("id").alias("key"), "w").dropDuplicates(["key"])
        true = F.filter("met", lambda c: F.slice(F.col("w"), c["first"] + 1, c["m"]) == c["win"])
        hits = met.join(texts, "key").select("key", held(true, "met")).select("key", F.array_sort(F.array_distinct(F.transform("met", lambda c: F.struct(c["first"].alias("first"), c["m"].alias("m"))))).alias("spans"), F.flatten(F.transform("met", lambda c: c["items"])).alias("items"))
        every = split.select("id", "key", "n", F.lit(0).alias("m")).groupBy("key").agg(*counted)
        empty = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() AS {kind})")).alias(c)
        out = every.join(hits, "key", "left").select("key", "id", "n_words", "rows", empty("spans", "array<struct<first: int, m: int>>"), empty("items", "array<string>"))
    each = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return each.select(F.col("id").alias(id_col), "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("item_ids"), F.col("key").alias("row_key"))


def covered(spans: str = "spans") -> Column:
    """How many words the spans, in order of their first words, cover together."""
    return F.expr(f"aggregate({spans}, struct(0L AS n, 0L AS end), (s, x) -> struct(s.n + greatest(0L, x.first + x.m - greatest(s.end, x.first)) AS n, greatest(s.end, cast(x.first + x.m AS bigint)) AS end), s -> s.n)")


def drop_and_cut(docs: DataFrame, found: DataFrame, items: int = 2, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = 1_000_000) -> DataFrame:
    """docs without those in which `items` benchmark items or more occur; texts of the others lose the words in found spans.

    found: contamination's result, which tells rows of one id apart. A word goes with what parts it from the next one. Texts without
    spans stay as they are. The hits are broadcast if they have `broadcast_words` spans at most. All columns stay, whatever their names.
    """
    fresh = "_" * (1 + max(len(c) for c in docs.columns))
    key, spans, drop, words = (fresh + x for x in ("key", "spans", "drop", "words"))
    hits = cut(found.where(F.size("spans") > 0).dropDuplicates(["row_key"]).select(F.col("row_key").alias(key), F.col("spans").alias(spans), (F.size("item_ids") >= items).alias(drop)))
    n = hits.agg(F.coalesce(F.sum(F.size(spans)), F.lit(0))).first()[0]
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    joined = keyed.join(F.broadcast(hits) if n <= broadcast_words else hits, key, "left").where(~F.coalesce(F.col(drop), F.lit(False)))
    part, word = CASED_BETWEEN, "[^" + CASED_BETWEEN[1:]
    each = F.regexp_extract_all(F.col(text_col), F.lit(f"({word}+{part}*)"), F.lit(1))
    kept = joined.withColumn(words, F.when(F.col(spans).isNotNull(), each))
    rest = F.expr(f"filter(transform({words}, (x, i) -> CASE WHEN NOT exists({spans}, s -> i >= s.first AND i < s.first + s.m) THEN x END), x -> x IS NOT NULL)")
    clean = F.concat(F.regexp_extract(F.col(text_col), f"^{part}*", 0), F.array_join(rest, ""))
    return kept.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(clean)).select(*[F.col(c) for c in docs.columns])
