"""Near duplicates by order MinHash, verified by banded alignment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import cut, is_empty, lean, mix, only, slices, text_batches, word_table

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(h: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled hashes of every k consecutive words of each text, and each text's first one.

    A text of fewer than k words, but not none, has one shingle of all of them. Equal shingles of a text differ by their label, so a
    text's labelled shingles are distinct.
    """
    n = np.diff(starts)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate(([0], np.cumsum(count)))
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(first[-1]) - first[:-1][doc] + starts[:-1][doc]
    size = np.minimum(n, k)[doc]
    s = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = size > j
        s = np.where(inside, mix(s + h[np.minimum(at + j, max(len(h) - 1, 0))] * np.uint64(2 * j + 3)), s) if len(h) else s
    order = np.argsort(s ^ mix(doc.astype(np.uint64) * _STEP), kind="stable")
    key = (s ^ mix(doc.astype(np.uint64) * _STEP))[order]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    run = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    label = np.empty(len(key), np.uint64)
    label[order] = (np.arange(len(key)) - run).astype(np.uint64)
    return mix(s + label * _STEP), first


def parities(labelled: np.ndarray, first: np.ndarray, n: int = 16) -> np.ndarray:
    """n rows of 64 bits for each text: whether an even or odd number of its labelled words falls on each bit. Two texts differ in no more bits than words."""
    texts = len(first) - 1
    doc = np.repeat(np.arange(texts), np.diff(first))
    bit = (mix(labelled) % np.uint64(64 * n)).astype(np.int64)
    odd = (np.bincount(doc * 64 * n + bit, minlength=texts * 64 * n) & 1).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(odd, bitorder="little").view("<i8").reshape(texts, n).T)


def order_minhash(labelled: np.ndarray, seeds: np.ndarray, keep: int) -> np.ndarray:
    """For each seed: the `keep` shingles of least seeded hash, in the order of the text, as one hash."""
    n = len(labelled)
    least = min(keep, n)
    out = np.empty(len(seeds), np.uint64)
    rows = max(1, 400_000 // n)
    for low in range(0, len(seeds), rows):
        v = labelled[None, :] * seeds[low : low + rows, None]
        at = np.sort(np.argpartition(v, least - 1, axis=1)[:, :least], axis=1) if n > least else np.broadcast_to(np.arange(n), v.shape)
        h = np.zeros(len(v), np.uint64)
        for j in range(least):
            h = mix(h * _STEP + labelled[at[:, j]])
        out[low : low + rows] = h
    return mix(out ^ seeds)


def common_words(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Words of a and b that agree in the best alignment of them in which none is matched with one more than `band` places off."""
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    if not len(differ):
        return m
    head = int(differ[0])
    m -= head
    differ = np.flatnonzero(a[::-1][:m] != b[::-1][:m])
    tail = int(differ[0]) if len(differ) else m
    p, q = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    where: dict[int, int] = {}
    for i, x in enumerate(p):
        where[x] = where.get(x, 0) | 1 << i
    # A zero bit i in row j: the alignment of p[: i + 1] and q[: j + 1] is longer than that of p[:i].
    row = full = (1 << len(p)) - 1
    near = (1 << 2 * band + 1) - 1
    for j, x in enumerate(q):
        same = where.get(x, 0)
        if same:
            same &= near << j - band if j >= band else near >> band - j
            both = row & same
            row = (row + both | row - both) & full
    return head + tail + len(p) - row.bit_count()


def similarity(a: np.ndarray, sorted_a: np.ndarray, b: np.ndarray, sorted_b: np.ndarray, least: float) -> float:
    """Words that agree / (words of both - those) in a banded alignment of two texts, or 0.0 if surely under `least`.

    a, b: word hashes in the order of the text; sorted_a, sorted_b: the same, each labelled by its occurrence, in ascending order. The
    band is as wide as two texts of that similarity need.
    """
    n, m = len(a), len(b)
    need = least * (n + m) / (1 + least) - 1e-9
    if min(n, m) < max(need, 1):
        return 0.0
    where = np.searchsorted(sorted_b, sorted_a)
    if np.count_nonzero(sorted_b[np.minimum(where, m - 1)] == sorted_a) < need:
        return 0.0
    agree = common_words(a, b, int(n + m - 2 * need))
    return agree / (n + m - agree) if agree >= need else 0.0


def components(links: DataFrame) -> DataFrame:
    """(id, class) of all ids in links (a, b): the least id that links lead to. Rounds of least neighbours and pointer jumps."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("class")))
    while True:
        around = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("class").alias("near"))
        closer = labels.join(around, F.col("id") == F.col("a")).select("id", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        far = labels.select(F.col("id").alias("class"), F.col("class").alias("root"))
        fresh = cut(closer.join(far, "class").select("id", "old", F.least("class", "root").alias("class")))
        labels = fresh.select("id", "class")
        if is_empty(fresh.where(F.col("class") != F.col("old"))):
            return labels


def joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (id, class), of ids in classes of several, after links (pa, pb) between classes; an id on its own is its class."""
    up = components(links.select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    higher = up.select(F.col("id").alias("class"), F.col("class").alias("root"))
    moved = classes.join(higher, "class", "left").select("id", F.coalesce("root", "class").alias("class"))
    return cut(moved.unionByName(up.join(classes, "id", "left_anti")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: float = 0.8, sketches: int = 32, keep: int = 3, full_bucket: int = 12, seed: int = 7, short: tuple[int, ...] = (12, 48)) -> DataFrame:
    """Each document's class of near duplicates: id_col, class_id (the least id of the class), n_copies.

    Words are those of word_table, shingles `k` words. Documents of the same words are one text (of texts without words, the equal
    ones); its least id stands for it. Each text has `sketches` order-MinHash entries of `keep` shingles. Few shingles can't spare so
    many: texts under the last of `short` shingles have entries of one shingle less, those under the one before of two less, and
    those that may be like such a text have both kinds. Texts that share an entry are candidates; those whose words, in a banded
    alignment, agree with a similarity of `least` or more are linked. Two texts whose shingles have that similarity, in order, are
    always alike enough, as are those with up to a ninth of their words changed. Classes are the connected components of the
    links. Texts are aligned with the leaders of
    their two largest buckets first; a leader is the text with most company in all of its buckets. Buckets of up to `full_bucket` texts
    then give all of their pairs, and in larger ones every text is aligned with the leader, but for texts of one class by then. Larger
    buckets that still hold two classes or more give all pairs of texts of different classes too, but for those that too many words
    differ in: a bound on that, which loses no pair of similarity `least`, is worked out in the join. So of the texts that share an
    entry, whatever its bucket's size, only pairs that can't be alike and pairs within a class, whose alignment could change nothing,
    aren't aligned. n_copies: the documents of the document's text.

    Null texts count as empty. Ids are taken as distinct; rows of one id and one text count once. Each row with a null id is a class of its own: class_id null, n_copies 1. An
    empty table gives no rows.
    """
    text_batches(docs)
    rng = np.random.default_rng(seed)
    kinds = [rng.integers(1, 1 << 63, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(len(short) + 1)]
    bounds = [0, *short, float("inf")]
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("same", T.BinaryType()), T.StructField("entries", T.ArrayType(T.LongType()))])
    texts_of = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    @lean
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in slices(texts, 600_000):
                h, _, _, starts, _ = word_table(texts[low:high])
                labelled, first = shingles(h, starts, k)
                same, entries = [], []
                for i in range(high - low):
                    own = labelled[first[i] : first[i + 1]]
                    if len(own):
                        same.append(hashlib.blake2b(h[starts[i] : starts[i + 1]].tobytes(), digest_size=16).digest())
                        near = [j for j in range(len(kinds)) if bounds[j] < len(own) / least and least * len(own) < bounds[j + 1]]
                        parts = [order_minhash(own, kinds[j], max(1, keep - len(short) + j)) for j in near]
                        entries.append(np.concatenate(parts).view(np.int64))
                    else:
                        same.append(b"-" + hashlib.blake2b((texts[low + i] or "").encode("utf-8", "surrogatepass"), digest_size=15).digest())
                        entries.append(np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(same, pa.binary()), pa.array(entries, pa.list_(pa.int64()))], names=schema.names)

    sketched = cut(texts_of.mapInArrow(sketch, schema))
    members = cut(sketched.groupBy("same").agg(F.min_by("entries", "id").alias("entries"), F.min("id").alias("rep"), F.countDistinct("id").alias("n_copies")))
    entries = cut(members.select("rep", F.explode("entries").alias("h")))
    sizes = entries.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    left = cut(entries.join(sizes, "h").select("h", F.col("rep").alias("id"), "n"))

    pairs_schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType())])

    @lean
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            row: dict = {}
            for side, ids in ((0, a), (1, b)):
                for i, x in enumerate(ids):
                    row.setdefault(x, (side, i))
            each = list(row)
            texts = [batch.column(2 + row[x][0])[row[x][1]].as_py() for x in each]
            own = {}
            for low, high in slices(texts, 600_000):
                h, _, _, starts, _ = word_table(texts[low:high])
                labelled, _ = shingles(h, starts, 1)
                for i in range(low, high):
                    part = slice(starts[i - low], starts[i - low + 1])
                    own[each[i]] = h[part], np.sort(labelled[part])
            found = [(x, y, s) for x, y in zip(a, b, strict=True) if (s := similarity(*own[x], *own[y], least)) >= least]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], batch.column(0).type), pa.array([f[1] for f in found], batch.column(1).type), pa.array([f[2] for f in found], pa.float64())], names=pairs_schema.names)

    def verified(pairs: DataFrame) -> DataFrame:
        rows = only(texts_of, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        with_b = pairs.join(rows.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        both = with_b.join(rows.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(align, pairs_schema).dropDuplicates(["a", "b"]))

    sign_kind = T.StructType([T.StructField("id", kind), T.StructField("w", T.IntegerType()), *[T.StructField(f"g{j}", T.LongType()) for j in range(16)]])

    @lean
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in slices(texts, 600_000):
                h, _, _, starts, _ = word_table(texts[low:high])
                signs = parities(*shingles(h, starts, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(starts).astype(np.int32)), *map(pa.array, signs)], names=sign_kind.names)

    # Texts with many entries in full buckets are near the middle of their group, so they lead.
    popular = left.groupBy("id").agg(F.sum(F.ln("n")).alias("weight"))
    left = cut(left.join(popular, "id"))
    classes = None
    if not is_empty(left):
        is_full = F.col("n") > full_bucket
        lists = [F.collect_list(F.when(~is_full, F.col("h"))).alias("small"), F.sort_array(F.collect_list(F.when(is_full, F.struct("n", "h"))), asc=False).alias("full")]
        texts = cut(left.groupBy("id").agg(*lists))
        # A bucket's rows are dealt into parts of about 256, so that no task reads all of a large one.
        salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / 256)).alias("salt")
        each_salt = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / 256) - 1)).alias("salt")
        lead = cut(left.where(is_full).groupBy("h", "n").agg(F.max(F.struct("weight", F.xxhash64("id"), "id")).alias("m")).select("h", "n", F.col("m.id").alias("head")))
        ends = [F.col(f"{end}.{f}").alias(name) for end, names in (("x", ("a", "pa")), ("y", ("b", "pb"))) for f, name in zip(("id", "part"), names, strict=True)]

        def parts_of(ids: DataFrame, of: DataFrame, id_name: str = "id", name: str = "part") -> DataFrame:
            known = of.select(F.col("id").alias(id_name), F.col("class").alias(name))
            return ids.join(known, id_name, "left").withColumn(name, F.coalesce(name, id_name))

        def pairs_in(groups: DataFrame) -> DataFrame:
            """Pairs (a, pa, b, pb) of small groups' texts xs (id, part) of different parts."""
            each = groups.select(F.posexplode(F.array_sort("xs")).alias("at", "x"), F.array_sort("xs").alias("xs"))
            return each.select("x", F.explode(F.expr("filter(slice(xs, at + 2, size(xs)), y -> y.part != x.part)")).alias("y")).select(*ends)

        def apart(entries: DataFrame, leaders: DataFrame) -> DataFrame:
            """(h, n, x, y): texts x (id, part) and their bucket's leader y, of (h, head, head_part), where their parts differ."""
            each = leaders.select("h", F.struct(F.col("head").alias("id"), F.col("head_part").alias("part")).alias("y"), each_salt)
            return entries.select("h", "n", salt, F.struct("id", "part").alias("x")).join(each, ["h", "salt"]).where(F.col("x.part") != F.col("y.part")).drop("salt")

        def meet(entries: DataFrame, leaders: DataFrame) -> DataFrame:
            """Pairs (a, pa, b, pb) of texts and of their buckets' leaders, where their parts differ."""
            return apart(entries, leaders).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).select(*ends)

        def possible(odd: DataFrame, inside: DataFrame) -> DataFrame:
            """Pairs (a, pa, b, pb) of odd entries' texts (h, n, id, part) with those inside the same buckets (h, salt, id, part), of different parts, but for pairs that can't be alike.

            Two texts of n and m words that are alike have at most (n + m) * (1 - least) / (1 + least) words that the other one hasn't, and
            no more parities of words that differ.
            """
            signs = cut(only(texts_of, inside.select("id").distinct()).mapInArrow(sign, sign_kind))
            bits = sign_kind.names[2:]
            one = odd.join(signs, "id").select("h", each_salt, F.struct("id", "part").alias("p"), F.col("w").alias("v"), *[F.col(g).alias(f"o{g}") for g in bits])
            two = inside.join(signs, "id").select("h", "salt", F.struct("id", "part").alias("q"), "w", *bits)
            most = (1 - least) / (1 + least) * (F.col("v") + F.col("w")) + 1e-9
            differ = reduce(Column.__add__, [F.bit_count(F.col(g).bitwiseXOR(F.col(f"o{g}"))) for g in bits])
            near = one.join(two, ["h", "salt"]).where((F.col("p.part") != F.col("q.part")) & (F.abs(F.col("v") - F.col("w")) <= most) & (differ <= most))
            return near.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).select(*ends).distinct()

        # Texts first meet the leaders of their two largest buckets.
        largest = texts.select("id", F.col("id").alias("part"), F.explode(F.slice("full", 1, 2)).alias("e")).select("id", "part", "e.*")
        pairs = cut(meet(largest, lead.withColumn("head_part", F.col("head"))).distinct())
        classes = components(verified(pairs.select("a", "b")))
        # Small buckets, and full ones that hold several classes, then give pairs of texts of different classes.
        placed = cut(parts_of(texts, classes))
        of_small = placed.select(F.struct("id", "part").alias("x"), F.explode("small").alias("h")).groupBy("h").agg(F.collect_set("x").alias("xs"))
        both = pairs_in(of_small.where(F.size(F.array_distinct(F.transform("xs", lambda x: x["part"]))) > 1))
        of_full = lambda placed: placed.select("id", "part", F.explode("full").alias("e")).select("id", "part", "e.*")
        more = cut(both.unionByName(meet(of_full(placed), parts_of(lead, classes, "head", "head_part"))).distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
        tried = pairs.select("a", "b").unionByName(more.select("a", "b"))
        classes = joined_classes(classes, verified(more.select("a", "b")).join(more, ["a", "b"]).select("pa", "pb").distinct())
        # What is left are full buckets of two classes or more: some text's class isn't the leader's.
        placed = cut(parts_of(texts.select("id", "full"), classes))
        odd = cut(apart(of_full(placed), parts_of(lead, classes, "head", "head_part")).select("h", "n", "x.*"))
        if not is_empty(odd):
            inside = cut(of_full(placed).select("id", "part", "h", salt).join(odd.select("h", "n").distinct().select("h", each_salt), ["h", "salt"], "left_semi"))
            more = cut(possible(odd, inside).join(tried, ["a", "b"], "left_anti"))
            classes = joined_classes(classes, verified(more.select("a", "b")).join(more, ["a", "b"]).select("pa", "pb").distinct())
    if classes is None:
        known = members.select("same", F.col("rep").alias("class"), "n_copies")
    else:
        known = members.select("same", "rep", "n_copies").join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("same", F.coalesce("class", "rep").alias("class"), "n_copies")
    ids = sketched.select("id", "same").distinct()
    out = ids.join(known, "same").select(F.col("id").alias(id_col), F.col("class").alias("class_id"), "n_copies")
    nameless = docs.where(F.col(id_col).isNull()).select(F.col(id_col), F.col(id_col).alias("class_id"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(nameless)
