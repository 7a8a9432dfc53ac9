"""Main text of web pages by differencing each page with its nearest URL."""

from __future__ import annotations

import hashlib
import html as entities
import os.path
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import urls
from tidewatch.llm.common import cut, text_batches

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|noscript|template|iframe|svg|select|button|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<[a-zA-Z/][^>]*\Z",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Elements that nest, and so are kept on the stack; of others only the places where blocks end matter.
_NEST = frozenset("article main section div nav header footer aside form ul ol dl table blockquote figure body details dialog menu fieldset".split())
_BLOCK = _NEST | frozenset("p h1 h2 h3 h4 h5 h6 li tr td th dt dd pre hr figcaption caption address html head option legend summary".split())
_MAIN = frozenset(("article", "main"))
_ROOT = 0
_ASIDE = frozenset("nav footer aside form menu dialog".split())
_NAMES = frozenset("ad ads adv advert adverts advertisement sponsor sponsored banner sidebar menu navbar nav navigation breadcrumb breadcrumbs footer masthead cookie cookies consent notice popup modal promo newsletter subscribe share sharing social related recommended comment comments disqus widget toolbar pagination pager complementary contentinfo search".split())

OPEN, MAIN, LINKS, ASIDE = 0, 1, 2, 3


class Block(NamedTuple):
    text: str
    kind: int
    slot: int
    own: int  # characters that aren't link text
    title: bool


class Slot(NamedTuple):
    """Elements that nest, by their place: those of two pages are the same if tags, classes, ids and roles down from the body are.

    Those of one class next to each other, posts for instance, are one slot. Order parts div elements without a class, and in an
    article all elements without one.
    """

    parent: int
    depth: int
    inside: bool  # within an article or main element, not that itself


def _key(*told: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(told).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def lines(page: str) -> list[tuple[str, int]]:
    """`blocks` without those that are ASIDE: text and kind."""
    return [(b.text, b.kind) for b in blocks(page)[0] if b.kind != ASIDE]


def blocks(page: str) -> tuple[list[Block], dict[int, Slot]]:
    """A page's blocks of text, in order, and the slots of its markup, each after the one around it; the outermost are in _ROOT.

    A block's kind is what elements tell: ASIDE in menus, sidebars, footers, forms, adverts, notices and comments, by element or by
    class, id or role, and in page headers outside an article; MAIN if it stands in an article or main element, LINKS if most of such
    a block is link text, OPEN otherwise. Scripts, styles, comments and markup are no text. Character references are decoded; white
    space becomes one space; empty blocks are left out. Digits in ids, and three or more in classes, don't part slots.
    """
    out: list[Block] = []
    slots: dict[int, Slot] = {}
    stack: list[tuple[str, bool, bool, int]] = []  # tag, left out, in an article, slot
    count: dict[tuple, int] = {}
    text: list[str] = []
    linked, in_link, title = 0, False, False

    def close() -> None:
        nonlocal linked
        if text:
            block = " ".join(entities.unescape("".join(text)).split())
            if block:
                _, skip, main, slot = stack[-1] if stack else ("", False, False, _ROOT)
                kind = ASIDE if skip else OPEN if not main else LINKS if 2 * linked > len(block) else MAIN
                out.append(Block(block, kind, slot, max(len(block) - linked, 0), title))
            text.clear()
        linked = 0

    def put(part: str) -> None:
        nonlocal linked
        if part:
            text.append(part)
            if in_link:
                linked += len(part)

    at = 0
    for m in _TAG.finditer(page):
        put(page[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            if m[1]:
                put(" ")
            continue
        tag = tag.lower()
        ends = m[2] or m[5]
        if tag == "a":
            in_link = not ends
        elif tag == "br":
            put(" ")
        if tag not in _BLOCK:
            continue
        close()
        title = tag == "h1" and not ends
        in_link = in_link and tag not in _NEST
        if tag not in _NEST:
            continue
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        _, skip, main, slot = stack[-1] if stack else ("", False, False, _ROOT)
        more = m[4] or m[7] or ""
        told = [(x[0][0].lower(), (x[1] or x[2] or x[3] or "").lower()) for x in _NAMED.finditer(more)] if more else []
        if tag != "body":
            kin = (slot, tag, " ".join(re.sub(r"\d+" if a == "i" else r"\d{3,}", "", x) for a, x in told))
            count[kin] = count.get(kin, 0) + 1
            own = Slot(slot, slots[slot].depth + 1 if slot in slots else 1, main)
            slot = _key(*kin, 0 if any(a == "c" for a, _ in told) or tag != "div" and not main else count[kin])
            slots[slot] = own
        if tag in _MAIN:
            main = True
        elif tag != "body" and not skip:
            skip = tag in _ASIDE or tag == "header" and not main
            if not skip and more:
                names = re.split(r"[^a-z]+", " ".join(x for _, x in told))
                skip = not _NAMES.isdisjoint(names) or _HIDDEN.search(more) is not None
        if not more.rstrip().endswith("/"):
            stack.append((tag, skip, main, slot))
    put(page[at:])
    close()
    return out, slots


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def shared(a: list[int], b: list[int]) -> list[int]:
    """Places in a of the lines of one longest common subsequence of a and b."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    end_a, end_b = len(a), len(b)
    while end_a > low and end_b > low and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    out = [*range(low), *range(end_a, len(a))]
    # Lines that only one has are in no common subsequence.
    common = set(a[low:end_a]) & set(b[low:end_b])
    places = [i for i in range(low, end_a) if a[i] in common]
    p, q = [a[i] for i in places], [x for x in b[low:end_b] if x in common]
    where: dict[int, int] = {}
    for i, x in enumerate(p):
        where[x] = where.get(x, 0) | 1 << i
    # Rows of bits: bit i of row j is 0 where the common subsequence of p[:i + 1] and q[:j] is longer than that of p[:i].
    full = (1 << len(p)) - 1
    rows = [full]
    for x in q:
        m = rows[-1] & where.get(x, 0)
        rows.append((rows[-1] + m | rows[-1] - m) & full)
    i, j = len(p) - 1, len(q)
    while i >= 0 and j > 0:
        if rows[j] >> i & 1:
            i -= 1
        elif rows[j - 1] >> i & 1:
            out.append(places[i])
            i, j = i - 1, j - 1
        else:
            j -= 1
    return sorted(out)


def nearest(pages: DataFrame, id_col: str, host_col: str, path_col: str, same_col: str | None = None) -> DataFrame:
    """(id, other, first): for each page the one of its host whose path is nearest, if any; of pages with equal `same_col` (copies), none is the other's.

    Pages are sorted over all partitions by host, path and id; of the last page before and the first page after that isn't a copy, on
    the same host, the one with the longer common start of the path is nearest, and the one before in a tie. A host spreads over as
    many partitions as its pages need. Each partition tells the driver its first and last row, and the next ones inwards that aren't
    copies of those, so neighbours across partitions are found too. first: of the copies that adjoin in a partition and have one
    `other`, the first one.
    """
    kind = pages.schema[id_col].dataType
    keys = pages.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(same_col or id_col).alias("same"))
    ranged = cut(keys.repartitionByRange("host", "path", "id").sortWithinPartitions("host", "path", "id"))
    edge_kind = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("place", T.IntegerType()), *keys.schema.fields])
    pair_kind = T.StructType([T.StructField("id", kind), T.StructField("other", kind), T.StructField("first", kind)])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = inner = rear = last = None
        for batch in batches:
            same = batch.column(3).to_pylist()
            for i, x in enumerate(same):
                if first is None:
                    first = batch.slice(i, 1), x
                elif inner is None and x != first[1]:
                    inner = batch.slice(i, 1), x
                if last is not None and x != last[1]:
                    rear = last
                last = (batch, i), x
        if first is not None:
            part = TaskContext.get().partitionId()
            ends = [first[0], inner and inner[0], rear and rear[0][0].slice(rear[0][1], 1), last[0][0].slice(last[0][1], 1)]
            for place, row in enumerate(ends):
                if row is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place], pa.int32()), *row.columns], names=edge_kind.names)

    parts: dict[int, dict[int, tuple]] = {}
    for r in ranged.mapInArrow(edges, edge_kind).collect():  # four rows a partition
        parts.setdefault(r["part"], {})[r["place"]] = tuple(r[2:])

    def outside(order: list[int], outer: int, inner: int) -> dict[int, list[tuple]]:
        """For each partition the nearest row of those already passed, and the nearest that isn't its copy."""
        out, near = {}, []
        for part in order:
            out[part] = near
            rows = [parts[part][x] for x in (outer, inner) if x in parts[part]]
            near = (rows + [x for x in near if x[3] != rows[-1][3]])[:2]
        return out

    before, after = outside(sorted(parts), 3, 2), outside(sorted(parts, reverse=True), 0, 1)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def choose(prev, own, following):
            near = [(len(os.path.commonprefix([own[2], x[2]])), -i, x[0]) for i, x in enumerate((prev, following)) if x is not None and x[1] == own[1]]
            return max(near, key=lambda x: x[:2])[2] if near else None

        def differing(rows, same):
            return next((x for x in rows if x[3] != same), None)

        def close(run, prev, following):
            heads = {}
            for own in run:
                # Copies on two hosts may adjoin.
                other = choose(prev, own, following)
                yield own[0], other, heads.setdefault((own[1], other), own[0])

        ids, id_kind = [], None
        prev, run = None, []
        for batch in batches:
            id_kind = batch.column(0).type
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if run and row[3] != run[0][3]:
                    ids += close(run, prev, row)
                    prev, run = run[-1], []
                if not run and prev is None:
                    prev = differing(before.get(part, []), row[3])
                run.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in ids], id_kind) for j in range(3)], names=pair_kind.names)
            ids = []
        if run:
            ids += close(run, prev, differing(after.get(part, []), run[0][3]))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in ids], id_kind) for j in range(3)], names=pair_kind.names)

    return ranged.mapInArrow(pair, pair_kind).where(F.col("other").isNotNull())


def within(slots: dict[int, Slot], of: set[int]) -> set[int]:
    """The slots that are in one of these or are one of them."""
    out = {_ROOT} & of
    for x, slot in slots.items():
        if x in of or slot.parent in out:
            out.add(x)
    return out


def varying(differences: DataFrame, share: float, least_left: float, seen: int, whole: float = 0.9, small: float = 0.2) -> DataFrame:
    """(host, main, pages, fixed): where the pages of a host differ from their nearest URLs, of (host, slot, depth, inside, own, size, both) a page and slot.

    main: the deepest slot that holds `share` of all characters in which they differ, link text apart (more than half, so there is one
    chain of them); null unless it was seen on `seen` pages, or if pages differ in less than `least_left` of their text. pages: on how
    many it was. fixed: slots within articles that hold the same text on at least `seen` pages and their nearest URLs (`whole` of it),
    and no more than `small` of the text.
    """
    slots = differences.groupBy("host", "slot").agg(F.max("depth").alias("depth"), F.max("inside").alias("inside"), F.sum("own").alias("own"), F.sum("size").alias("size"), F.sum("both").alias("both"), F.count("*").alias("pages"))
    root = slots.where(F.col("slot") == _ROOT).select("host", F.col("own").alias("all_own"), F.col("size").alias("all_size"))
    known = slots.where(F.col("pages") >= seen).join(root, "host")
    is_main = ~F.col("inside") & (F.col("slot") != _ROOT) & (F.col("own") > 0) & (F.col("own") >= share * F.col("all_own")) & (F.col("all_own") >= least_left * F.col("all_size"))
    is_fixed = F.col("inside") & (F.col("both") >= whole * F.col("size")) & (F.col("size") <= small * F.col("all_size"))
    best = F.max(F.when(is_main, F.struct("depth", "slot", "pages")))
    return known.where(is_main | is_fixed).groupBy("host").agg(best["slot"].alias("main"), best["pages"].alias("pages"), F.collect_list(F.when(is_fixed, F.col("slot"))).alias("fixed"))


def choose(found: list[Block], slots: dict[int, Slot], lost: set[int], main: int | None, sure: bool, fixed: set[int], least_left: float) -> tuple[list[str], bool]:
    """The text's blocks, and whether the slot in which the host's pages vary decided; see main_text."""
    chosen = within(slots, {main} - {None})
    same = within(slots, fixed)
    told = [(i, b) for i, b in enumerate(found) if b.kind != ASIDE]
    article = [(i, b) for i, b in told if b.kind != OPEN]
    region = [(i, b) for i, b in told if b.slot in chosen]
    inner = [(i, b) for i, b in region if b.kind != OPEN]
    by_main = bool(region) and bool(inner or not article or sure)
    if by_main and not article:
        region = [(i, b) for i, b in told if b.slot in chosen or b.title and i not in lost]
    own = (inner or region) if by_main else article or told
    kept = [b.text for i, b in own if (b.kind == MAIN or i not in lost) and b.slot not in same]
    if sum(map(len, kept)) < least_left * sum(len(b.text) for _, b in own):
        kept = [b.text for _, b in own]
    return kept, by_main


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = 500_000, least_left: float = 0.05, share: float = 0.8, seen: int = 4, sure: int = 20) -> DataFrame:
    """The article of every page: id_col, url, text (its blocks joined by \\n; empty if none), n_lines, n_removed, by_difference.

    Each page is paired with its nearest URL on the same host that isn't a copy of it (has other lines), and all their blocks, menus,
    adverts and article alike, are aligned by longest common subsequence. What the pairs of a host differ in tells two things:

    - The slot of its markup in which its pages vary (`varying`) is where the text stands, whatever its element or name. Blocks
      elsewhere go, but for a title (h1) that differs. An article or main element in that slot narrows it down. Elements and names
      decide where no slot holds `share` of the differing text on `seen` pages, where a page hasn't that slot, or where it lies apart
      from the page's article or main element and was seen on less than `sure` pages: then a page keeps that element's blocks, or all
      of its open ones. Blocks that elements or names put aside go in any case: comments and adverts differ, too.
    - Blocks that both pages have are deleted. In an article or main element, which may well quote a sentence that its neighbour
      has, only those that are mostly links are, and slots that are the same on all pages.

    If less than `least_left` of the characters would be left (of nearly equal pages, say), none of these blocks is deleted.
    by_difference: whether the slot that varies decided.

    Null html is empty; pages without a host (null URLs too), or alone on theirs, are differenced with none. Every row gives one
    row: rows that share an id, null ids too, are pages of their own, and equal rows give equal ones. Other columns are ignored.
    """
    text_batches(pages)
    kind = T.BinaryType()
    told = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (id_col, url_col, html_col)]
    base = pages.select(F.col(id_col).alias("page"), F.unhex(F.md5(F.concat_ws("\x00", *told))).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), urls.host(F.col(url_col)).alias("host"))
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    shape = [T.StructField("slot", longs), T.StructField("own", ints), T.StructField("size", ints), T.StructField("slots", longs), T.StructField("parents", longs), T.StructField("depths", ints), T.StructField("insides", T.ArrayType(T.BooleanType()))]
    hash_kind = T.StructType([T.StructField("id", kind), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("lines", longs), T.StructField("loose", T.BooleanType()), T.StructField("same", T.BinaryType()), *shape])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, loose, same, shapes = [], [], [], []
            for page in batch.column(3):
                found, slots = blocks(page.as_py() or "")
                hashes.append([_hash(b.text) for b in found])
                loose.append(any(b.kind in (OPEN, LINKS) for b in found))
                same.append(hashlib.blake2b(b"".join(x.to_bytes(8, "little", signed=True) for x, b in zip(hashes[-1], found, strict=True) if b.kind != ASIDE), digest_size=16).digest())
                used = {b.slot for b in found}
                for x in reversed(slots):
                    if x in used:
                        used.add(slots[x].parent)
                used = {x: slot for x, slot in slots.items() if x in used}
                shapes.append(([b.slot for b in found], [b.own for b in found], [len(b.text) for b in found], [*used], *([x[j] for x in used.values()] for j in range(3))))
            columns = [pa.array([x[j] for x in shapes], t) for j, t in enumerate([pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.int64())] * 2, pa.list_(pa.int32()), pa.list_(pa.bool_())])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hashes, pa.list_(pa.int64())), pa.array(loose, pa.bool_()), pa.array(same, pa.binary()), *columns], names=hash_kind.names)

    hashed = cut(base.select("id", "host", urls.path(F.col("url")).alias("path"), "html").mapInArrow(read, hash_kind).dropDuplicates(["id"]))
    pairs = cut(nearest(hashed.where(F.col("host") != ""), "id", "host", "path", "same"))
    # Of copies that adjoin, one is differenced for all.
    mine = hashed.select("id", "host", "loose", F.col("lines").alias("a"), *[x.name for x in shape]).join(pairs.where(F.col("id") == F.col("first")).select("id", "other"), "id")
    both = mine.join(hashed.select(F.col("id").alias("other"), F.col("lines").alias("b")), "other").select("id", "host", "loose", "a", "b", *[x.name for x in shape])
    part_kind = T.StructType([T.StructField("slot", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("inside", T.BooleanType()), T.StructField("own", T.LongType()), T.StructField("size", T.LongType()), T.StructField("both", T.LongType())])
    gone_kind = T.StructType([T.StructField("id", kind), T.StructField("host", T.StringType()), T.StructField("gone", ints), T.StructField("parts", T.ArrayType(part_kind))])
    part_arrow = pa.list_(pa.struct([("slot", pa.int64()), ("depth", pa.int32()), ("inside", pa.bool_()), ("own", pa.int64()), ("size", pa.int64()), ("both", pa.int64())]))

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, parts = [], []
            for loose, a, b, slot, own, size, *tree in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True):
                slots = {s: Slot(*x) for s, *x in zip(*tree, strict=True)}
                lost = shared(a, b)
                gone.append(lost if loose else [])
                lost, sums = set(lost), {x: [0, 0, 0] for x in (_ROOT, *slots)}
                for i, s in enumerate(slot):
                    sums[s][1] += size[i]
                    sums[s][2 if i in lost else 0] += size[i] if i in lost else own[i]
                for x in reversed(slots):
                    sums[slots[x].parent] = [t + u for t, u in zip(sums[slots[x].parent], sums[x], strict=True)]
                parts.append([{"slot": x, "depth": slots[x].depth if x in slots else 0, "inside": x in slots and slots[x].inside, "own": t[0], "size": t[1], "both": t[2]} for x, t in sums.items()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(gone, pa.list_(pa.int32())), pa.array(parts, part_arrow)], names=gone_kind.names)

    differed = cut(both.mapInArrow(difference, gone_kind))
    heads = differed.where(F.size("gone") > 0).select(F.col("id").alias("first"), "gone")
    gone = cut(pairs.select("id", "first").join(heads, "first").select("id", "gone"))
    sites = cut(varying(differed.select("host", F.inline("parts")), share, least_left, seen))
    out_kind = T.StructType([T.StructField("page", pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_lines", T.IntegerType()), T.StructField("n_removed", T.IntegerType()), T.StructField("by_difference", T.BooleanType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, removed, by = [], [], [], []
            for page, places, main, on, fixed in zip(batch.column(2), *[c.to_pylist() for c in batch.columns[3:]], strict=True):
                found, slots = blocks(page.as_py() or "")
                kept, by_main = choose(found, slots, set(places or ()), main, (on or 0) >= sure, set(fixed or ()), least_left)
                texts.append("\n".join(kept))
                n.append(len(kept))
                removed.append(sum(b.kind != ASIDE for b in found) - len(kept))
                by.append(by_main)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(removed, pa.int32()), pa.array(by, pa.bool_())], names=out_kind.names)

    if sites.count() <= broadcast_rows:
        right = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
        joined = base.join(right, "id", "left").join(F.broadcast(sites), "host", "left")
    else:  # html isn't shuffled by host, as one may have most pages
        right = hashed.select("id", "host").join(sites, "host").drop("host").join(gone, "id", "full")
        joined = base.join(right, "id", "left")
    return joined.select("page", "url", "html", "gone", "main", "pages", "fixed").mapInArrow(write, out_kind).withColumnRenamed("page", id_col)
