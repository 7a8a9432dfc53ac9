"""The training-data operators against brute force on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import common, decontamination, language, near_dup, packing, pages, quality, queries, rules, sharding, substring, urls

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def docs(spark, texts, extra=False):
    schema = "doc_id long, text string" + (", id string, part int, n int, h string, w string, same string" if extra else "")
    return spark.createDataFrame([(i, t, *(["x", 1, 2, "h", "w", "s"] if extra else [])) for i, t in enumerate(texts)], schema)


ODD = [None, "", "   \n\t ", "a", "A a a A", "x\n\nx\n", "!!!", "日本語 テキスト", "one two three four five six seven eight nine ten " * 30]


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


# --- words -------------------------------------------------------------------------------------------------------


def test_word_table_splits_like_the_pattern():
    texts = [*ODD, "Ab1-cd É_é", "x" * 100]
    h, first, end, starts, lengths = common.word_table(texts)
    seen = {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        own = [raw[a:b].decode() for a, b in zip(first[starts[i] : starts[i + 1]], end[starts[i] : starts[i + 1]], strict=True)]
        assert [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in own] == words(t)
        for w, x in zip(own, h[starts[i] : starts[i + 1]].tolist(), strict=True):
            assert seen.setdefault(words(w)[0], x) == x
        assert lengths[i] == len(raw)
    assert len(set(seen.values())) == len(seen)


def test_lean_gives_back_what_a_task_has_freed():
    def held_mb():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) / 1024

    pins = []

    @common.lean
    def run(batches):
        for batch in batches:
            blocks = [np.ones(12_000) for _ in range(2000)]  # 192 MB, in blocks too small to be mapped one by one
            pins.append(np.ones(12_000))  # above them, so that what is free lies below it
            yield batch
            del blocks

    before, most = held_mb(), 0
    for batch in run(iter(["x", "y"])):
        assert batch in "xy"
        most = max(most, held_mb())
    assert most > before + 150
    assert held_mb() < before + 60


def test_batches_of_long_texts_are_small(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("text"))
    common.text_batches(texts)
    assert max(r["n"] for r in texts.mapInArrow(sizes, "n long").collect()) < 7_000_000


# --- sharding ----------------------------------------------------------------------------------------------------


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(1)
    texts = [sentence(rng, rng.randrange(1, 200)) for _ in range(600)] + ["copy of a text"] * 60 + ODD
    out = sharding.shard(docs(spark, texts), 8).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(len(texts)))
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((t or "").encode())
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    sizes = [sum(r["size"] for r in rows) for rows in by.values()]
    assert len(by) == 8 and max(sizes) < 1.03 * min(sizes)
    shards = collections.defaultdict(set)
    for r in out:
        shards[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


def test_shards_are_even_in_bytes_tokens_and_rows(spark):
    rng = random.Random(23)
    texts = [sentence(rng, rng.randrange(1, 200), rng.choice([9, 10**9])) for _ in range(4000)]
    out = sharding.shard(docs(spark, texts), 8).groupBy("shard").agg(F.sum("size"), F.sum("tokens"), F.count("*")).collect()
    for j, most in ((1, 1.01), (2, 1.05), (3, 1.05)):
        each = [r[j] for r in out]
        assert len(each) == 8 and max(each) < most * min(each)


def test_units_go_where_the_dot_product_is_highest():
    rng = np.random.default_rng(3)
    sizes, capacity = rng.random((60, 3)) * [900, 50, 1], np.tile([900.0 * 8, 50 * 8, 8], (4, 1))
    left = capacity.copy()
    got = sharding.place(sizes, left)
    residual, scale = capacity / capacity.mean(axis=0), capacity.mean(axis=0)
    for i in sorted(range(60), key=lambda i: (-max(sizes[i] / scale), i)):
        products = [sum(w * r * u for w, r, u in zip(sharding.WEIGHTS, row, sizes[i] / scale, strict=True)) for row in residual]
        assert abs(products[got[i]] - max(products)) < 1e-9
        residual[got[i]] -= sizes[i] / scale
    assert np.allclose(left, residual * scale)


def test_a_hot_group_is_split(spark):
    texts = ["same words here"] * 500 + [f"text number {i}" for i in range(1000)]
    out = sharding.shard(docs(spark, texts), 10).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in out]
    assert len(sizes) == 10 and max(sizes) < 1.1 * min(sizes)


def test_sharding_an_empty_table(spark):
    assert sharding.shard(docs(spark, ["x"]).limit(0)).count() == 0


# --- packing -----------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    texts = [*ODD, "a <|endoftext|> b", *[r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]]
    out = packing.pack(docs(spark, texts), path(packing.VOCABULARY)).collect()
    slow = Tokenizer.from_file(path(packing.VOCABULARY))
    got = collections.defaultdict(dict)
    for r in out:
        got[r["doc_id"]][r["start"]] = r
        assert r["length"] <= 1024 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
    for i, t in enumerate(texts):
        ids, at = [], 0
        while at in got[i]:
            r = got[i][at]
            ids += np.frombuffer(r["ids"], "<u4").tolist()
            at += r["length"]
        assert ids == [*slow.encode(t or "", add_special_tokens=False).ids, 0] and at == r["doc_tokens"]
    assert sorted(r["sequence_id"] for r in out) == list(range(len(out)))
    order = sorted(out, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in order] == sorted((r["length"] for r in out), reverse=True)


def test_the_pipelines_last_stage_returns_ids(spark):
    import corpus_pipeline

    out = corpus_pipeline.pack(spark, docs(spark, ODD), SF).collect()
    assert out and all(len(r["ids"]) == 4 * r["length"] for r in out)


def test_binary_lengths():
    for n in range(1, 5000, 7):
        parts = packing.binary_lengths(n, 1024)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 1024 for p in parts) and sorted(parts, reverse=True) == parts


# --- decontamination ---------------------------------------------------------------------------------------------


def brute_contamination(texts, items, span=8):
    wins = collections.defaultdict(set)
    for k, t in items:
        w = words(t)
        m = min(len(w), span)
        for i in range(len(w) - m + 1 if w else 0):
            wins[tuple(w[i : i + m])].add(str(k))
    sizes = {len(x) for x in wins}
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (x := tuple(w[i : i + m])) in wins:
                    hit |= set(range(i, i + m))
                    found |= wins[x]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_contamination_is_exact(spark, broadcast_rows):
    rng = random.Random(2)
    items = [(i, sentence(rng, rng.choice([0, 1, 3, 7, 8, 9, 30]), 60)) for i in range(40)] + [(100, None), (101, "Hit ME, twice"), (102, "hit me twice")]
    texts = [*ODD, "hit me TWICE hit me twice"]
    for _ in range(60):
        t = sentence(rng, rng.randrange(0, 60), 60)
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1]
            t += " " + (w or "") + " " + sentence(rng, 5, 60)
        texts.append(t)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.contamination(docs(spark, texts, True), bench, broadcast_rows=broadcast_rows).withColumn("n", decontamination.covered()).collect()
    got = {r["doc_id"]: (r["n_words"], r["n"], r["item_ids"]) for r in out}
    assert [got[i] for i in range(len(texts))] == brute_contamination(texts, items)


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_rows_of_one_id_are_documents_of_their_own(spark, broadcast_rows):
    item, other = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"
    rows = [(1, f"x {item}"), (1, f"{other} y"), (1, f"{other} y"), (None, item), (None, None), (None, None), (2, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    found = decontamination.contamination(d, bench, broadcast_rows=broadcast_rows)
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(s) for s in r["spans"]], r["item_ids"]) for r in found.collect())
    assert got == [(0, 0, [], []), (0, 0, [], []), (0, 8, [(0, 8)], ["1"]), (1, 9, [(0, 8)], ["2"]), (1, 9, [(0, 8)], ["2"]), (1, 9, [(1, 8)], ["1"]), (2, 0, [], [])]
    clash = d.withColumn("_spans", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("row_key", F.lit(3))
    left = decontamination.drop_and_cut(clash, found)
    assert left.columns == clash.columns and sorted((r["doc_id"] or 0, r["text"] or "-") for r in left.collect()) == [(0, "-"), (0, "-"), (0, "-"), (1, "x "), (1, "y"), (1, "y"), (2, "-")]


def test_contamination_without_items(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs(spark, ODD), bench).where(F.size("spans") > 0).count() == 0
    assert decontamination.contamination(docs(spark, ODD).limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_leaks_are_cut(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    bench = spark.createDataFrame([(1, item), (2, "one two three four five six seven eight")], "item_id long, text string")
    texts = ["Start, Alpha beta gamma delta epsilon zeta eta THETA. End here.", item + " then one two three four five six seven eight", "clean Text", None]
    d = docs(spark, texts)
    out = {r["doc_id"]: r["text"] for r in decontamination.drop_and_cut(d, decontamination.contamination(d, bench)).collect()}
    assert out == {0: "Start, End here.", 2: "clean Text", 3: None}


def test_contamination_makes_no_rows_in_python(spark, monkeypatch):
    d = docs(spark, ["one two three four five six seven eight nine", "", None])
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine")], "item_id long, text string")

    def refuse(*args, **named):
        raise AssertionError("rows from Python take workers on the executors")

    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    out = decontamination.contamination(d, bench).collect()
    assert sorted((r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], r["item_ids"]) for r in out) == [(0, 9, [(1, 8)], ["1"]), (1, 0, [], []), (2, 0, [], [])]


# --- language ----------------------------------------------------------------------------------------------------


def test_language_accuracy_and_mixtures(spark):
    out = queries.op4_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    held = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.97
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(table)
    text = {r["lang"]: r["text"] for r in table.where("n_chars > 2000").groupBy("lang").agg(F.first("text").alias("text")).collect()}
    r = language.identify(docs(spark, [text["en"][:1500] + " " + text["fr"][:1500], None, "", "123 !!", text["de"]]), model).orderBy("doc_id").collect()
    assert {"en", "fr"} <= set(r[0]["languages"]) and 0.3 < r[0]["score"] < 0.7
    assert [x["lang_pred"] for x in r[1:]] == ["und", "und", "und", "de"] and all(0 <= x["score"] <= 1 for x in r)
    assert language.identify(docs(spark, ["text"]), language.train([], [])).first()["lang_pred"] == "und"


# --- pages -------------------------------------------------------------------------------------------------------


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(10))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        got = [a[i] for i in pages.shared(a, b)]
        it = iter(b)
        assert len(got) == table[-1, -1] and all(x in it for x in got)


def test_page_lines():
    html = '<head><title>No</title></head><body><nav><p>menu</nav><div class="cookie-notice">no</div><article class="has-sidebar"><h1>T &amp; U</h1><p>a<br>b\n <i>c</i><script>x="</p>"</script><div id=comments><p>no</div><p>last &am'
    assert pages.lines(html) == [("T & U", pages.MAIN), ("a b c", pages.MAIN), ("last &am", pages.MAIN)]
    assert pages.lines("") == [] and pages.lines("plain <3 text") == [("plain <3 text", pages.OPEN)]


def test_differencing_deletes_what_neighbours_share(spark):
    def page(body):
        return f"<body><div>Site name</div><div>{body}</div><div>All rights reserved</div></body>"

    rows = [(i, f"http://h.example/a/{i}", page(f"story number {i}")) for i in range(6)]
    rows += [(10, "http://alone.example/", page("x")), (11, None, page("y")), (12, "http://h.example/a/9", None)]
    rows += [(13, "http://z.example/1", "<article><p>quoted</p></article>"), (14, "http://z.example/2", "<article><p>quoted</p><p>own</p></article>")]
    out = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[i] for i in range(6)] == [f"story number {i}" for i in range(6)]
    assert out[10] == "Site name\nx\nAll rights reserved" and out[12] == "" and out[13] == "quoted" and out[14] == "quoted\nown"


def test_neighbours_are_those_of_the_whole_order(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), "/" + "".join(rng.choice("xy") for _ in range(6))) for i in range(200)]
    got = {r["id"]: r["other"] for r in pages.nearest(spark.createDataFrame(rows, "page_id long, host string, path string").repartition(7), "page_id", "host", "path").collect()}
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))

    def common_start(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    for i, r in enumerate(order):
        near = [(common_start(r[2], order[j][2]), -k, order[j][0]) for k, j in enumerate((i - 1, i + 1)) if 0 <= j < len(order) and order[j][1] == r[1]]
        assert got[r[0]] == max(near)[2]


def test_pages_of_one_id_are_pages_of_their_own(spark):
    body = lambda x: f"<body><div>Site name</div><div>{x}</div></body>"
    rows = [(1, "http://h.example/a", body("one")), (1, "http://h.example/b", body("two")), (1, "http://h.example/b", body("two")), (None, "http://h.example/c", body("three")), (None, None, None), (None, None, None)]
    out = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in out) == [(0, ""), (0, ""), (0, "three"), (1, "one"), (1, "two"), (1, "two")]


def test_differencing_finds_what_no_name_tells(spark):
    """Without article elements or telling names, only differencing parts a page's text from its site's; the nearest URL has the same template."""
    rng = random.Random(21)
    template = {kind: [sentence(rng, 4, 10**6) for _ in range(5)] for kind in ("news", "shop")}
    rows, want = [], {}
    for i in range(40):
        kind = ("news", "shop")[i % 2]
        own = [sentence(rng, 12, 10**6) for _ in range(rng.randrange(1, 6))]
        t = template[kind]
        rows.append((i, f"http://h.example/{kind}/{i}", "<body>" + "".join(f"<div>{x}</div>" for x in [*t[:3], *own, *t[3:]]) + "</body>"))
        want[i] = "\n".join(own)
    out = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert {r["page_id"]: r["text"] for r in out} == want and all(r["n_removed"] == 5 for r in out)
    alone = pages.main_text(spark.createDataFrame([(i, None, h) for i, _, h in rows], "page_id long, url string, html string")).collect()
    assert all(r["text"] != want[r["page_id"]] for r in alone)


def test_copies_are_not_each_others_neighbours(spark):
    def page(body):
        return f"<body><div>Site name</div><div>{body}</div><div>All rights reserved</div></body>"

    rows = [(i, f"http://h.example/a/1?v={i}", page("one story")) for i in range(40)]
    rows += [(40, "http://h.example/b/1", page("other story")), (41, "http://h.example/b/1", page("other story"))]
    rows += [(50 + i, f"http://copies.example/{i}", page("same")) for i in range(5)]
    long = " ".join(f"word{i}" for i in range(300))
    rows += [(60 + i, f"http://near.example/{i}", page(f"{long}</div><div>visit {i}")) for i in range(5)]
    rows += [(70 + i, f"http://art.example/{i}", "<article><p>text</p><p><a href=x>linked words</a></p></article>") for i in range(3)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    out = {r["page_id"]: r["text"] for r in pages.main_text(d).collect()}
    assert {out[i] for i in range(40)} == {"one story"} and out[40] == out[41] == "other story"
    assert {out[50 + i] for i in range(5)} == {"Site name\nsame\nAll rights reserved"}
    assert all(long in out[60 + i] for i in range(5)) and {out[70 + i] for i in range(3)} == {"text\nlinked words"}


def test_differencing_finds_the_slot_that_varies(spark):
    """Menus, adverts and footers that no neighbour shares and no name tells are parted from the text by where a host's pages vary."""
    rng = random.Random(22)
    rows, want = [], {}
    for i in range(60):
        host = "abc"[i % 3]
        own = [sentence(rng, 30, 10**6) for _ in range(rng.randrange(1, 6))]
        menu = "".join(f"<li><a href=x>{sentence(rng, 1, 10**6)}</a>" for _ in range(5))
        ad, foot = sentence(rng, 5, 10**6), sentence(rng, 4, 10**6)
        posts = "".join(f'<div class="c2" id="p{i}"><p>{x}</p></div>' for x in own)
        body = {"a": f"<div><ul>{menu}</ul></div><div>{ad}</div><div><p>{'<p>'.join(own)}</div><div>{foot}</div>", "b": f'<div class="c1">{ad}</div><div class="banner"><p>{foot}</p></div><h1>Title {i}</h1>{posts}', "c": f"<div>{ad}</div><div class=story><p>{'<p>'.join(own)}<div class=comments>{foot}</div></div>"}[host]
        rows.append((i, f"http://{host}.example/{rng.randrange(10**6)}", f"<body><div>Site name</div>{body}</body>"))
        want[i] = "\n".join([f"Title {i}"] * (host == "b") + own)
    for most in (500_000, 0):
        out = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), broadcast_rows=most).collect()
        assert {r["page_id"]: r["text"] for r in out} == want and all(r["by_difference"] for r in out)


def test_differencing_and_elements(spark):
    rng = random.Random(23)
    rows, want = [], {}

    def add(host, own, page):
        rows.append((len(rows), f"http://{host}.example/{rng.randrange(10**6)}", page))
        want[len(rows) - 1] = own

    for i in range(24):
        own, short = sentence(rng, 30, 10**6), sentence(rng, 3, 10**6)
        # A notice in the main element that all pages have goes; a quoted sentence stays.
        add("notice", f"{own}\n{short}\nquoted", f"<main><div>Read our terms</div><div><p>{own}</p></div><p>{short}</p><p>quoted</p></main>")
        # Teasers are article elements here, the text is not: differencing decides where it is sure.
        add("teasers", own, f"<div class=text>{own}</div><article>{short}</article>")
        if i < 5:
            add("few", short, f"<div class=text>{own}</div><article>{short}</article>")
            # Comments outweigh the text.
            add("talk", short, f"<div class=text>{short}</div><div class=comments>{own}</div>")
    out = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert {r["page_id"]: r["text"] for r in out} == want
    assert {r["url"].split("/")[2] for r in out if r["by_difference"]} == {"notice.example", "teasers.example"}


def test_given_pages_without_names(spark):
    """The given pages' articles are found by differencing alone on hosts of four pages, but for paragraphs that the nearest page has too."""
    given = common.plain(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), "page_id", "url", "html")
    bare = F.regexp_replace(F.regexp_replace("html", "<(nav|article|footer|div class=.ad.)>", "<div>"), "</(nav|article|footer)>", "</div>")
    want = {r["page_id"]: r["text"].split("\n") for r in pages.main_text(given).collect()}
    out = [(r["text"].split("\n"), want[r["page_id"]]) for r in pages.main_text(given.withColumn("html", bare)).collect() if r["by_difference"]]
    assert len(out) >= 150 and sum(a == b for a, b in out) >= 0.9 * len(out) and all(set(a) <= set(b) for a, b in out)


# --- URLs --------------------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    cases = {
        "http://Sub.Example.com/en/1?x=/en/": ("sub.example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://a.net/fr/x#y": ("a.net", "/fr/x", "net/fr/", "block"),
        "http://a.net?/fr/": ("a.net", "", None, "allow"),
        "x.com/en/": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    table = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, block boolean")
    for i, r in enumerate(urls.filter_urls(table, queries.URL_RULES, none).orderBy("page_id").collect()):
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == list(cases.values())[i]


def test_mined_rules_match_brute_force(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        h, p = rng.choice(["casino", "news", "shop"]), rng.choice(["win", "read", "buy"])
        rows.append((i, f"http://{h}.example.org/{p}/{i}"))
        if i % 2:
            labels.append((i, h == "casino" and p == "win" or rng.random() < 0.05))
    table = spark.createDataFrame(rows, "page_id long, url string")
    out = urls.filter_urls(table, [], spark.createDataFrame(labels, "page_id long, block boolean"), min_rows=5).collect()
    for r in out:
        assert (r["verdict"] == "block") == (r["host"].startswith("casino") and r["path"].startswith("/win"))


def test_mining_by_enumeration(spark):
    import itertools

    rng = random.Random(17)
    rows = []
    for _ in range(200):
        t = sorted(rng.sample("abcdef", rng.randrange(1, 5)))
        rows.append((t, ("a" in t and "b" in t) or rng.random() < 0.2))
    rules = {}
    for size in range(1, 5):
        for ante in itertools.combinations("abcdef", size):
            own = [block for t, block in rows if set(ante) <= set(t)]
            if sum(own) >= 10 and sum(own) / len(own) >= 0.5 and not any(set(r) < set(ante) and c >= sum(own) / len(own) for r, c in rules.items()):
                rules[ante] = sum(own) / len(own)
    mined = urls.mine(spark.createDataFrame(rows, "tokens array<string>, block boolean"), 0.01, 0.5, 10, 0.0)
    got = {tuple(r["antecedent"]): r["confidence"] for r in mined.collect()}
    assert got.keys() == rules.keys() and len(got) > 1 and all(abs(got[k] - v) < 1e-12 for k, v in rules.items())
    lists = spark.createDataFrame([(i, [*t, "z"]) for i, (t, _) in enumerate(rows)], "i int, tokens array<string>")
    index = urls.by_rarest(lists, mined)
    for most in (2000, 0):
        for r in urls.surest(lists, index, most).collect():
            want = max((v for k, v in rules.items() if set(k) <= set(r["tokens"])), default=None)
            assert r["confidence"] is None if want is None else abs(r["confidence"] - want) < 1e-12


def test_mined_rules_judge_given_pages(spark):
    out = queries.op6_url_filter(spark, "/root/testdata/sf0.01").collect()
    mined = [r for r in out if r["confidence"] is not None]
    assert mined and all(r["rule"] is None and r["verdict"] == "block" for r in mined)
    assert any(r["rule"] is None and r["verdict"] == "allow" for r in out)


# --- passages ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [{}, {"hot_sample": 1, "hot_count": 3, "hot_parts": 3}])
def test_every_long_exact_repeat_is_found(spark, hot):
    rng = random.Random(6)
    passage = [sentence(rng, n, 5000) for n in (50, 60, 120, 30)]
    texts = [*ODD]
    for i in range(80):
        t = [sentence(rng, rng.randrange(5, 120), 5000)]
        if i % 3 == 0:
            t.append(passage[i % 4])
        if i % 5 == 0:
            t.insert(0, passage[(i + 1) % 4])
        texts.append(". ".join([*t, sentence(rng, 20, 5000)]))
    out = substring.passages(docs(spark, texts, True), **hot).collect()
    covered = collections.defaultdict(set)
    for r in out:
        covered[r["doc_id"]] |= set(range(r["first"], r["end"]))
        assert r["other"] < r["doc_id"] and r["end"] - r["first"] >= 50
    seen, want = {}, collections.defaultdict(set)
    for i, t in enumerate(texts):
        w = words(t)
        for j in range(len(w) - 49):
            g = tuple(w[j : j + 50])
            if seen.setdefault(g, i) != i:
                want[i] |= set(range(j, j + 50))
    assert want and all(v <= covered[i] for i, v in want.items())
    assert set(covered) == set(want)


def test_fuzzy_passage_and_removal(spark):
    rng = random.Random(7)
    p = sentence(rng, 90, 10_000).split()
    q = list(p)
    q[30], q[61:62] = "changed", []
    texts = ["Head one. " + " ".join(p) + ". Tail one.", "Other start: " + " ".join(q) + ". Other end.", None, "clean"]
    d = docs(spark, texts)
    found = substring.passages(d)
    r = found.collect()
    assert len(r) == 1 and (r[0]["doc_id"], r[0]["other"], r[0]["first"], r[0]["end"]) == (1, 0, 2, 91)
    assert [x["text"] for x in substring.remove(d, found).orderBy("doc_id").collect()] == [texts[0], "Other start: Other end.", None, "clean"]


@pytest.mark.parametrize("hot", [{}, {"hot_sample": 1, "hot_count": 3, "hot_parts": 3}])
def test_a_passage_twice_in_one_document_is_found_twice(spark, hot):
    rng = random.Random(11)
    p = sentence(rng, 80, 50_000)
    texts, places = [sentence(rng, 20, 50_000) + " " + p], []
    for times in (2, 3, 2, 1):
        w, own = sentence(rng, 30, 50_000).split(), set()
        for _ in range(times):
            own |= set(range(len(w), len(w) + 80))
            w += p.split() + sentence(rng, 70, 50_000).split()
        texts.append(" ".join(w))
        places.append(own)
    covered = collections.defaultdict(set)
    for r in substring.passages(docs(spark, texts), **hot).collect():
        covered[r["doc_id"]] |= set(range(r["first"], r["end"]))
        assert r["other"] < r["doc_id"]
    assert [covered[i] for i in range(len(texts))] == [set(), *places]


@pytest.mark.parametrize("hot", [{}, {"hot_sample": 1, "hot_count": 2, "hot_parts": 3}])
def test_parts_in_later_texts_hide_no_passage(spark, hot):
    # Each 4-mer of the passage is in a text of its own between the two that have all of it.
    rng = random.Random(25)
    fresh = lambda n: sentence(rng, n, 10**6).split()
    p = fresh(60)
    texts = [fresh(20) + p + fresh(10), *[fresh(30) + p[i : i + 5] + fresh(30) for i in range(0, 56, 2)], fresh(25) + p + fresh(30)]
    out = substring.passages(docs(spark, [" ".join(t) for t in texts]), **hot).collect()
    assert [(r["doc_id"], r["first"], r["end"], r["other"], r["other_first"], r["other_end"], r["n_same"]) for r in out] == [(len(texts) - 1, 25, 85, 0, 20, 80, 60)]


def test_parts_of_a_partly_rewritten_copy_are_found(spark):
    rng = random.Random(12)
    fresh = lambda n: sentence(rng, n, 10**6).split()
    texts, want = [], []
    # Words that agree and words of each text's own, in turn: a rewritten copy, two passages apart, a passage and a phrase.
    for agree, own in (([60, 60, 60, 60], 40), ([50, 50], 45), ([50, 9], 45)):
        a, b, places = fresh(15), fresh(25), set()
        for n in agree:
            p = fresh(n)
            if n >= 50:
                places |= set(range(len(b), len(b) + n))
            a += p + fresh(own)
            b += p + fresh(own)
        texts += [" ".join(a), " ".join(b)]
        want += [set(), places]
    covered = collections.defaultdict(set)
    for r in substring.passages(docs(spark, texts)).collect():
        covered[r["doc_id"]] |= set(range(r["first"], r["end"]))
        assert r["n_same"] >= 0.8 * (r["other_end"] - r["other_first"])
    assert [covered[i] for i in range(len(texts))] == want


def test_recall_of_fuzzy_passages(spark):
    rng = random.Random(13)
    fresh = lambda n: sentence(rng, n, 10**6).split()
    texts, want = [], {}
    for size in (50, 55, 60, 70, 80):
        for every in (5, 6, 7, 8, 10, 20):
            for _ in range(6):
                p = fresh(size)
                changed = range(rng.randrange(every), size, every) if rng.random() < 0.5 else rng.sample(range(1, size - 1), size // every)
                q = [f"new{rng.randrange(10**6)}" if i in changed else w for i, w in enumerate(p)]
                texts += [" ".join(fresh(30) + p + fresh(30)), " ".join(fresh(40) + q + fresh(20))]
                same = [i for i in range(size) if i not in changed]
                if same[-1] + 1 - same[0] >= 50 and len(same) >= 0.8 * (same[-1] + 1 - same[0]):
                    want[len(texts) - 1] = set(range(40 + same[0], 41 + same[-1]))
    covered = collections.defaultdict(set)
    for r in substring.passages(docs(spark, texts)).collect():
        covered[r["doc_id"]] |= set(range(r["first"], r["end"]))
    found = sum(len(covered[i] & v) >= 0.8 * len(v) for i, v in want.items())
    print("recall", found, "of", len(want))
    assert len(want) > 120 and found >= 0.98 * len(want)


def test_chains_are_best(spark):
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(1, 7)
        x, y = [rng.randrange(30) for _ in range(n)], [rng.randrange(30) for _ in range(n)]
        for c in substring.chains(x, y, 6):
            assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:], strict=False))
        assert sorted(i for c in substring.chains(x, y, 6) for i in c) == list(range(n))
    assert substring.common_length([1, 2, 3, 4], [2, 9, 4, 1]) == 2


def test_the_best_chain_by_brute_force():
    rng = random.Random(18)
    for _ in range(300):
        m = rng.randrange(1, 9)
        x, y, n = [rng.randrange(60) for _ in range(m)], [rng.randrange(60) for _ in range(m)], [rng.randrange(4, 20) for _ in range(m)]
        inner = [max(1, v - 3) for v in n]
        best = [0.0] * m
        for i in sorted(range(m), key=lambda i: x[i]):
            before = [best[j] - 0.1 * (x[i] - x[j] - n[j] + y[i] - y[j] - n[j]) for j in range(m) if x[j] + inner[j] <= x[i] and y[j] + inner[j] <= y[i]]
            best[i] = n[i] + max([0.0, *before])
        c = substring.chains(x, y, n)[0]
        value = n[c[0]]
        for a, b in zip(c, c[1:], strict=False):
            value += n[b] - 0.1 * (x[b] - x[a] - n[a] + y[b] - y[a] - n[a])
        assert abs(value - max(best)) < 1e-9


def test_a_far_strong_chain_hides_no_near_run():
    # A long run far away, then two that lie close to each other.
    found = substring.chains([0, 330, 336], [0, 330, 340], [234, 4, 4])
    assert any({1, 2} <= set(c) for c in found)
    assert any({1, 2} <= set(c) for c in substring.chains([0, 330, 336], [0, 330, 340], [30, 4, 4]))


@pytest.mark.parametrize("shape", [{"bucket_seeds": 50}, {"bucket_seeds": 50, "most_buckets": 4}])
def test_buckets_change_no_passage(spark, shape):
    rng = random.Random(19)
    p = [sentence(rng, 70, 10**6) for _ in range(4)]
    texts = [sentence(rng, rng.randrange(60), 10**6) + " " + rng.choice(p) + " " + sentence(rng, 20, 10**6) for _ in range(40)] + ODD
    rows = lambda **x: sorted(substring.passages(docs(spark, texts, True), **x).collect())
    assert rows() == rows(**shape) and len(rows()) >= 30


def test_seeds_link_to_their_last_place_in_a_lesser_text():
    import pyarrow as pa

    from tidewatch.llm import seeds

    rng = random.Random(20)
    for ids in ([5, 3, 9, 7], ["b", "a", "d", "c"]):
        texts = [[rng.randrange(6) for _ in range(rng.randrange(1, 9))] for _ in ids]
        first = np.cumsum([0, *[len(t) for t in texts]])[:-1]
        h = np.array([v for t in texts for v in t], np.uint64)
        rows = seeds.packed(pa.array(ids), first, h, np.arange(len(h)), h.astype(np.int64) % 2, True)
        got = set()
        for bucket in (0, 1):
            own = [(a, b, c) for k, a, b, c in zip(*rows, strict=True) if k == bucket]
            if own:
                a, x, b, y = seeds.last_places(*seeds.unpacked(own, True))
                got |= set(zip(a.to_pylist(), x.tolist(), b.to_pylist(), y.tolist(), strict=True))
        want = set()
        for i, t in zip(ids, texts, strict=True):
            for at, v in enumerate(t):
                before = [(j, p) for j, u in zip(ids, texts, strict=True) if j < i for p, w in enumerate(u) if w == v]
                if before:
                    want.add((i, at, *max(before)))
        assert got == want


# --- near duplicates ---------------------------------------------------------------------------------------------


def shingle_sets(texts, k=5):
    out = []
    for t in texts:
        w, seen, s = words(t), collections.Counter(), set()
        for g in [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([tuple(w)] if w else []):
            seen[g] += 1
            s.add((g, seen[g]))
        out.append(s)
    return out


def alike(a, b, least=0.8):
    """Whether the words that agree, in order, are `least` of all words of two texts."""
    p, q = words(a), words(b)
    row = [0] * (len(q) + 1)
    for x in p:
        last = 0
        for j, y in enumerate(q, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] >= least * (len(p) + len(q) - row[-1]) - 1e-9 if p and q else (a or "") == (b or "")


@pytest.mark.parametrize("full_bucket", [12, 2])
def test_near_duplicates_by_brute_force(spark, full_bucket):
    rng = random.Random(9)
    texts = [*ODD]
    for _ in range(12):
        base = sentence(rng, rng.randrange(40, 200), 8000).split()
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w).capitalize() + rng.choice(["", ".", "!"]))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and alike(texts[i], texts[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs(spark, texts, True), full_bucket=full_bucket).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


@pytest.mark.parametrize("full_bucket", [12, 2])
def test_near_duplicates_of_short_texts(spark, full_bucket):
    rng = random.Random(14)
    texts, pairs = [], 0
    for size in [*range(8, 15), *range(20, 30)]:
        for _ in range(6):
            w = sentence(rng, size, 10**6).split()
            own = [w, [*w, "more"], ["more", *w], [*w[1:], "last"], ["first", *w, "last"]]
            texts += [" ".join(x) for x in [w, own[rng.randrange(1, 5)]]]
    want = list(range(len(texts)))
    for i in range(0, len(texts), 2):
        if alike(texts[i], texts[i + 1]):
            want[i + 1] = i
            pairs += 1
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs(spark, texts), full_bucket=full_bucket).collect()}
    assert pairs > 50 and [got[i] for i in range(len(texts))] == want


def test_full_buckets_lose_no_edited_copy(spark):
    # A passage that all texts have fills buckets with many classes; copies differ in up to a ninth of their words, all outside of it.
    rng = random.Random(23)
    passage, texts, want = sentence(rng, 90, 10**6).split(), [], []
    for _ in range(30):
        own = sentence(rng, 40, 10**6).split()
        base = len(texts)
        for edits in (0, 8, 13):
            w = list(own)
            for i in rng.sample(range(40), edits):
                w[i] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w[:20] + passage + w[20:]))
            assert alike(texts[base], texts[-1])
            want.append(base)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_parities_differ_no_more_than_words(spark):
    rng = random.Random(24)
    for _ in range(50):
        a, b = (sentence(rng, rng.randrange(1, 60), 30) for _ in range(2))
        h, _, _, starts, _ = common.word_table([a, b])
        labelled, first = near_dup.shingles(h, starts, 1)
        sets = [set(labelled[first[i] : first[i + 1]].tolist()) for i in (0, 1)]
        p = near_dup.parities(labelled, first)
        assert sum(int(x).bit_count() for x in (p[:, 0] ^ p[:, 1]).view(np.uint64)) <= len(sets[0] ^ sets[1])


def test_recall_of_edited_copies(spark):
    rng = random.Random(15)
    found, pairs, texts = collections.Counter(), collections.Counter(), []
    for rate in (0.01, 0.02, 0.03, 0.05, 0.08, 0.1):
        for size in (40, 100, 300, 900):
            for _ in range(10):
                w = sentence(rng, size, 10**6).split()
                q = list(w)
                for i in rng.sample(range(size), round(rate * size)):
                    q[i] = rng.choice([f"e{rng.randrange(10**6)}", "", f"{q[i]} e{rng.randrange(10**6)}"])
                texts += [" ".join(w), " ".join(q)]
                pairs[rate] += alike(*texts[-2:])
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs(spark, texts)).collect()}
    for i in range(0, len(texts), 2):
        if alike(texts[i], texts[i + 1]):
            found[[0.01, 0.02, 0.03, 0.05, 0.08, 0.1][i // 80]] += got[i] == got[i + 1]
        else:
            assert got[i] != got[i + 1]
    print("recall", {r: f"{found[r]} of {pairs[r]}" for r in pairs})
    assert all(found[r] >= 0.9 * pairs[r] for r in pairs) and sum(found.values()) >= 0.97 * sum(pairs.values())


def test_banded_alignment_by_brute_force():
    rng = random.Random(16)
    for _ in range(300):
        a = [rng.randrange(5) for _ in range(rng.randrange(1, 14))]
        b = [rng.randrange(5) for _ in range(rng.randrange(1, 14))]
        band = rng.randrange(0, 14)
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                row[i][j] = max(row[i - 1][j], row[i][j - 1], row[i - 1][j - 1] + 1 if x == y and abs(i - j) <= band else 0)
        got = near_dup.common_words(np.array(a, np.uint64), np.array(b, np.uint64), band)
        assert row[-1][-1] <= got <= row[-1][-1] if abs(len(a) - len(b)) <= band else got >= row[-1][-1]


def test_near_duplicates_of_null_ids(spark):
    d = spark.createDataFrame([(1, "a b c"), (None, "a b c"), (None, None), (2, "a b c")], "doc_id long, text string")
    assert sorted((r[0] or 0, r[1] or 0, r[2]) for r in near_dup.near_duplicates(d).collect()) == [(0, 0, 1), (0, 0, 1), (1, 1, 2), (2, 1, 2)]


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0
    assert {r["class_id"] for r in near_dup.near_duplicates(docs(spark, ["x y z", "x y z", "x y z"])).collect()} == {0}


# --- quality -----------------------------------------------------------------------------------------------------


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    unary, move = rng.normal(size=7), rng.normal(size=(2, 2))
    first = np.array([0, 3, 4, 7])
    p, pairs, z = quality.marginals(unary, move, first)
    want_p, want_pairs, want_z = np.zeros(7), np.zeros((2, 2)), 0.0
    for a, b in zip(first, first[1:], strict=False):
        n, total = b - a, 0.0
        mass, own_pairs = np.zeros(n), np.zeros((2, 2))
        for code in range(1 << n):
            y = [(code >> i) & 1 for i in range(n)]
            w = np.exp(sum(unary[a + i] * y[i] for i in range(n)) + sum(move[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            mass += w * np.array(y)
            for i in range(n - 1):
                own_pairs[y[i], y[i + 1]] += w
        want_p[a:b] = mass / total
        want_pairs += own_pairs / total
        want_z += np.log(total)
    assert np.allclose(p, want_p) and np.allclose(pairs, want_pairs) and z == pytest.approx(want_z)


def test_quality_accuracy_and_odd_texts(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
    model = quality.fit(spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet"))
    scores = [r["score"] for r in quality.score(docs(spark, ODD, True), model).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert quality.score(docs(spark, ["x"]), None).first()["score"] == 0.5


# --- rules -------------------------------------------------------------------------------------------------------


def brute_features(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
    wins = collections.defaultdict(list)
    for i in range(len(w) - 2):
        wins[tuple(w[i : i + 3])].append(i)
    hit = {i + j for places in wins.values() if len(places) > 1 for i in places for j in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))


def test_word_features(spark):
    rng = random.Random(10)
    texts = [*ODD, *["".join(rng.choice("ab \n#\t|") for _ in range(rng.randrange(200))) for _ in range(200)]]
    out = rules.word_features(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out] == [brute_features(t) for t in texts]


def test_cascade_says_the_same_in_any_order(spark):
    d = docs(spark, [sentence(random.Random(i), i) for i in range(100)])
    some = [rules.Rule("short", ("chars",), lambda c: c < 50), rules.Rule("even", ("id",), lambda i: i % 2 == 0), rules.Rule("null", ("none",), lambda x: x)]
    known = {"chars": F.length("text"), "id": F.col("doc_id"), "none": F.lit(None).cast("boolean")}
    a, b = ({r["doc_id"]: r["rejected_by"] is None for r in rules.cascade(d, order, known).collect()} for order in (some, some[::-1]))
    assert a == b and {k for k, v in a.items() if v} == {i for i in range(100) if i % 2 and len(sentence(random.Random(i), i)) >= 50}
    assert rules.cascade(d.limit(0), some, known).count() == 0


def test_costs_are_those_of_the_raw_text(spark):
    """A rule that needs a dear feature costs more than one that needs a cheap one, and so comes later though it rejects as many."""
    d = common.cut(docs(spark, [sentence(random.Random(i), 3000, 60) for i in range(300)]).coalesce(1))
    raw = rules.raw_features()
    both = [rules.Rule("a_dear", ("n_repeat_words",), lambda n: n > 10), rules.Rule("b_cheap", ("n_lines",), lambda n: n > 0)]
    order = rules.cascade_order(d, both, raw)
    assert [r.name for r, _, _ in order] == ["b_cheap", "a_dear"] and all(share == 1.0 for _, _, share in order)
    plan = rules.cascade(d, both, raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("b_cheap") < plan.index("a_dear")


def test_raw_features_agree_with_the_columns(spark):
    rng = random.Random(22)
    d = docs(spark, [*ODD, *["".join(rng.choice("ab \n#\t|") for _ in range(rng.randrange(200))) for _ in range(100)]])
    raw = rules.raw_features()
    out = rules.word_features(d).select(*[(F.col(f) == raw[f]).alias(f) for f in rules.FEATURES]).collect()
    assert all(all(r) for r in out)
    clash = rules.word_features(d.withColumn("w", F.lit(1)).withColumn("_w", F.lit(2)).withColumn("__h", F.lit(3)))
    assert clash.count() == d.count() and {"w", "_w", "__h"} <= set(clash.columns)


# --- queries and pipeline ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_its_sql_rows(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    r = con.sql(queries.ORACLES[name])
    order = [r.columns.index(c) for c in names]
    assert sorted((tuple(x[c] for c in names) for x in df.collect()), key=repr) == sorted((tuple(x[i] for i in order) for x in r.fetchall()), key=repr)


def test_pipeline_stages(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    d = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, d, SF))
        assert out.columns == table.columns, name
        before = {r["doc_id"]: r["text"] for r in d.collect()}
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before)
        if name == "near_duplicates":
            sets = shingle_sets(after.values())
            assert max((len(a & b) / max(1, len(a | b)) for i, a in enumerate(sets) for b in sets[:i]), default=0) < 0.8
        if name == "passages":
            seen = {}
            for i in sorted(after):
                w = words(after[i])
                assert all(seen.setdefault(tuple(w[j : j + 50]), i) == i for j in range(len(w) - 49))
        if name == "benchmark":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert all(n_hit == 0 for _, n_hit, _ in brute_contamination(after.values(), items))
        d = out
    packed = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    assert packed.agg(F.sum("length")).first()[0] == packed.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    for name, texts in (("odd", ODD), ("none", [])):
        sf = f"{tmp_path}/{name}"
        schema = T.StructType.fromDDL("doc_id long, text string, lang string, source string, n_chars long")
        spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)] + ([(None, "a null id", None, None, 1), (3, "a", None, None, 1)] if texts else []), schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{sf}/pages.parquet")
        import corpus_pipeline

        assert (corpus_pipeline.run(spark, sf).count() > 0) == bool(texts)
        for q in queries.QUERIES:
            if q != "pipeline":
                queries.QUERIES[q](spark, sf).count()


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_filter_bits_reach_the_driver_packed(spark):
    h = np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 5000)
    rows = spark.createDataFrame([(int(v),) for v in h], "h long")
    slots, shifts = 1 << 20, (0, 18, 37)
    bits = np.unpackbits(substring.filter_bits(rows, slots, shifts))
    want = np.zeros(slots, np.uint8)
    for j in shifts:
        want[((h.view(np.uint64) >> np.uint64(j)) % np.uint64(slots)).astype(np.int64)] = 1
    assert len(bits) == slots and (bits == want).all()
