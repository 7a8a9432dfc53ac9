"""opN_ queries over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, language, near_dup, packing, pages, quality, rules, sharding, substring, urls
from tidewatch.llm.common import plain, table_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table_dir(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    out = packing.pack(table_dir(spark, sf_dir, "documents"), path(packing.VOCABULARY))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 8) AS m, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, dw.m, item FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
n_items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN n_items USING (doc_id)
"""


@query("op3_decontamination", OP3_SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(table_dir(spark, sf_dir, "documents"), table_dir(spark, sf_dir, "benchmark"))
    n = F.size("item_ids").cast("long")
    return out.select("doc_id", "n_words", decontamination.covered().cast("long").alias("n_hit"), n.alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_dir(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out()))
    return language.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages", "proportions")


#: The article elements of the given pages, whose other parts all stand outside of them. The operator takes more kinds of pages.
OP5_SQL = r"""
WITH b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(p|h1)>'),
  lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM pages)
SELECT page_id, url, array_to_string(l, chr(10)) AS text, CAST(length(array_to_string(l, chr(10))) AS BIGINT) AS n_chars, CAST(len(l) AS INTEGER) AS n_lines FROM b
"""


@query("op5_html_text", OP5_SQL)
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table_dir(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines")


#: The given rules.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: All combinations of each URL's tokens, counted: only a few tokens make that possible.
OP6_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
g AS (SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/' WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
t AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said,
  list_distinct(list_concat(list_concat(list_transform(list_filter(string_split_regex(host, '[.\-]'), lambda x: x <> ''), lambda x: 'h:' || x), list_transform(list_filter(string_split_regex(lower(path), '[^a-z]+'), lambda x: x <> ''), lambda x: 'p:' || x)), ['s:' || host])) AS tokens FROM g),
m AS (SELECT said, tokens, unnest(range(1, CAST(1 AS BIGINT) << len(tokens))) AS mask FROM t WHERE said IS NOT NULL),
a AS (SELECT said, list_sort(list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1)) AS ante FROM m),
c AS (SELECT ante, count(*) AS n, count(*) FILTER (said = 'block') AS n_block FROM a GROUP BY ante),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (said = 'block') AS DOUBLE) AS n_block FROM t WHERE said IS NOT NULL),
f AS (SELECT ante, CAST(c.n_block AS DOUBLE) / c.n AS sure FROM c, n WHERE c.n_block >= ceil(greatest(CAST(0.002 AS DOUBLE), CAST(20 AS DOUBLE) / n.n) * n.n) AND CAST(c.n_block AS DOUBLE) / c.n >= 0.6 AND CAST(c.n_block AS DOUBLE) / c.n / (n.n_block / n.n) >= 1.2),
r AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f AS q WHERE len(q.ante) < len(f.ante) AND list_has_all(f.ante, q.ante) AND q.sure >= f.sure)),
h AS (SELECT rid, max(sure) AS confidence FROM t, r WHERE list_has_all(tokens, ante) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN confidence IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN said IS NULL THEN confidence END AS confidence FROM t LEFT JOIN h USING (rid)
"""


@query("op6_url_filter", OP6_SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table_dir(spark, sf_dir, "pages"), URL_RULES)


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain(table_dir(spark, sf_dir, "documents"), "doc_id", "text")
    model = quality.fit(table_dir(spark, sf_dir, "labels").where(~held_out()), docs)
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table_dir(spark, sf_dir, "documents"))


@query("op9_near_duplicates")
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table_dir(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: len(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
f AS (SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(len(t) - len(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  len(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps, len(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters, len(t) - len(replace(t, '!', '')) AS shouts, len(t) - len(replace(t, chr(10), '')) + 1 AS n_lines
  FROM d LEFT JOIN rep USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars > 18 * n_words OR word_chars < 2 * n_words OR n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines OR 2 * caps > letters OR 10 * shouts > n_words) AS kept
FROM g
"""


@query("op10_quality_rules", OP10_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain(table_dir(spark, sf_dir, "documents"), "doc_id", "text")
    judged = rules.cascade(docs, rules.production_rules(), rules.raw_features(), ready=rules.FEATURES, prepare=rules.word_features)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
