"""Queries of projections, gates, joins, aggregates, scores and samples over the sales, event and embedding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import sampling, scoring
from tidewatch.plans.series_sql import S1, S2, S4
from tidewatch.registry import query, table
from tidewatch.sources import series as S


@query("year_from_month_code", "SELECT CAST((year(o_orderdate) * 100 + month(o_orderdate)) // 100 AS INTEGER) AS y, CAST(count(*) AS BIGINT) AS n FROM orders WHERE (year(o_orderdate) * 100 + month(o_orderdate)) // 100 < 1998 GROUP BY 1")
def year_from_month_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year of a YYYYMM code, without the last, partial year."""
    code = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.floor(code / 100).cast("int").alias("y")).where(F.col("y") < 1998).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query("excluded_groups", "SELECT n_name, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name NOT IN ('NATION_0', 'NATION_3') AND c_mktsegment <> 'BUILDING' GROUP BY 1")
def excluded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed exclusion lists."""
    nation = table(spark, sf_dir, "nation").where(~F.col("n_name").isin("NATION_0", "NATION_3")).select("n_nationkey", "n_name")
    return table(spark, sf_dir, "customer").where(F.col("c_mktsegment") != "BUILDING").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("era_bucket", "SELECT era, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN y > 0 AND y <= 1995 THEN 0 WHEN y > 1995 AND y <= 1998 THEN 1 WHEN y > 1998 AND y <= 3000 THEN 2 END AS era FROM (SELECT year(o_orderdate) AS y FROM orders)) GROUP BY 1")
def era_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    era = C.bucket(F.year("o_orderdate"), [0, 1995, 1998, 3000])
    return table(spark, sf_dir, "orders").select(era.alias("era")).groupBy("era").agg(F.count(F.lit(1)).alias("n"))


@query("scale_tag", "SELECT CASE WHEN lower(trim(r_name)) IN ('world', 'global', 'asia') THEN 'global' ELSE 'national' END AS scale, CAST(count(*) AS BIGINT) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def scale_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    return table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(C.scale_tag(F.col("r_name"), ("world", "global", "asia")).alias("scale")).agg(F.count(F.lit(1)).alias("n"))


@query("name_contains", "SELECT p_brand, CAST(count(*) FILTER (WHERE contains(lower(p_name), 'ring')) AS BIGINT) AS rings, CAST(count(*) FILTER (WHERE NOT coalesce(contains(p_name, 'red'), false)) AS BIGINT) AS not_red FROM part GROUP BY 1")
def name_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contains without case, and its negation that keeps nulls."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(F.lower("p_name").contains("ring")).alias("rings"), F.count_if(~F.coalesce(F.col("p_name").contains("red"), F.lit(False))).alias("not_red"))


@query("exploded_words", "SELECT w, CAST(count(DISTINCT p_brand) AS BIGINT) AS brands, CAST(count(*) AS BIGINT) AS n FROM (SELECT p_brand, trim(unnest(string_split(p_name, ' '))) AS w FROM part) WHERE w NOT IN ('', 'nan', 'other') GROUP BY 1")
def exploded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, explode, trim, drop fillers, count distinct."""
    words = table(spark, sf_dir, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("w")).withColumn("w", F.trim("w")).where(~F.col("w").isin("", "nan", "other"))
    return words.groupBy("w").agg(F.countDistinct("p_brand").alias("brands"), F.count(F.lit(1)).alias("n"))


@query("lookup_with_default", "SELECT n_name, round(coalesce(s, 0.0), 2) AS balance FROM nation LEFT JOIN (SELECT s_nationkey, CAST(sum(CAST(s_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS s FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) ON s_nationkey = n_nationkey")
def lookup_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left lookup, 0 where there is none."""
    sums = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 9000).groupBy("s_nationkey").agg(F.sum(S.money(F.col("s_acctbal"))).cast("double").alias("s"))
    return table(spark, sf_dir, "nation").join(sums, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.round(F.coalesce("s", F.lit(0.0)), 2).alias("balance"))


_POLICY = "c AS (SELECT s_nationkey AS k, count(*) AS a, count(*) FILTER (WHERE s_acctbal > 5000) AS b, count(DISTINCT s_suppkey % 7) AS c FROM supplier GROUP BY 1)"


@query("composite_index", f"WITH {_POLICY} SELECT k, round(((a - min(a) OVER ()) / greatest(max(a) OVER () - min(a) OVER (), 1) + (b - min(b) OVER ()) / greatest(max(b) OVER () - min(b) OVER (), 1) + (c - min(c) OVER ()) / greatest(max(c) OVER () - min(c) OVER (), 1)) / 3, 6) AS idx FROM c")
def composite_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each count min-max scaled over the groups (0 in a constant one), then their mean."""
    counts = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("s_acctbal") > 5000).alias("b"), F.countDistinct(F.col("s_suppkey") % 7).alias("c"))
    ends = counts.agg(*[f(c).alias(f"{n}_{c}") for c in "abc" for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = [(F.col(c) - F.col(f"lo_{c}")) / F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(1)) for c in "abc"]
    return counts.crossJoin(F.broadcast(ends)).select("k", F.round(sum(scaled[1:], scaled[0]) / 3, 6).alias("idx"))


@query("last_by_group", "SELECT c_mktsegment AS seg, max(y) FILTER (WHERE s = 'F') AS f, max(y) FILTER (WHERE s = 'O') AS o FROM (SELECT c_mktsegment, o_orderstatus AS s, arg_max(o_totalprice, o_orderkey) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1")
def last_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each group, pivoted."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("seg")).pivot("o_orderstatus", ["F", "O"]).agg(F.max_by("o_totalprice", "o_orderkey")).select("seg", F.col("F").alias("f"), F.col("O").alias("o"))


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 14")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(14)


@query("capped_rank", "SELECT p_partkey, p_brand, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 2 ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def capped_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.capped_rank(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice", "p_partkey", 2, 10)


@query("pooled_totals", "SELECT coalesce(event_type, 'POOLED') AS family, CAST(count(*) AS BIGINT) AS n, round(median(value), 6) AS median, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS above FROM events GROUP BY GROUPING SETS ((event_type), ())")
def pooled_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families and all together."""
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    return rows.groupingSets([[F.col("event_type")], []], "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("value"), 6).alias("median"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("above")).select(F.coalesce("event_type", F.lit("POOLED")).alias("family"), "n", "median", "above")


@query("quantile_table", "SELECT o_orderpriority AS p, " + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 4) AS q{int(q * 100)}" for q in (0.01, 0.1, 0.25, 0.75, 0.9, 0.99)) + " FROM orders GROUP BY 1")
def quantile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(*[F.round(F.percentile("o_totalprice", F.lit(q)), 4).alias(f"q{int(q * 100)}") for q in (0.01, 0.1, 0.25, 0.75, 0.9, 0.99)])


@query("percentile_of_pledge", f"WITH {S2}, g AS (SELECT series_id, avg(v) AS m FROM s2 GROUP BY 1) SELECT round(100.0 * avg(CASE WHEN m < (SELECT m FROM g WHERE series_id = '7') THEN 1.0 ELSE 0.0 END), 6) AS share FROM g WHERE series_id <> '7'")
def percentile_of_pledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the other series under one series' level."""
    means = S.nation_share(spark, sf_dir).groupBy("series_id").agg(F.avg("v").alias("m"))
    pledge = means.where(F.col("series_id") == "7").select(F.col("m").alias("pledge"))
    return means.where(F.col("series_id") != "7").crossJoin(F.broadcast(pledge)).agg(F.round(100.0 * F.avg((F.col("m") < F.col("pledge")).cast("double")), 6).alias("share"))


@query("event_frequency", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users, round(stddev_pop(value), 6) AS sd FROM events GROUP BY 1")
def event_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.stddev_pop("value"), 6).alias("sd"))


@query("json_field", "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.from_json("props", "k int").alias("p")).groupBy(F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("tier_membership", f"WITH {S2}, f AS (SELECT series_id, count(*) AS n, max(v) AS peak, min(v) AS lo FROM s2 GROUP BY 1), t AS (SELECT 'all' AS tier, series_id FROM f UNION ALL SELECT 'long', series_id FROM f WHERE n >= 20 UNION ALL SELECT 'long_high', series_id FROM f WHERE n >= 20 AND peak >= 60) SELECT tier, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1")
def tier_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.operators.curation import tiers

    facts = S.nation_share(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("peak"))
    rules = {"all": (None, F.lit(True)), "long": ("all", F.col("n") >= 20), "long_high": ("long", F.col("peak") >= 60)}
    return tiers(facts, rules).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("tier_semi_anti", f"WITH {S2}, f AS (SELECT series_id FROM s2 GROUP BY 1 HAVING max(v) >= 60) SELECT 'in' AS side, CAST(count(*) AS BIGINT) AS n FROM s2 WHERE series_id IN (SELECT series_id FROM f) UNION ALL SELECT 'out', CAST(count(*) AS BIGINT) FROM s2 WHERE series_id NOT IN (SELECT series_id FROM f)")
def tier_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.nation_share(spark, sf_dir)
    high = s.groupBy("series_id").agg(F.max("v").alias("m")).where(F.col("m") >= 60).select("series_id")
    inside = s.join(high, "series_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit("in").alias("side"), "n")
    return inside.unionByName(s.join(high, "series_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("out").alias("side"), "n"))


_SPEARMAN = f"WITH {S4}, r AS (SELECT series_id, rank() OVER (PARTITION BY series_id ORDER BY t) + (count(*) OVER (PARTITION BY series_id, t) - 1) / 2 AS rx, rank() OVER (PARTITION BY series_id ORDER BY v) + (count(*) OVER (PARTITION BY series_id, v) - 1) / 2 AS ry FROM s4) SELECT series_id, round(covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0), 6) AS rho FROM r GROUP BY 1"


@query("spearman_rank", _SPEARMAN)
def spearman_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.spearman(S.event_days(spark, sf_dir), "t", "v", ["series_id"]).select("series_id", F.round("rho", 6).alias("rho"))


_E = "x AS (SELECT vec_id, label, unnest(range(0, 64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


@query("pearson_pairs", f"WITH {_E} SELECT CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round(covar_pop(a.x, b.x) / nullif(sqrt(var_pop(a.x) * var_pop(b.x)), 0), 6) AS r FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.j < b.j GROUP BY 1, 2 HAVING abs(covar_pop(a.x, b.x) / nullif(sqrt(var_pop(a.x) * var_pop(b.x)), 0)) > 0.08")
def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature pairs of high correlation, from one matrix of sums: rows are not joined with each other."""
    import numpy as np

    from tidewatch.operators.learn import moments

    _, _, c = moments(_vectors(spark, sf_dir).withColumn("x", F.col("embedding").cast("array<double>")))
    sd = np.sqrt(np.diag(c))
    r = c / np.outer(sd, sd)
    pairs = [(int(i), int(j), round(float(r[i, j]), 6)) for i, j in zip(*np.triu_indices(len(r), 1), strict=True) if abs(r[i, j]) > 0.08]
    return spark.createDataFrame(pairs, "i int, j int, r double")


@query("eta_squared", f"WITH {_E}, p AS (SELECT j, label, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY 1, 2) SELECT CAST(j AS INTEGER) AS j, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n) + 1e-12), 6) AS eta2 FROM p GROUP BY 1")
def eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.exploded(_vectors(spark, sf_dir), "embedding", "label")
    return scoring.eta_squared(rows, "x", "label", ["j"]).select("j", F.round("eta2", 6).alias("eta2"))


@query("bimodality", f"WITH {_E}, m AS (SELECT j, count(*) AS n, avg(x) AS m, sum(x * x) / count(*) AS a, sum(x * x * x) / count(*) AS b, sum(x * x * x * x) / count(*) AS c FROM x GROUP BY 1), k AS (SELECT j, n, (b - 3 * m * a + 2 * m * m * m) / pow(a - m * m, 1.5) AS g, (c - 4 * m * b + 6 * m * m * a - 3 * m * m * m * m) / ((a - m * m) * (a - m * m)) AS k FROM m) SELECT CAST(j AS INTEGER) AS j, round((g * g + 1) / (k - 3 + 3.0 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))), 6) AS bc, round((g * g + 1) / (k + 1e-6), 6) AS bc_raw FROM k")
def bimodality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.exploded(_vectors(spark, sf_dir), "embedding", "label")
    return scoring.bimodality(rows, "x", ["j"]).select("j", F.round("bc", 6).alias("bc"), F.round("bc_raw", 6).alias("bc_raw"))


_NEAR = f"WITH {_E}, c AS (SELECT label AS guess, j, avg(x) AS m FROM x GROUP BY 1, 2), d AS (SELECT vec_id, label, guess, round(sum((x - m) * (x - m)), 9) AS d FROM x JOIN c USING (j) GROUP BY 1, 2, 3), g AS (SELECT vec_id, label, guess FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, guess) AS k FROM d) WHERE k = 1)"


@query("nearest_centroid", f"{_NEAR} SELECT vec_id, label, guess FROM g")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.nearest_centroid(_vectors(spark, sf_dir), "embedding", "label", "vec_id")


@query("confusion_matrix", f"{_NEAR} SELECT label AS truth, guess, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM g GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.contingency(nearest_centroid(spark, sf_dir), "label", "guess").withColumn("share", F.round("share", 6))


@query("precision_recall", f'{_NEAR}, t AS (SELECT label AS class, count(*) AS p FROM g GROUP BY 1), s AS (SELECT guess AS class, count(*) AS q FROM g GROUP BY 1), r AS (SELECT label AS class, count(*) AS tp FROM g WHERE label = guess GROUP BY 1), z AS (SELECT t.class, coalesce(tp, 0) / greatest(coalesce(q, 0), 1) AS precision, coalesce(tp, 0) / greatest(p, 1) AS recall FROM t LEFT JOIN s ON s.class = t.class LEFT JOIN r ON r.class = t.class) SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / greatest(precision + recall, 1e-9), 6) AS f1 FROM z')
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.precision_recall(nearest_centroid(spark, sf_dir), "label", "guess")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("adjusted_rand", f"{_NEAR}, n AS (SELECT label, guess, count(*) AS n FROM g GROUP BY 1, 2), v AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS ij, (SELECT sum(a * (a - 1) / 2) FROM (SELECT sum(n) AS a FROM n GROUP BY label)) AS i, (SELECT sum(b * (b - 1) / 2) FROM (SELECT sum(n) AS b FROM n GROUP BY guess)) AS j, (SELECT sum(n) FROM n) AS n) SELECT round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) AS ari FROM v")
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.adjusted_rand(nearest_centroid(spark, sf_dir), "label", "guess").select(F.round("ari", 6).alias("ari"))


@query("auc_rank", "WITH c AS (SELECT n_chars AS s, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality <> 1) AS q FROM labels JOIN documents USING (doc_id) GROUP BY 1), b AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c) SELECT round(sum(p * (b + q / 2)) / (sum(p) * sum(q)), 6) AS auc FROM b")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a text's length tells its quality label."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return scoring.auc(rows, "n_chars", F.col("quality") == 1).select(F.round("auc", 6).alias("auc"))


@query("silhouette_euclid", f"WITH {_E}, d AS (SELECT a.vec_id AS k, a.label AS l, b.vec_id AS k2, b.label AS l2, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM x a JOIN x b ON a.j = b.j AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3, 4), m AS (SELECT k, l, l2, avg(d) AS d FROM d GROUP BY 1, 2, 3), e AS (SELECT k, max(d) FILTER (WHERE l = l2) AS a, min(d) FILTER (WHERE l <> l2) AS b FROM m GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM e")
def silhouette_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.silhouette(_vectors(spark, sf_dir), "embedding", "label", "vec_id").select(F.round("silhouette", 6).alias("silhouette"))


@query("calinski_harabasz", f"WITH {_E}, p AS (SELECT j, label, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY 1, 2), w AS (SELECT j, sum(n) AS n, count(*) AS k, sum(q - s * s / n) AS w, sum(s * s / n) - sum(s) * sum(s) / sum(n) AS b FROM p GROUP BY 1) SELECT round(sum(b) / (max(k) - 1) / (sum(w) / (max(n) - max(k))), 6) AS ch FROM w")
def calinski_harabasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.calinski_harabasz(_vectors(spark, sf_dir), "embedding", "label").select(F.round("ch", 6).alias("ch"))


@query("davies_bouldin", f"WITH {_E}, c AS (SELECT label, j, avg(x) AS m FROM x GROUP BY 1, 2), s AS (SELECT label, avg(d) AS s FROM (SELECT vec_id, x.label AS label, sqrt(sum((x - m) * (x - m))) AS d FROM x JOIN c ON c.label = x.label AND c.j = x.j GROUP BY 1, 2) GROUP BY 1), a AS (SELECT p.label AS a, q.label AS b, sqrt(sum((p.m - q.m) * (p.m - q.m))) AS d FROM c p JOIN c q ON p.j = q.j AND p.label <> q.label GROUP BY 1, 2), r AS (SELECT a, max((u.s + v.s) / d) AS r FROM a JOIN s u ON u.label = a JOIN s v ON v.label = b GROUP BY 1) SELECT round(avg(r), 6) AS db FROM r")
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.davies_bouldin(_vectors(spark, sf_dir), "embedding", "label").select(F.round("db", 6).alias("db"))


_KEY = "(((({k} % 1000003) * 48271 + {k}) % 2147483647))"


@query("hopkins", f"WITH {_E}, k AS (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY {_KEY.format(k='vec_id')}, vec_id) AS r FROM embeddings) WHERE r <= 100), p AS (SELECT vec_id AS probe, vec_id AS own, j, x AS v FROM x JOIN k USING (vec_id) UNION ALL SELECT 100000000 + vec_id, NULL, j, x * 1.5 + 0.01 FROM x JOIN k USING (vec_id)), d AS (SELECT probe, own IS NULL AS made, x.vec_id, sqrt(sum((x - v) * (x - v))) AS d FROM x JOIN p ON p.j = x.j AND (own IS NULL OR own <> x.vec_id) GROUP BY 1, 2, 3), m AS (SELECT probe, made, min(d) AS d FROM d GROUP BY 1, 2) SELECT round(sum(d) FILTER (WHERE made) / sum(d), 6) AS hopkins FROM m")
def hopkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a hundred sampled rows, and a hundred places made from them."""
    v = _vectors(spark, sf_dir).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    picked = v.orderBy(sampling.order_key(F.col("vec_id")), "vec_id").limit(100)
    real = picked.select(F.col("vec_id").alias("probe"), F.col("embedding").alias("v"), F.col("vec_id").alias("own"))
    made = picked.select((F.col("vec_id") + 100_000_000).alias("probe"), F.transform("embedding", lambda x: x * 1.5 + 0.01).alias("v"), F.lit(None).cast("long").alias("own"))
    return scoring.hopkins(v, real.unionByName(made), "embedding", "vec_id").select(F.round("hopkins", 6).alias("hopkins"))


@query("stratified_split", f"WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_KEY.format(k='vec_id')}, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, label, CASE WHEN r <= floor(0.7 * n) THEN 'train' WHEN r <= floor(0.7 * n) + floor(0.15 * n) THEN 'validation' ELSE 'test' END AS part FROM r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(_vectors(spark, sf_dir).select("vec_id", "label"), "label", "vec_id")


@query("balanced_sample", f"SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_KEY.format(k='vec_id')}, vec_id) AS r FROM embeddings) WHERE r <= 20")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced(_vectors(spark, sf_dir).select("vec_id", "label"), "label", "vec_id", 20)


@query("matched_sample", f"WITH e AS (SELECT event_id, event_type, value FROM events), g AS (SELECT max(a) AS lo, min(b) AS hi, count(*) AS k FROM (SELECT event_type, min(value) AS a, max(value) AS b FROM e GROUP BY 1)), r AS (SELECT e.*, k, CAST(floor((value - lo) / (hi - lo) * 18) AS INTEGER) AS bin FROM e, g WHERE value >= lo AND value < hi), m AS (SELECT bin, min(n) AS n FROM (SELECT bin, event_type, count(*) AS n, max(k) AS k FROM r GROUP BY 1, 2) GROUP BY bin HAVING count(*) = max(k)), z AS (SELECT r.*, m.n AS least, row_number() OVER (PARTITION BY r.bin, event_type ORDER BY {_KEY.format(k='event_id')}, event_id) AS rk FROM r JOIN m ON m.bin = r.bin) SELECT event_id, event_type, bin FROM z WHERE rk <= least")
def matched_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many events of each type in each value bin."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return sampling.matched(rows, "event_type", "value", "event_id").select("event_id", "event_type", "bin")


@query("series_level_table", f"WITH {S1} SELECT series_id, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(stddev_pop(v), 4) AS sd, CAST(count(*) AS BIGINT) AS n FROM s1 GROUP BY 1")
def series_level_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segment_orders(spark, sf_dir).groupBy("series_id").agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.median("v"), 4).alias("median"), F.round(F.stddev_pop("v"), 4).alias("sd"), F.count(F.lit(1)).alias("n"))


@query("method_agreement", f"{_NEAR}, m AS (SELECT vec_id, 'a' AS method, label AS g FROM g UNION ALL SELECT vec_id, 'b', guess FROM g UNION ALL SELECT vec_id, 'c', CAST(vec_id % 10 AS INTEGER) FROM g) SELECT p.method AS m1, q.method AS m2, round(avg(CASE WHEN p.g = q.g THEN 1.0 ELSE 0.0 END), 6) AS agree FROM m p JOIN m q ON p.vec_id = q.vec_id AND p.method < q.method GROUP BY 1, 2")
def method_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows on which two labelings agree, for each pair of labelings."""
    g = nearest_centroid(spark, sf_dir)
    long = g.select("vec_id", F.explode(F.create_map(F.lit("a"), F.col("label"), F.lit("b"), F.col("guess"), F.lit("c"), (F.col("vec_id") % 10).cast("int"))).alias("method", "g"))
    other = long.select("vec_id", F.col("method").alias("m2"), F.col("g").alias("g2"))
    return long.withColumnRenamed("method", "m1").join(other, "vec_id").where(F.col("m1") < F.col("m2")).groupBy("m1", "m2").agg(F.round(F.avg((F.col("g") == F.col("g2")).cast("double")), 6).alias("agree"))
