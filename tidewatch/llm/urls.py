"""URL filtering by fixed rules and by association rules of URL tokens, in DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "\x00block"


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def matched_rule(rules: list[tuple[str, str, str]], host_col: str = "host", path_col: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest of `rules`, a short list of (verdict, host, path), that fits; nulls where none does.

    A rule fits its host and all of its subdomains, if the URL's path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host_col) == h) | F.col(host_col).endswith("." + h)) & F.col(path_col).startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def tokens(host_col: str = "host", path_col: str = "path") -> Column:
    """The distinct tokens of a URL: each domain and label of its host (`h:`), and its path's parts in lower case without digits (`p:`)."""
    labels = F.filter(F.split(F.col(host_col), r"[.\-]"), lambda x: x != "")
    parts = F.filter(F.split(F.lower(F.col(path_col)), r"[^a-z]+"), lambda x: x != "")
    return F.array_distinct(F.concat(F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), F.transform(parts, lambda x: F.concat(F.lit("p:"), x)), F.array(F.concat(F.lit("s:"), F.col(host_col)))))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_rows: int = 20, min_lift: float = 1.2) -> DataFrame:
    """Association rules (antecedent, confidence, support): token combinations whose URLs are labelled to be blocked.

    labelled: (tokens, block boolean). Spark's FP-growth finds the combinations, with the label as one more token. A rule needs
    `min_support` of all labelled URLs, `min_rows` of them at least, and `min_confidence`, and must block `min_lift` times the share
    of all labelled URLs that are to be blocked; a rule is dropped if a rule over a part
    of its tokens is as confident. An empty input gives no rules.
    """
    schema = "antecedent array<string>, confidence double, support double"
    n = labelled.count()
    if n < min_rows or not n:
        return labelled.sparkSession.createDataFrame([], schema)
    items = labelled.select(F.when(F.col("block"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items"))
    # Each row has few distinct tokens, so at most 2^tokens / support combinations are frequent, whatever the number of rows.
    model = FPGrowth(minSupport=max(min_support, min_rows / n), minConfidence=min_confidence).fit(items)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK) & (F.col("lift") >= min_lift)).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    smaller = found.select(F.col("antecedent").alias("part"), F.col("confidence").alias("as_sure"), F.explode("antecedent").alias("token"))
    larger = found.withColumn("token", F.explode("antecedent"))
    within = (F.size("part") < F.size("antecedent")) & (F.size(F.array_intersect("part", "antecedent")) == F.size("part")) & (F.col("as_sure") >= F.col("confidence"))
    idle = larger.join(smaller, "token").where(within).select("antecedent").distinct()
    return found.join(idle, "antecedent", "left_anti")


def by_rarest(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Inverted index of the rules, (token, antecedent, confidence): each rule is listed under the one of its tokens that fewest URLs have."""
    counts = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    keyed = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(counts, "token", "left")
    return keyed.groupBy("antecedent", "confidence").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")).select("token", "antecedent", "confidence")


def surest(urls: DataFrame, index: DataFrame, most_rules: int = 2000) -> DataFrame:
    """urls with confidence, that of the surest rule whose tokens are all among a URL's, or null.

    Up to `most_rules` rules are held in the expression itself, so each row looks its tokens up without a join. More are joined by token
    with the distinct token lists, which are joined back to the rows.
    """
    few = index.limit(most_rules + 1).collect()
    if len(few) <= most_rules:
        if not few:
            return urls.withColumn("confidence", F.lit(None).cast("double"))
        posted: dict[str, list] = {}
        for r in few:
            posted.setdefault(r["token"], []).append(F.struct(F.array(*[F.lit(x) for x in r["antecedent"]]).alias("a"), F.lit(float(r["confidence"])).alias("c")))
        lists = F.array(*[F.struct(F.lit(t).alias("t"), F.array(*rows).alias("r")) for t, rows in sorted(posted.items())])
        near = F.flatten(F.transform(F.filter(lists, lambda e: F.array_contains(F.col("tokens"), e["t"])), lambda e: e["r"]))
        fits = F.filter(near, lambda r: F.size(F.array_except(r["a"], F.col("tokens"))) == 0)
        return urls.withColumn("confidence", F.array_max(F.transform(fits, lambda r: r["c"])))
    lists = urls.select("tokens").distinct()
    hit = lists.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return urls.join(hit.groupBy("tokens").agg(F.max("confidence").alias("confidence")), "tokens", "left")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", min_support: float = 0.002, min_confidence: float = 0.6, min_rows: int = 20, most_rules: int = 2000) -> DataFrame:
    """Judge every URL: id_col, host, path, rule, verdict, confidence.

    Where a fixed rule fits, its verdict holds. Else a URL is blocked if a mined rule fits it (confidence: the surest one's), and allowed
    otherwise. Rules are mined from the URLs that the fixed rules judge, with their verdicts, and, if given, from labels: (id_col, block
    boolean), for some pages; a null label is left out, and of several labels for an id each counts. Nulls, URLs without a
    host and repeated rows are judged like others; empty tables give no rows.
    """
    known = pages.select(F.col(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rule, verdict = matched_rule(rules)
    known = known.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("said"), tokens().alias("tokens"))
    told = known.where(F.col("said").isNotNull()).select("tokens", (F.col("said") == "block").alias("block"))
    if labels is not None:
        own = known.join(labels.select(F.col(id_col), F.col("block")).where(F.col("block").isNotNull()), id_col)
        told = told.unionByName(own.select("tokens", "block"))
    learned = mine(told, min_support, min_confidence, min_rows)
    judged = surest(known, by_rarest(told, learned), most_rules)
    confidence = F.when(F.col("said").isNull(), F.col("confidence")).alias("confidence")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("said", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), confidence)
