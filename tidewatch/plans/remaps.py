"""Queries of remapped schemas, joins by position, fixed categories, held-out scores, verdicts and equilibrium branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import scoring
from tidewatch.plans.tables import _E, _NEAR, nearest_centroid
from tidewatch.registry import query, table


@query("schema_remap", "SELECT 'W' || lpad(CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS VARCHAR), 4, '0') AS series_id, 'World' AS region, upper(r_name) AS name, CAST(NULL AS INTEGER) AS parent FROM region UNION ALL SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0'), r_name, upper(n_name), CAST(n_regionkey AS INTEGER) FROM nation JOIN region ON n_regionkey = r_regionkey")
def schema_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World rows in the regional schema, with numbered ids, and the regional rows; the numbered table is a fixed dimension."""
    region = table(spark, sf_dir, "region")
    at = F.row_number().over(Window.orderBy("r_regionkey")) - 1
    world = region.select(F.concat(F.lit("W"), F.lpad(at.cast("string"), 4, "0")).alias("series_id"), F.lit("World").alias("region"), F.upper("r_name").alias("name"), F.lit(None).cast("int").alias("parent"))
    nation = table(spark, sf_dir, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return world.unionByName(nation.select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0")).alias("series_id"), F.col("r_name").alias("region"), F.upper("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("parent")))


@query("positional_join", "SELECT CAST(i AS INTEGER) AS i, r_name, n_name FROM (SELECT row_number() OVER (ORDER BY r_regionkey) AS i, r_name FROM region) JOIN (SELECT row_number() OVER (ORDER BY n_name) AS i, n_name FROM nation) USING (i)")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row i of one dimension with row i of another, each in a stated order."""
    left = table(spark, sf_dir, "region").select(F.row_number().over(Window.orderBy("r_regionkey")).alias("i"), "r_name")
    right = table(spark, sf_dir, "nation").select(F.row_number().over(Window.orderBy("n_name")).alias("i"), "n_name")
    return left.join(right, "i")


#: The categories of the report, in order; one that the tables lack shows as 0.
CATEGORIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD", "SHIPBUILDING"]


@query("category_reindex", "SELECT CAST(c.i AS INTEGER) AS place, c.category, CAST(count(c_custkey) AS BIGINT) AS n, round(coalesce(avg(c_acctbal), 0), 4) AS balance FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES)) + ") AS c(i, category) LEFT JOIN customer ON c_mktsegment = c.category GROUP BY 1, 2")
def category_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and means by a fixed list of categories, in its order."""
    dim = spark.createDataFrame(list(enumerate(CATEGORIES)), "place int, category string")
    found = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("category")).agg(F.count("c_custkey").alias("n"), F.avg("c_acctbal").alias("balance"))
    return dim.join(found, "category", "left").select("place", "category", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("balance", F.lit(0.0)), 4).alias("balance"))


@query("best_k", "WITH s AS (SELECT p_brand, p_size AS k, CASE WHEN count(*) >= 2 THEN round(avg(p_retailprice), 4) END AS score FROM part GROUP BY 1, 2), m AS (SELECT *, max(score) OVER (PARTITION BY p_brand) AS top, min(k) OVER (PARTITION BY p_brand) AS least FROM s) SELECT p_brand, CAST(coalesce(min(CASE WHEN score = top THEN k END), any_value(least)) AS INTEGER) AS k, max(score) AS score FROM m GROUP BY 1")
def best_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand's sizes the first of best score; scores of single parts are NaN, and a brand without others has its least size."""
    score = F.when(F.count(F.lit(1)) >= 2, F.round(F.avg("p_retailprice"), 4)).otherwise(F.lit(float("nan")))
    rows = table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").alias("k")).agg(score.alias("score"))
    return scoring.best_k(rows, "k", "score", ["p_brand"]).select("p_brand", F.col("k").cast("int").alias("k"), "score")


_HELD = f"WITH {_E}, c AS (SELECT label AS guess, j, avg(x) AS m FROM x WHERE vec_id % 2 = 0 GROUP BY 1, 2), d AS (SELECT vec_id, label, guess, round(sum((x - m) * (x - m)), 9) AS d FROM x JOIN c USING (j) WHERE vec_id % 2 = 1 GROUP BY 1, 2, 3), g AS (SELECT vec_id, label, guess FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, guess) AS k FROM d) WHERE k = 1)"


@query("held_out_centroid", f"{_HELD} SELECT label, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN label = guess THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM g GROUP BY 1")
def held_out_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows, by the parity of their key, give the centroids; the other half is judged."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    judged = scoring.nearest_centroid(rows.where(F.col("vec_id") % 2 == 1), "embedding", "label", "vec_id", rows.where(F.col("vec_id") % 2 == 0))
    return judged.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("guess")).cast("double")), 6).alias("accuracy"))


#: From which share on a verdict holds, the best first.
VERDICTS = [(0.9, "separable"), (0.6, "partly separable"), (0.3, "weak")]
_CASES = " ".join(f"WHEN share >= {v} THEN '{t}'" for v, t in VERDICTS)


@query("verdict_rules", f"{_NEAR}, s AS (SELECT label, avg(CASE WHEN label = guess THEN 1.0 ELSE 0.0 END) AS share FROM g GROUP BY 1) SELECT label, round(share, 6) AS share, CASE {_CASES} ELSE 'none' END AS verdict FROM s")
def verdict_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = nearest_centroid(spark, sf_dir).groupBy("label").agg(F.avg((F.col("label") == F.col("guess")).cast("double")).alias("share"))
    verdict = F.lit("none")
    for least, said in reversed(VERDICTS):
        verdict = F.when(F.col("share") >= least, said).otherwise(verdict)
    return shares.select("label", F.round("share", 6).alias("share"), verdict.alias("verdict"))


@query("equilibrium_branches", "WITH g AS (SELECT i, i / 50.0 - 1.5 AS x FROM range(0, 151) AS r(i)) SELECT 'fold' AS kind, CAST(i AS INTEGER) AS i, round(x * x * x - x, 6) AS mu, round(x, 6) AS x, CASE WHEN 3 * x * x > 1 THEN 'stable' ELSE 'unstable' END AS branch FROM g UNION ALL SELECT 'exchange', CAST(i AS INTEGER), round(x, 6), 0.0, CASE WHEN x < 0 THEN 'stable' ELSE 'unstable' END FROM g UNION ALL SELECT 'exchange', CAST(i + 151 AS INTEGER), round(x, 6), round(x, 6), CASE WHEN x > 0 THEN 'stable' ELSE 'unstable' END FROM g")
def equilibrium_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rest states against the drive: mu = x^3 - x with its two folds, and x = 0 and x = mu, which exchange stability."""
    g = spark.range(151).select(F.col("id").cast("int").alias("i"), (F.col("id") / 50.0 - 1.5).alias("x"))
    state = lambda stable: F.when(stable, "stable").otherwise("unstable").alias("branch")
    x, rounded = F.col("x"), F.round("x", 6)
    fold = g.select(F.lit("fold").alias("kind"), "i", F.round(x * x * x - x, 6).alias("mu"), rounded.alias("x"), state(3 * x * x > 1))
    still = g.select(F.lit("exchange").alias("kind"), "i", rounded.alias("mu"), F.lit(0.0).alias("x"), state(x < 0))
    moving = g.select(F.lit("exchange").alias("kind"), (F.col("i") + 151).alias("i"), rounded.alias("mu"), rounded.alias("x"), state(x > 0))
    return fold.unionByName(still).unionByName(moving)
