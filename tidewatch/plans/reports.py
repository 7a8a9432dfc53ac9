"""Report tables: what stands behind the figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import features as names_of
from tidewatch.operators import curves, learn, scoring, simulate
from tidewatch.operators import growth as G
from tidewatch.operators import windows as W
from tidewatch.plans.curves import _GEO
from tidewatch.plans.series_sql import S1, S4, indexed
from tidewatch.plans.tables import _E, _vectors
from tidewatch.registry import query, table
from tidewatch.sources import series as S

_PEAK = "pg AS (SELECT series_id, max(CASE WHEN t - t0 >= 2 AND v0 >= lo + {floor} * (hi - lo) AND v0 > 0 AND hi > lo THEN (pow(v / v0, 1.0 / (t - t0)) - 1) * 100 END) AS p FROM (SELECT series_id, t, v, min(v) OVER s AS lo, max(v) OVER s AS hi, min(t) OVER b AS t0, first_value(v) OVER b AS v0 FROM s1 WINDOW s AS (PARTITION BY series_id), b AS (PARTITION BY series_id ORDER BY t RANGE BETWEEN {width} PRECEDING AND CURRENT ROW)) GROUP BY 1)"


def _growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.segment_orders(spark, sf_dir)
    return G.geometric_growth(s).join(G.peak_growth(s), "series_id").select("series_id", "growth", "peak_growth")


@query("growth_table", f"WITH {S1}, {indexed('s1')}, geo AS (WITH {_GEO}), {_PEAK.format(floor=0.1, width=3)} SELECT series_id, growth, round(p, 6) AS peak_growth FROM geo JOIN pg USING (series_id)")
def growth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average and fastest growth of each series."""
    return _growth(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("growth", "peak_growth")})


@query("growth_medians", f"WITH {S1}, {indexed('s1')}, geo AS (WITH {_GEO}), {_PEAK.format(floor=0.1, width=3)}, j AS (SELECT series_id, growth, p FROM geo JOIN pg USING (series_id)), pledge AS (SELECT growth AS g FROM j WHERE series_id = 'BUILDING') SELECT round(median(growth), 5) AS growth, round(median(p), 5) AS peak_growth, round(avg(CASE WHEN growth < g THEN 1.0 ELSE 0.0 END), 6) AS below FROM j, pledge WHERE series_id <> 'BUILDING'")
def growth_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median rates, and the share of series that grow slower than one of them."""
    rows = _growth(spark, sf_dir)
    pledge = rows.where(F.col("series_id") == "BUILDING").select(F.col("growth").alias("g"))
    others = rows.where(F.col("series_id") != "BUILDING").crossJoin(F.broadcast(pledge))  # one row
    return others.agg(F.round(F.median("growth"), 5).alias("growth"), F.round(F.median("peak_growth"), 5).alias("peak_growth"), F.round(F.avg((F.col("growth") < F.col("g")).cast("double")), 6).alias("below"))


_CELLS = [(w, f) for w in (2, 3) for f in (0.02, 0.05, 0.10)]


@query("peak_sensitivity", f"WITH {S1} " + " UNION ALL ".join(f"SELECT {w} AS width, CAST({f} AS DOUBLE) AS floor, round(median(p), 5) AS peak_growth FROM (WITH {_PEAK.format(floor=f, width=w)} SELECT p FROM pg)" for w, f in _CELLS))
def peak_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median fastest growth by window and floor."""
    s = S.segment_orders(spark, sf_dir)
    parts = [G.peak_growth(s, w, f).agg(F.round(F.median("peak_growth"), 5).alias("peak_growth")).select(F.lit(w).alias("width"), F.lit(f).alias("floor"), "peak_growth") for w, f in _CELLS]
    return reduce(DataFrame.unionByName, parts)


@query("group_mean_heat", f"WITH {_E}, r AS (SELECT j, avg(x) AS m, stddev_pop(x) AS s FROM x WHERE label < 5 GROUP BY 1), z AS (SELECT label, j, avg((x - m) / s) AS z FROM x JOIN r USING (j) GROUP BY 1, 2), k AS (SELECT j, row_number() OVER (ORDER BY round(stddev_pop(z), 9) DESC, j) AS k FROM z GROUP BY 1) SELECT label, CAST(j AS INTEGER) AS j, round(z, 6) AS z FROM z JOIN k USING (j) WHERE k <= 16")
def group_mean_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group means, standardised by reference rows, of the sixteen features that they spread most in."""
    rows = scoring.exploded(_vectors(spark, sf_dir), "embedding", "label")
    frame = rows.where(F.col("label") < 5).groupBy("j").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = rows.join(F.broadcast(frame), "j").groupBy("label", "j").agg(F.avg((F.col("x") - F.col("m")) / F.col("s")).alias("z"))
    top = z.groupBy("j").agg(F.round(F.stddev_pop("z"), 9).alias("spread")).orderBy(F.desc("spread"), "j").limit(16).select("j")
    return z.join(F.broadcast(top), "j").select("label", "j", F.round("z", 6).alias("z"))


@query("out_of_range", f"WITH {_E}, b AS (SELECT j, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM x WHERE label < 5 GROUP BY 1) SELECT CAST(j AS INTEGER) AS j, round(avg(CASE WHEN x < lo OR x > hi THEN 1.0 ELSE 0.0 END), 6) AS outside FROM x JOIN b USING (j) WHERE label >= 5 GROUP BY 1")
def out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the other rows outside the reference's 1st to 99th percentile, by feature."""
    rows = scoring.exploded(_vectors(spark, sf_dir), "embedding", "label")
    ends = rows.where(F.col("label") < 5).groupBy("j").agg(F.percentile("x", F.lit(0.01)).alias("lo"), F.percentile("x", F.lit(0.99)).alias("hi"))
    far = (F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi"))
    return rows.where(F.col("label") >= 5).join(F.broadcast(ends), "j").groupBy("j").agg(F.round(F.avg(far.cast("double")), 6).alias("outside"))


_PROBS = "p AS (SELECT vec_id, exp(embedding[1]) AS a, exp(embedding[2]) AS b, exp(embedding[3]) AS c FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)), q AS (SELECT vec_id, a / (a + b + c) AS sn, b / (a + b + c) AS tc, c / (a + b + c) AS nl FROM p)"


def _posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.exp(F.col("embedding")[j].cast("double")) for j in range(3)]
    return table(spark, sf_dir, "embeddings").select("vec_id", *[(x / (e[0] + e[1] + e[2])).alias(n) for x, n in zip(e, ("sn", "tc", "nl"), strict=True)])


@query("abstention", f"WITH {_PROBS} SELECT CASE WHEN greatest(sn, tc, nl) <= 0.36 THEN 'undecided' WHEN sn = greatest(sn, tc, nl) THEN 'SN' WHEN tc = greatest(sn, tc, nl) THEN 'TC' ELSE 'Null' END AS said, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY 1")
def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest class, or undecided under a threshold."""
    top = F.greatest("sn", "tc", "nl")
    said = F.when(top <= 0.36, "undecided").when(F.col("sn") == top, "SN").when(F.col("tc") == top, "TC").otherwise("Null")
    return _posteriors(spark, sf_dir).groupBy(said.alias("said")).agg(F.count(F.lit(1)).alias("n"))


@query("simplex_coordinates", f"WITH {_PROBS} SELECT vec_id, round(tc + nl / 2, 6) AS x, round(nl * sqrt(3) / 2, 6) AS y, round(sn / (sn + tc + 1e-9), 6) AS u FROM q WHERE sn + tc > 0.5")
def simplex_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the triangle of three classes, and on the line between the first two, of rows that these two have most of."""
    rows = _posteriors(spark, sf_dir).where(F.col("sn") + F.col("tc") > 0.5)
    return rows.select("vec_id", F.round(F.col("tc") + F.col("nl") / 2, 6).alias("x"), F.round(F.col("nl") * F.sqrt(F.lit(3.0)) / 2, 6).alias("y"), F.round(F.col("sn") / (F.col("sn") + F.col("tc") + 1e-9), 6).alias("u"))


@query("label_stability", "WITH l AS (SELECT vec_id, s, CASE WHEN (vec_id * 7 + s * 13) % 5 < 3 THEN label ELSE (vec_id + s) % 3 END AS g FROM embeddings, range(0, 5) AS r(s)), c AS (SELECT vec_id, g, count(*) AS n FROM l GROUP BY 1, 2), m AS (SELECT vec_id, max(n) / 5.0 AS modal, count(*) = 1 AS same FROM c GROUP BY 1) SELECT round(avg(modal), 6) AS modal, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS stable FROM m")
def label_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean share of the commonest of five labels of a row, and the share of rows on which all five agree."""
    seeds = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("s"))
    g = F.when((F.col("vec_id") * 7 + F.col("s") * 13) % 5 < 3, F.col("label").cast("long")).otherwise((F.col("vec_id") + F.col("s")) % 3)
    counts = seeds.groupBy("vec_id", g.alias("g")).agg(F.count(F.lit(1)).alias("n"))
    each = counts.groupBy("vec_id").agg((F.max("n") / 5.0).alias("modal"), (F.count(F.lit(1)) == 1).alias("same"))
    return each.agg(F.round(F.avg("modal"), 6).alias("modal"), F.round(F.avg(F.col("same").cast("double")), 6).alias("stable"))


@query("group_ablation", f"WITH {_E}, c AS (SELECT label AS guess, j, avg(x) AS m FROM x GROUP BY 1, 2), d AS (SELECT k, vec_id, label, guess, round(sum((x - m) * (x - m)), 9) AS d FROM x JOIN c USING (j), range(0, 4) AS g(k) WHERE j // 16 <> k GROUP BY 1, 2, 3, 4), w AS (SELECT k, label, guess, row_number() OVER (PARTITION BY k, vec_id ORDER BY d, guess) AS r FROM d) SELECT CAST(k AS INTEGER) AS left_out, round(avg(CASE WHEN label = guess THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(196 * sqrt(avg(CASE WHEN label = guess THEN 1.0 ELSE 0.0 END) * (1 - avg(CASE WHEN label = guess THEN 1.0 ELSE 0.0 END)) / count(*)), 6) AS half_width FROM w WHERE r = 1 GROUP BY 1")
def group_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-centroid accuracy, with its 95 % half-width in points, without each sixteen of the features."""
    rows, out = _vectors(spark, sf_dir), []
    for k in range(4):
        part = rows.select("vec_id", "label", F.concat(F.slice("embedding", 1, 16 * k), F.slice("embedding", 16 * k + 17, 64)).alias("embedding"))
        hit = F.avg((F.col("label") == F.col("guess")).cast("double"))
        g = scoring.nearest_centroid(part, "embedding", "label", "vec_id").agg(hit.alias("p"), F.count(F.lit(1)).alias("n"))
        out.append(g.select(F.lit(k).alias("left_out"), F.round("p", 6).alias("accuracy"), F.round(196 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")), 6).alias("half_width")))
    return reduce(DataFrame.unionByName, out)


@query("extreme_deciles", f"WITH {S4}, r AS (SELECT series_id, t, v, percent_rank() OVER (PARTITION BY series_id ORDER BY v) AS p FROM s4) SELECT series_id, round(avg(v) FILTER (WHERE p <= 0.1), 4) AS low, round(avg(v) FILTER (WHERE p >= 0.9), 4) AS high FROM r GROUP BY 1")
def extreme_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the lowest and the highest tenth."""
    rows = S.event_days(spark, sf_dir).withColumn("p", F.percent_rank().over(Window.partitionBy("series_id").orderBy("v")))
    return rows.groupBy("series_id").agg(F.round(F.avg(F.when(F.col("p") <= 0.1, F.col("v"))), 4).alias("low"), F.round(F.avg(F.when(F.col("p") >= 0.9, F.col("v"))), 4).alias("high"))


@query("cluster_trajectories", f"WITH {S4}, x AS (SELECT series_id, t, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS x FROM s4 WINDOW w AS (PARTITION BY series_id)) SELECT t, CAST(count(*) AS BIGINT) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.9), 6) AS p90 FROM x GROUP BY 1")
def cluster_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, spread and band of normalised curves at each place."""
    rows = W.minmax(S.event_days(spark, sf_dir))
    return rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("sd"), F.round(F.percentile("x", F.lit(0.1)), 6).alias("p10"), F.round(F.percentile("x", F.lit(0.9)), 6).alias("p90"))


@query("null_ladder")
def null_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-centroid accuracy and transcritical-null confusion by the null's template, on the canonical features."""
    out = []
    for kind in ("linear", "ramp_expsat", "sigmoid", "logistic"):
        f = curves.features(simulate.benchmark(spark, 20, kind, 150), "x", names_of.CANONICAL)
        z = learn.standardise(f.select("series_id", "label", F.array(*names_of.CANONICAL).alias("x")))
        g = scoring.nearest_centroid(z, "x", "label", "series_id")
        mixed = F.count_if(((F.col("label") == 1) & (F.col("guess") == 2)) | ((F.col("label") == 2) & (F.col("guess") == 1)))
        out.append(g.agg(F.avg((F.col("label") == F.col("guess")).cast("double")).alias("accuracy"), mixed.alias("tc_null")).select(F.lit(kind).alias("kind"), "accuracy", "tc_null"))
    return reduce(DataFrame.unionByName, out)


@query("null_stages")
def null_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texture of the three kinds of null twins: mean early correlation, residual share and velocity spread."""
    rows = simulate.null_twins(spark, 20, "mixed", points=150)
    return curves.features(rows, "x", ["ac1_early", "residual_var_frac", "velocity_cv"]).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("ac1_early").alias("ac1_early"), F.avg("residual_var_frac").alias("residual"), F.avg("velocity_cv").alias("velocity_cv"))


@query("drive_observed")
def drive_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, with its 95 % half-width in points, of typing by the observed drive in each regime."""
    out = []
    for regime in simulate.REGIMES:
        f = simulate.with_drive_features(simulate.driven(spark, 30, regime)).withColumn("key", F.concat_ws("-", "name", "number"))
        g = scoring.nearest_centroid(learn.standardise(f, "f"), "f", "name", "key")
        p = F.avg((F.col("name") == F.col("guess")).cast("double"))
        out.append(g.agg(p.alias("accuracy"), F.count(F.lit(1)).alias("n")).select(F.lit(regime).alias("regime"), "n", "accuracy", (196 * F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n"))).alias("half_width")))
    return reduce(DataFrame.unionByName, out)


@query("threshold_grid", "WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings WHERE label < 2), g AS (SELECT i, -0.35 + i / 100.0 AS th FROM range(0, 71) AS r(i)), a AS (SELECT i, avg(CASE WHEN (v >= th) = (label = 1) THEN 1.0 ELSE 0.0 END) AS a FROM e, g GROUP BY 1) SELECT round(max(greatest(a, 1 - a)), 6) AS best FROM a")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best accuracy of one threshold on one feature, in either direction."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("label") < 2).select("label", F.col("embedding")[0].cast("double").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(70))).alias("i"))
    hit = (F.col("v") >= F.col("i") / 100.0 - 0.35) == (F.col("label") == 1)
    each = rows.groupBy("i").agg(F.avg(hit.cast("double")).alias("a"))
    return each.agg(F.round(F.max(F.greatest(F.col("a"), 1 - F.col("a"))), 6).alias("best"))


@query("row_sums", "SELECT p_brand, CAST(sum(coalesce(x, 0) + coalesce(y, 0)) FILTER (WHERE x IS NOT NULL OR y IS NOT NULL) AS BIGINT) AS total FROM (SELECT p_brand, CASE WHEN p_size > 25 THEN p_size END AS x, CASE WHEN p_size % 2 = 0 THEN p_size END AS y FROM part) GROUP BY 1")
def row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over columns that leave out nulls; null where all are."""
    x, y = F.when(F.col("p_size") > 25, F.col("p_size")), F.when(F.col("p_size") % 2 == 0, F.col("p_size"))
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", x.alias("x"), y.alias("y")).unpivot(["p_brand", "p_partkey"], ["x", "y"], "c", "v")
    return rows.groupBy("p_brand").agg(F.sum("v").cast("long").alias("total"))
