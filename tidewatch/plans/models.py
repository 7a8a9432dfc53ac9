"""Queries of the array, simulation, detection, curation and mixture operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import curation, curves, ews, learn, scoring, simulate, skewed
from tidewatch.plans.series_sql import PCHIP, S1, S4, residual, scaled, tau
from tidewatch.registry import query, table
from tidewatch.sources import series as S


def _arrays(df: DataFrame) -> DataFrame:
    return S.to_arrays(df).select("series_id", "v")


def _logistics(spark: SparkSession, n: int = 40) -> DataFrame:
    """Logistic curves of several rates and midpoints on 80 places, made from a range of ids."""
    k, t0 = 6 + F.col("id") % 10, 0.3037 + 0.05 * (F.col("id") % 9)
    x = F.transform(F.sequence(F.lit(0), F.lit(79)), lambda i: 1 / (1 + F.exp(-k * (i / 79.0 - t0))))
    return spark.range(n).select(F.col("id").cast("string").alias("series_id"), x.alias("v"))


_CURVE = "c AS (SELECT id, i, i / 79.0 AS t, 1 / (1 + exp(-(6 + id % 10) * (i / 79.0 - (0.3037 + 0.05 * (id % 9))))) AS x FROM range(0, 40) AS a(id), range(0, 80) AS b(i)), d AS (SELECT *, CASE WHEN nx IS NULL THEN (x - px) * 79.0 WHEN px IS NULL THEN (nx - x) * 79.0 ELSE (nx - px) * 79.0 / 2 END AS dx FROM (SELECT *, lead(x) OVER w AS nx, lag(x) OVER w AS px FROM c WINDOW w AS (PARTITION BY id ORDER BY i)))"


@query("feat_groupB", f"WITH {_CURVE}, m AS (SELECT *, max(dx) OVER (PARTITION BY id) AS top, max(x) OVER (PARTITION BY id) AS mx FROM d), e AS (SELECT id, min(CASE WHEN dx = top THEN i END) AS k, min(CASE WHEN x >= 0.9 * mx THEN t END) AS s, min(CASE WHEN x >= 0.1 * greatest(mx, 0.1) THEN t END) AS o, max(top) AS top FROM m GROUP BY 1) SELECT CAST(id AS VARCHAR) AS series_id, round(k / 79.0, 6) AS t_inflection, round(top, 6) AS inflection_sharpness, round(greatest(k, 1) / greatest(80 - k, 1), 6) AS asymmetry_ratio, round(1 / (s + 1e-6), 4) AS saturation_speed, round(1 / (o + 1e-6), 4) AS onset_speed FROM e")
def feat_group_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["t_inflection", "inflection_sharpness", "asymmetry_ratio", "saturation_speed", "onset_speed"]
    out = curves.features(_logistics(spark), "v", names)
    return out.select("series_id", *[F.round(n, 4 if n.endswith("_speed") else 6).alias(n) for n in names])


@query("feat_groupC", f"WITH {_CURVE}, p AS (SELECT id, i, x, lag(x, 10) OVER (PARTITION BY id ORDER BY i) AS y FROM c), q AS (SELECT *, lead(x) OVER (PARTITION BY id ORDER BY i) AS nx, lead(y) OVER (PARTITION BY id ORDER BY i) AS ny FROM p WHERE y IS NOT NULL) SELECT CAST(id AS VARCHAR) AS series_id, round(0.5 * abs(sum(x * ny - nx * y)), 6) AS loop_area, round(stddev_pop(x), 6) AS phase_spread_x, round(stddev_pop(y), 6) AS phase_spread_y, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) AS phase_corr FROM q GROUP BY 1")
def feat_group_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["loop_area", "phase_spread_x", "phase_spread_y", "phase_corr"]
    return curves.features(_logistics(spark), "v", names).select("series_id", *[F.round(n, 6).alias(n) for n in names])


@query("feat_groupEF", f"WITH {_CURVE}, m AS (SELECT *, max(dx) OVER (PARTITION BY id) AS top FROM d) SELECT CAST(id AS VARCHAR) AS series_id, round(1 - 2 * abs(min(CASE WHEN dx = top THEN t END) - 0.5), 6) AS t_inflection_symmetry, round(stddev_pop(abs(dx)) / (avg(abs(dx)) + 1e-10), 6) AS velocity_cv, round(avg(CASE WHEN x < 0.15 THEN 1.0 ELSE 0.0 END), 6) AS early_plateau_frac, round(avg(CASE WHEN i >= 72 THEN x END) - avg(CASE WHEN i < 8 THEN x END), 6) AS net_rise_score, round(avg(CASE WHEN dx > 0 THEN 1.0 ELSE 0.0 END), 6) AS monotone_dx_frac, round(avg(CASE WHEN x BETWEEN 0.3 AND 0.7 THEN 1.0 ELSE 0.0 END), 6) AS center_fraction, round(regr_slope(CASE WHEN i < 24 THEN ln(x + 0.01) END, t), 5) AS early_log_slope FROM m GROUP BY 1")
def feat_group_ef(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["t_inflection_symmetry", "velocity_cv", "early_plateau_frac", "net_rise_score", "monotone_dx_frac", "center_fraction", "early_log_slope"]
    return curves.features(_logistics(spark), "v", names).select("series_id", *[F.round(n, 5 if n == "early_log_slope" else 6).alias(n) for n in names])


def _kernel(n: int, sigma: int) -> list[tuple[int, float]]:
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return [(int(o), float(x)) for o, x in zip(range(-r, r + 1), w / w.sum(), strict=True)]


_SMOOTH = "w AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, {x!r})" for o, x in _kernel(30, 3)) + ") AS w(o, w))"


@query("gaussian_smooth", f"WITH {S4}, {_SMOOTH}, k AS (SELECT series_id, v, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM s4), m AS (SELECT a.series_id, a.i, a.n, (((a.i + o) % (2 * a.n)) + 2 * a.n) % (2 * a.n) AS j, w FROM k a, w) SELECT m.series_id, CAST(m.i AS INTEGER) AS t, round(sum(w * v), 4) AS v FROM m JOIN k ON k.series_id = m.series_id AND k.i = CASE WHEN j < m.n THEN j ELSE 2 * m.n - 1 - j END GROUP BY 1, 2")
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sigma of a tenth of the length, ends mirrored."""
    smooth = _arrays(S.event_days(spark, sf_dir)).select("series_id", curves.smoothed(F.col("v"), 10.0).alias("v"))
    return S.to_long(smooth).select("series_id", "t", F.round("v", 4).alias("v"))


@query("features_51")
def features_51(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the segments' and event types' curves on 100 places."""
    both = _arrays(S.segment_orders(spark, sf_dir)).unionByName(_arrays(S.event_days(spark, sf_dir)))
    return curves.features(both.select("series_id", curves.resampled(F.col("v")).alias("x")).where(F.col("x").isNotNull()))


@query("resample_100", f"WITH {S1}, {scaled('s1')}, {PCHIP} SELECT series_id, j, round(least(greatest(x, 0), 1), 6) AS x FROM h")
def resample_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves_of = _arrays(S.segment_orders(spark, sf_dir)).select("series_id", curves.resampled(F.col("v")).alias("x"))
    return curves_of.select("series_id", F.posexplode("x").alias("j", "x")).select("series_id", "j", F.round("x", 6).alias("x"))


#: Trailing windows of a third of the series over its residuals, up to where its smoothed curve rises fastest.
_TRENDS = f"""WITH {S4}, {scaled('s4')}, {residual('q', 2, 8)},
a AS (SELECT *, greatest(5, n // 3) AS w, x - r AS trend FROM q),
b AS (SELECT *, (coalesce(lead(trend) OVER o, trend) - coalesce(lag(trend) OVER o, trend)) / CASE WHEN i = 0 OR i = n - 1 THEN 1.0 ELSE 2.0 END AS rise, lead(r) OVER o AS nr FROM a WINDOW o AS (PARTITION BY series_id ORDER BY i)),
c AS (SELECT *, max(rise) OVER (PARTITION BY series_id) AS top FROM b), p AS (SELECT *, min(CASE WHEN rise = top THEN i END) OVER (PARTITION BY series_id) AS pk FROM c),
r AS (SELECT e.series_id, e.i AS j, var_pop(l.r) AS va, corr(CASE WHEN l.i < e.i THEN l.r END, CASE WHEN l.i < e.i THEN l.nr END) AS ac FROM p e JOIN p l ON l.series_id = e.series_id AND l.i > e.i - e.w AND l.i <= e.i WHERE e.i >= e.w - 1 AND e.i <= greatest(e.pk, e.w - 1) GROUP BY 1, 2),
{tau('tv', 'r', 'va')}, {tau('ta', 'r', 'ac')},
z AS (SELECT series_id, any_value(n) AS n, any_value(pk) / CAST(any_value(n) - 1 AS DOUBLE) AS t_takeoff, any_value(greatest(pk, w - 1) - w + 2) AS known FROM p GROUP BY 1)
SELECT series_id, CAST(n AS INTEGER) AS n, round(t_takeoff, 6) AS t_takeoff, CASE WHEN known >= 4 THEN round(tv.tau, 6) END AS tau_var, CASE WHEN known >= 4 THEN round(ta.tau, 6) END AS tau_ac FROM z LEFT JOIN tv USING (series_id) LEFT JOIN ta USING (series_id)"""


@query("ews_trends", _TRENDS)
def ews_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series with under four windows before its takeoff has no trend."""
    found = ews.signals(_arrays(S.event_days(spark, sf_dir)))
    return found.select("series_id", "n", *[F.round(F.when(~F.isnan(c), F.col(c)), 6).alias(c) for c in ("t_takeoff", "tau_var", "tau_ac")])


@query("ews_null_control")
def ews_null_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends of first differences against matched surrogates."""
    return ews.signals(_arrays(S.event_days(spark, sf_dir)).repartition(8, "series_id"), surrogates=50, metric="difference")


@query("ews_sensitivity")
def ews_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ews.sensitivity(_arrays(S.segment_orders(spark, sf_dir)))


@query("transition_detector")
def transition_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviance of each series and its length-matched p-value over a pool of surrogates."""
    series = _arrays(S.event_days(spark, sf_dir))
    return ews.p_values(ews.detections(series), ews.null_pool(series, 40))


@query("logistic_fit")
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s-score and no-transition criteria."""
    return curation.no_transition(curation.shape_scores(_arrays(S.segment_orders(spark, sf_dir))))


@query("curation_gates")
def curation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = spark.createDataFrame([(3, 4)], "ws int, we int")
    kept, rejected = curation.gate(S.user_days(spark, sf_dir), windows, least=5)
    return kept.groupBy("series_id").agg(F.first("series_type").alias("outcome"), F.max("n_obs").alias("n_obs")).unionByName(rejected.select("series_id", F.col("reason").alias("outcome"), F.lit(0).cast("long").alias("n_obs")))


@query("dedupe_greedy")
def dedupe_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among the embeddings of a label, first come first kept."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return curation.drop_near_copies(rows, ["label"], "vec_id", 0.98).select("vec_id", "label")


@query("simulated_benchmark")
def simulated_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid curves of the three classes, and how a nearest centroid on six features types them."""
    made = simulate.benchmark(spark, 40, "mixed", 200)
    names = ["t_inflection", "inflection_sharpness", "phase_corr", "residual_var_frac", "tc_exp_onset", "velocity_cv"]
    f = curves.features(made, "x", names)
    z = learn.standardise(f.select("series_id", "label", F.array(*names).alias("x")))
    return scoring.contingency(scoring.nearest_centroid(z, "x", "label", "series_id"), "label", "guess")


@query("observation_models")
def observation_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = simulate.observed(simulate.benchmark(spark, 10, "logistic", 200))
    return curves.features(seen, "x", ["t_inflection", "net_rise_score", "ac1_early"]).groupBy("condition", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("t_inflection").alias("t_inflection"), F.avg("ac1_early").alias("ac1_early"))


@query("scaling_exponent")
def scaling_exponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.scaling_exponent(spark, [0.1, 0.2, 0.4, 0.8])


def _embedded(spark: SparkSession, sf_dir: str, k: int = 6) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return learn.principal_components(learn.standardise(rows), k=k)[0].select("vec_id", "label", F.col("pc").alias("x"))


@query("pca_scores")
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedded(spark, sf_dir)


@query("kmeans_sweep")
def kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouette, Calinski-Harabasz and Davies-Bouldin for two to five clusters."""
    rows, out, clusters = _embedded(spark, sf_dir).persist(), None, {k: f"cluster_{k}" for k in range(2, 6)}
    typed = rows
    for k, name in clusters.items():
        typed = learn.k_means(typed, k, restarts=2).withColumnRenamed("cluster", name)
    for k, name in clusters.items():
        one = scoring.calinski_harabasz(typed, "x", name).crossJoin(scoring.davies_bouldin(typed, "x", name)).select(F.lit(k).alias("k"), "ch", "db")  # one row each
        out = one if out is None else out.unionByName(one)
    wide = scoring.silhouettes(typed, "x", list(clusters.values()), "vec_id")
    each = wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(name).alias("silhouette")) for k, name in clusters.items()])).alias("s")).select("s.*")
    return each.join(out, "k").select("k", "silhouette", "ch", "db")


@query("t_mixture")
def t_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embedded(spark, sf_dir, 4)
    state, _ = learn.mixture(rows, 3, student=True, restarts=2, rounds=20)
    return scoring.contingency(learn.assign(rows, state), "label", "cluster")


@query("prior_mixture")
def prior_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most probable components given prior means, one near each of three labels."""
    rows = _embedded(spark, sf_dir, 4)
    means = rows.where(F.col("label") < 3).groupBy("label").agg(*[F.avg(F.col("x")[j]).alias(f"m{j}") for j in range(4)]).orderBy("label").collect()
    prior = {"mu": [[r[f"m{j}"] for j in range(4)] for r in means], "beta": 10.0, "nu": 6.0, "psi": (0.1 * np.eye(4)).tolist(), "alpha": 1.0}
    state, _ = learn.mixture(rows, len(means), prior=prior, rounds=20)
    return scoring.contingency(learn.assign(rows, state), "label", "cluster")


@query("out_of_distribution")
def out_of_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embedded(spark, sf_dir, 6)
    return learn.out_of_distribution(rows, rows.where(F.col("label") < 5)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("outside").cast("double")).alias("outside"))


@query("typing_logistic")
def typing_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multinomial logistic regression on a stratified split: the held-out confusion."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from tidewatch.operators.sampling import split

    rows = split(_embedded(spark, sf_dir, 8), "label", "vec_id").withColumn("v", array_to_vector("x"))
    train = rows.where(F.col("part") == "train")
    model = LogisticRegression(featuresCol="v", labelCol="label", predictionCol="guess", regParam=1 / max(train.count(), 1), maxIter=50).fit(train)
    held = model.transform(rows.where(F.col("part") != "train")).withColumn("guess", F.col("guess").cast("int"))
    return scoring.contingency(held, "label", "guess")


@query("typing_mlp")
def typing_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small network on the same split."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    from tidewatch.operators.sampling import split

    rows = split(_embedded(spark, sf_dir, 8), "label", "vec_id").withColumn("v", array_to_vector("x"))
    labels = rows.agg(F.max("label")).first()[0] + 1
    model = MultilayerPerceptronClassifier(layers=[8, 32, labels], featuresCol="v", labelCol="label", predictionCol="guess", seed=0, maxIter=60).fit(rows.where(F.col("part") == "train"))
    held = model.transform(rows.where(F.col("part") == "test")).withColumn("guess", F.col("guess").cast("int"))
    return scoring.contingency(held, "label", "guess")


@query("finite_series_count", f"WITH {S1} SELECT CAST(count(DISTINCT series_id) AS BIGINT) AS n_series, CAST(count(*) AS BIGINT) AS n_rows FROM s1")
def finite_series_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segment_orders(spark, sf_dir).agg(F.countDistinct("series_id").alias("n_series"), F.count(F.lit(1)).alias("n_rows"))


@query("skew_t_mixture")
def skew_t_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embedded(spark, sf_dir, 3)
    state, _ = skewed.skew_mixture(rows, 2, rounds=10)
    return scoring.contingency(skewed.assign_skewed(rows, state), "label", "cluster")


@query("bimodality_scan")
def bimodality_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two modes on the first principal component, as rows of small second component are pruned."""
    rows = _embedded(spark, sf_dir, 2).select(F.col("x")[0].alias("v"), F.abs(F.col("x")[1]).alias("o"))
    return skewed.bimodality_scan(rows, "v", "o")


@query("random_convolutions")
def random_convolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simulate.benchmark(spark, 10, "logistic", 120)
    return made.select("series_id", "label", skewed.convolved(F.col("x"), 120, 30).alias("f"))


@query("density_ridges")
def density_ridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embedded(spark, sf_dir, 2).select("label", F.col("x")[0].alias("v"))
    return skewed.density(rows, "v", ["label"], [i / 4 for i in range(-24, 25)])
