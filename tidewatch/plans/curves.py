"""Queries of the sequence and growth operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import growth as G
from tidewatch.operators import windows as W
from tidewatch.plans.series_sql import S1, S2, S4, S5, indexed
from tidewatch.registry import query, table
from tidewatch.sources import series as S


def rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


_GEO = f"""g AS (SELECT series_id, min(t) FILTER (WHERE i = pk) AS t_peak, max(peak) AS peak, min(t) AS t_first, max(v) FILTER (WHERE i = 0) AS v_first FROM r GROUP BY 1),
l AS (SELECT series_id, t, v, i, pk, peak, lag(v) OVER (PARTITION BY series_id ORDER BY t) AS pv, lag(t) OVER (PARTITION BY series_id ORDER BY t) AS pt FROM r),
c AS (SELECT series_id, CASE WHEN v = pv THEN t ELSE pt + (0.1 * peak - pv) / (v - pv) * (t - pt) END AS t_cross FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY i) AS k FROM l WHERE i >= 1 AND i <= pk AND v >= 0.1 * peak) WHERE k = 1),
s AS (SELECT g.series_id, t_peak, CASE WHEN v_first >= 0.1 * peak THEN t_first ELSE coalesce(t_cross, t_peak) END AS t_start, CASE WHEN v_first >= 0.1 * peak THEN peak / greatest(v_first, 1e-12) ELSE 1 / 0.1 END AS ratio FROM g LEFT JOIN c USING (series_id))
SELECT series_id, t_peak, round(CAST(t_start AS DOUBLE), 6) AS t_start, round((pow(ratio, 1 / greatest(t_peak - t_start, 2.0)) - 1) * 100, 6) AS growth FROM s"""


@query("segment_geo_growth", f"WITH {S1}, {indexed('s1')}, {_GEO}")
def segment_geo_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.geometric_growth(S.segment_orders(spark, sf_dir)), ["t_start", "growth"])


@query("share_by_group", f"WITH {S2} SELECT n_name, t, round(v, 6) AS share FROM s2 JOIN nation ON series_id = CAST(n_nationkey AS VARCHAR)")
def share_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("series_id"), "n_name")
    return S.nation_share(spark, sf_dir).join(names, "series_id").select("n_name", "t", F.round("v", 6).alias("share"))


@query("share_by_join", "WITH a AS (SELECT c_nationkey AS k, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS t, sum(CAST(o_totalprice AS DECIMAL(18, 2))) FILTER (WHERE o_orderstatus = 'F') AS part, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS whole FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT k, t, round(100.0 * CAST(part AS DOUBLE) / CAST(whole AS DOUBLE), 6) AS share FROM a WHERE part IS NOT NULL")
def share_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part and whole are two aggregates joined on both keys."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).select(F.col("c_nationkey").alias("k"), S.month(F.col("o_orderdate")).alias("t"), "o_orderstatus", S.money(F.col("o_totalprice")).alias("x"))
    part = rows.where(F.col("o_orderstatus") == "F").groupBy("k", "t").agg(F.sum("x").alias("part"))
    whole = rows.groupBy("k", "t").agg(F.sum("x").alias("whole"))
    return part.join(whole, ["k", "t"]).select("k", "t", F.round(C.share(F.col("part").cast("double"), F.col("whole").cast("double")), 6).alias("share"))


@query("wide_to_long", f"WITH {S1} SELECT series_id, t, v FROM s1")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table with a column a month, and back again."""
    months = list(range(1990 * 12, 2005 * 12))
    wide = S.long_to_wide(S.segment_orders(spark, sf_dir), months)
    return S.wide_to_long(wide, ["series_id"], [str(m) for m in months]).where(F.col("v").isNotNull())


@query("minmax_norm", f"WITH {S1} SELECT series_id, t, round((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 6) AS x FROM s1 WINDOW w AS (PARTITION BY series_id)")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.minmax(S.segment_orders(spark, sf_dir)).select("series_id", "t", F.round("x", 6).alias("x"))


@query("minmax_eps_norm", f"WITH {S4} SELECT series_id, t, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-12), 6) AS x FROM s4 WINDOW w AS (PARTITION BY series_id)")
def minmax_eps_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.minmax(S.event_days(spark, sf_dir), 1e-12).select("series_id", "t", F.round("x", 6).alias("x"))


@query("max_norm", f"WITH {S2} SELECT series_id, t, round(v / max(v) OVER (PARTITION BY series_id), 6) AS x FROM s2")
def max_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.maxnorm(S.nation_share(spark, sf_dir)).select("series_id", "t", F.round("x", 6).alias("x"))


@query("zscore_pop", f"WITH {S4} SELECT series_id, t, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) AS x FROM s4 WINDOW w AS (PARTITION BY series_id)")
def zscore_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.zscore(S.event_days(spark, sf_dir)).select("series_id", "t", F.round("x", 6).alias("x"))


@query("winsorised", f"WITH {S2}, b AS (SELECT series_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM s2 GROUP BY 1) SELECT series_id, t, round(least(greatest(v, lo), hi), 6) AS x FROM s2 JOIN b USING (series_id)")
def winsorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.winsorise(S.nation_share(spark, sf_dir)).select("series_id", "t", F.round("x", 6).alias("x"))


@query("gap_fill", f"WITH {S5}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i FROM s5), g AS (SELECT series_id, t, v, i, max(CASE WHEN v IS NOT NULL THEN i END) OVER b AS a, min(CASE WHEN v IS NOT NULL THEN i END) OVER f AS z FROM k WINDOW b AS (PARTITION BY series_id ORDER BY t), f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), j AS (SELECT g.*, p.v AS va, q.v AS vb, (g.v IS NULL AND a IS NOT NULL AND z IS NOT NULL AND z - a - 1 <= 5) AS filled FROM g LEFT JOIN k p ON p.series_id = g.series_id AND p.i = g.a LEFT JOIN k q ON q.series_id = g.series_id AND q.i = g.z) SELECT series_id, t, round(CASE WHEN filled THEN va + (vb - va) * (i - a) / (z - a) ELSE v END, 6) AS v, filled FROM j")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.fill_gaps(S.user_days(spark, sf_dir)), ["v"])


@query("trim_ends", f"WITH {S5}, e AS (SELECT series_id, min(t) AS a, max(t) AS b FROM seen GROUP BY 1) SELECT series_id, t, v FROM s5 JOIN e USING (series_id) WHERE t BETWEEN a AND b")
def trim_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.trim_ends(S.user_days(spark, sf_dir))


@query("onset_trim", f"WITH {S1}, {indexed('s1')}, o AS (SELECT *, min(CASE WHEN v > 0.02 * peak THEN i END) OVER (PARTITION BY series_id) AS onset, min(CASE WHEN i = 0 THEN v END) OVER (PARTITION BY series_id) AS v0 FROM r) SELECT series_id, t, v FROM o WHERE n >= 3 AND peak > 0 AND v0 <= 0.1 * peak AND i >= onset - 2")
def onset_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.onset_trim(S.segment_orders(spark, sf_dir))


_CUT = "cut AS (SELECT series_id, min(CASE WHEN i > pk AND v < 0.9 * peak THEN i END) AS c, max(CASE WHEN i = n - 1 THEN v END) AS vl, max(peak) AS p FROM r GROUP BY 1)"


@query("truncate_decline", f"WITH {S4}, {indexed('s4')}, {_CUT} SELECT series_id, t, v FROM r JOIN cut USING (series_id) WHERE NOT (vl < 0.9 * p) OR i < c")
def truncate_decline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.truncate_decline(S.event_days(spark, sf_dir))


@query("saturation_runs", f"WITH {S1}, {indexed('s1')}, f AS (SELECT series_id, t, v, i - pk AS i, abs(v - peak) <= 0.05 * (abs(peak) + 1e-10) AS f FROM r WHERE i >= pk - 6), g AS (SELECT series_id, min(i) AS first_i, count(*) AS n, min(t) AS t_start, max(t) AS t_end FROM (SELECT *, i - row_number() OVER (PARTITION BY series_id, f ORDER BY t) AS k FROM f) WHERE f GROUP BY series_id, k) SELECT series_id, CAST(n AS BIGINT) AS n, t_start, t_end FROM g WHERE n >= 3")
def saturation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three rows or more within 5 % of the peak, from six rows before it on."""
    rows = W.indexed(S.segment_orders(spark, sf_dir)).withColumn("peak", F.max("v").over(W.series())).withColumn("at", W.first_peak()).where(F.col("i") >= F.col("at") - 6).select("series_id", "t", "v", "peak")
    return W.runs(rows, F.abs(F.col("v") - F.col("peak")) <= 0.05 * (F.abs("peak") + 1e-10)).where(F.col("n") >= 3).select("series_id", "n", "t_start", "t_end")


@query("saturation_first_run", f"WITH {S2}, {indexed('s2')}, f AS (SELECT series_id, t, i, abs(v - peak) <= 0.05 * (abs(peak) + 1e-10) AS f FROM r WHERE i >= pk), g AS (SELECT series_id, count(*) AS n, min(t) AS t_start, max(t) AS t_end FROM (SELECT *, i - row_number() OVER (PARTITION BY series_id, f ORDER BY t) AS k FROM f) WHERE f GROUP BY series_id, k) SELECT series_id, CAST(n AS BIGINT) AS n, t_start, t_end FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t_start) AS o FROM g WHERE n >= 2) WHERE o = 1")
def saturation_first_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.saturation_runs(S.nation_share(spark, sf_dir), least=2).select("series_id", "n", "t_start", "t_end")


@query("decline_runs", f"WITH {S4}, {indexed('s4')}, b AS (SELECT series_id, t AS t_start, (peak - v) / (abs(peak) + 1e-10) > 0.15 AS b, i FROM r WHERE i >= pk), s AS (SELECT series_id, t_start, max(t_start) OVER w AS t_end, bool_and(b) OVER w AS a, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)), o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t_start) AS k FROM s WHERE a AND n = 3 AND NOT EXISTS (SELECT 1 FROM (VALUES (3, 4), (12, 13)) AS w(ws, we) WHERE t_start <= we AND t_end >= ws)) SELECT series_id, t_start, t_end FROM o WHERE k = 1")
def decline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = spark.createDataFrame([(3, 4), (12, 13)], "ws int, we int")
    return W.structural_declines(S.event_days(spark, sf_dir), windows, least=3)


@query("peak_growth", f"WITH {S1}, a AS (SELECT series_id, t, v, min(v) OVER s AS lo, max(v) OVER s AS hi, min(t) OVER b AS t0, first_value(v) OVER b AS v0 FROM s1 WINDOW s AS (PARTITION BY series_id), b AS (PARTITION BY series_id ORDER BY t RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT series_id, round(max(CASE WHEN t - t0 >= 2 AND v0 >= lo + 0.1 * (hi - lo) AND v0 > 0 AND hi > lo THEN (pow(v / v0, 1.0 / (t - t0)) - 1) * 100 END), 6) AS peak_growth FROM a GROUP BY 1")
def peak_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.peak_growth(S.segment_orders(spark, sf_dir)), ["peak_growth"])


def _cross(part: float, name: str) -> str:
    return f"{name} AS (SELECT series_id, CASE WHEN v = pv THEN t ELSE pt + (lv - pv) / (v - pv) * (t - pt) END AS tc FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS k FROM (SELECT series_id, t, v, i, lag(v) OVER (PARTITION BY series_id ORDER BY t) AS pv, lag(t) OVER (PARTITION BY series_id ORDER BY t) AS pt, lo + {part} * (peak - lo) AS lv FROM r JOIN m USING (series_id)) WHERE i >= 1 AND v >= lv) WHERE k = 1)"


@query("diffusion_time", f"WITH {S1}, {indexed('s1')}, m AS (SELECT series_id, min(v) AS lo, max(t) AS te FROM s1 GROUP BY 1), {_cross(0.1, 'a')}, {_cross(0.9, 'b')} SELECT m.series_id, round(greatest(coalesce(b.tc, te) - coalesce(a.tc, te), 2.0), 6) AS dt FROM m LEFT JOIN a ON a.series_id = m.series_id LEFT JOIN b ON b.series_id = m.series_id")
def diffusion_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.diffusion_time(S.segment_orders(spark, sf_dir)), ["dt"])


@query("first_crossing_interp", f"WITH {S1}, {indexed('s1')}, m AS (SELECT series_id, min(v) AS lo FROM s1 GROUP BY 1), {_cross(0.5, 'a')} SELECT series_id, round(CAST(tc AS DOUBLE), 6) AS t_cross FROM a")
def first_crossing_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.min("v").over(W.series()), F.max("v").over(W.series())
    return rounded(W.crossing(S.segment_orders(spark, sf_dir), low + 0.5 * (high - low)), ["t_cross"])


@query("compound_rate", f"WITH {S1} SELECT series_id, round(100 * (pow(max(v) FILTER (WHERE t = b) / max(v) FILTER (WHERE t = a), 1.0 / (max(b) - max(a))) - 1), 6) AS cagr FROM (SELECT *, min(t) OVER (PARTITION BY series_id) AS a, max(t) OVER (PARTITION BY series_id) AS b FROM s1) GROUP BY 1")
def compound_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.compound_rate(S.segment_orders(spark, sf_dir)), ["cagr"])


@query("cumulative_pipeline", "WITH y AS (SELECT p_type AS series_id, CAST(year(l_shipdate) AS INTEGER) AS t, sum(CAST(l_quantity AS DECIMAL(18, 2))) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus IN ('F') AND year(l_shipdate) <= 2005 GROUP BY 1, 2), c AS (SELECT series_id, CAST(unnest(range(min(t), 2006)) AS INTEGER) AS t FROM y GROUP BY 1) SELECT c.series_id, c.t, CAST(sum(coalesce(v, 0)) OVER (PARTITION BY c.series_id ORDER BY c.t) AS DOUBLE) AS v FROM c LEFT JOIN y ON y.series_id = c.series_id AND y.t = c.t")
def cumulative_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running quantity by part type of one line status, on a dense yearly axis up to a horizon."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_linestatus")
    rows = lines.join(part, lines.l_partkey == part.p_partkey).select(F.col("p_type").alias("series_id"), F.year("l_shipdate").alias("t"), S.money(F.col("l_quantity")).alias("v"), F.col("l_linestatus").alias("status"))
    return G.cumulative_by_status(rows, ["F"], 2005)


@query("niche_gate", "WITH p AS (SELECT p_brand || '/' || p_type AS series_id, p_brand AS g, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS peak FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), l AS (SELECT g, max(peak) AS lead FROM p GROUP BY 1) SELECT series_id, g, peak FROM p JOIN l USING (g) WHERE NOT (lead > 0 AND peak < 0.6 * lead)")
def niche_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and type pairs without those far under their brand's leader."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    peaks = lines.join(part, lines.l_partkey == part.p_partkey).groupBy(F.concat_ws("/", "p_brand", "p_type").alias("series_id"), F.col("p_brand").alias("g")).agg(F.sum(S.money(F.col("l_quantity"))).cast("double").alias("peak"))
    return G.niche_gate(peaks, peaks, "g", 0.6)


@query("shape_gate", f"WITH {S1}, {indexed('s1')}, e AS (SELECT series_id, max(v) FILTER (WHERE i = 0) / max(peak) AS a, max(v) FILTER (WHERE i = n - 1) / max(peak) AS b, max(pk / n) AS p FROM r GROUP BY 1) SELECT series_id, CASE WHEN a > 0.35 THEN 'Truncated-start' WHEN b < 0.70 AND p < 0.80 THEN 'Bell/Declining' ELSE 'kept' END AS shape FROM e")
def shape_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shape_class(S.segment_orders(spark, sf_dir))


@query("first_difference", f"WITH {S4} SELECT series_id, t, round(v - lag(v, 1, v) OVER (PARTITION BY series_id ORDER BY t), 6) AS d FROM s4")
def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.difference(S.event_days(spark, sf_dir)).select("series_id", "t", F.round("d", 6).alias("d"))


@query("series_gradient", f"WITH {S4} SELECT series_id, t, round(CASE WHEN nx IS NULL THEN v - pv WHEN pv IS NULL THEN nx - v ELSE (nx - pv) / 2 END, 6) AS dx FROM (SELECT *, lead(v) OVER w AS nx, lag(v) OVER w AS pv FROM s4 WINDOW w AS (PARTITION BY series_id ORDER BY t))")
def series_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.gradient(S.event_days(spark, sf_dir)).select("series_id", "t", F.round("dx", 6).alias("dx"))


@query("sign_changes", f"WITH {S4}, g AS (SELECT series_id, t, sign(CASE WHEN nx IS NULL THEN v - pv WHEN pv IS NULL THEN nx - v ELSE (nx - pv) / 2 END) AS s FROM (SELECT *, lead(v) OVER w AS nx, lag(v) OVER w AS pv FROM s4 WINDOW w AS (PARTITION BY series_id ORDER BY t))), h AS (SELECT series_id, s, lag(s) OVER (PARTITION BY series_id ORDER BY t) AS p FROM g) SELECT series_id, CAST(count(*) FILTER (WHERE p IS NOT NULL AND s <> p) AS BIGINT) AS n_changes, round(count(*) FILTER (WHERE p IS NOT NULL AND s <> p) / greatest(count(*) - 1, 1), 6) AS rate FROM h GROUP BY 1")
def sign_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.sign_changes(S.event_days(spark, sf_dir)), ["rate"])


@query("running_maximum", f"WITH {S2} SELECT series_id, t, round(max(v) OVER (PARTITION BY series_id ORDER BY t), 6) AS m FROM s2")
def running_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.running_max(S.nation_share(spark, sf_dir)).select("series_id", "t", F.round("m", 6).alias("m"))


@query("as_of_lookup", f"WITH {S2} SELECT series_id, t, min(t) OVER b AS t0, round(first_value(v) OVER b, 6) AS v0 FROM s2 WINDOW b AS (PARTITION BY series_id ORDER BY t RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)")
def as_of_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.as_of(S.nation_share(spark, sf_dir), 3).select("series_id", "t", "t0", F.round("v0", 6).alias("v0"))


_ROLL = f"""{S4}, k AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n, lag(v) OVER w AS lv, v - lag(v) OVER w AS d FROM s4 WINDOW w AS (PARTITION BY series_id ORDER BY t)),
q AS (SELECT series_id, t, i, n, v, lv, d, var_pop(v) OVER f AS var, stddev_pop(v) OVER f AS sd, covar_pop(lv, v) OVER g AS cv, sqrt(var_pop(lv) OVER g * var_pop(CASE WHEN lv IS NOT NULL THEN v END) OVER g) AS sp, stddev_pop(d) OVER f AS dsd FROM k WINDOW f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), g AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
roll AS (SELECT series_id, t, i / (n - 1) AS pos, var, sd, coalesce(cv / nullif(sp, 0), 0) AS ac1 FROM q WHERE i >= 9 AND sd >= 1e-10)"""


@query("rolling_var_ac1", f"WITH {_ROLL} SELECT series_id, t, round(pos, 6) AS pos, round(var, 4) AS var, round(sd, 5) AS sd, round(ac1, 6) AS ac1 FROM roll")
def rolling_var_ac1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rolling(S.event_days(spark, sf_dir), 10).select("series_id", "t", F.round("pos", 6).alias("pos"), F.round("var", 4).alias("var"), F.round("sd", 5).alias("sd"), F.round("ac1", 6).alias("ac1"))


@query("rolling_diff_sd", f"WITH {_ROLL} SELECT series_id, t, round(dsd, 5) AS sd FROM q WHERE i >= 10")
def rolling_diff_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling sd of first differences."""
    steps = W.difference(S.event_days(spark, sf_dir)).withColumn("_i", F.row_number().over(W.ordered())).where(F.col("_i") > 1).select("series_id", "t", F.col("d").alias("v"))
    return W.rolling(steps, 10).select("series_id", "t", F.round("sd", 5).alias("sd"))


def _tau(source: str, value: str) -> str:
    return f"SELECT a.series_id, round(sum(sign(b.{value} - a.{value})) / sqrt(CAST(count(*) AS DOUBLE) * count(*) FILTER (WHERE a.{value} <> b.{value})), 6) AS tau FROM {source} a JOIN {source} b ON a.series_id = b.series_id AND a.t < b.t GROUP BY 1"


@query("kendall_rolling_var", f"WITH {_ROLL} {_tau('roll', 'var')}")
def kendall_rolling_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend of the rolling variance."""
    return rounded(W.kendall(W.rolling(S.event_days(spark, sf_dir), 10), "var"), ["tau"])


@query("kendall_rolling_ac1", f"WITH {_ROLL} {_tau('roll', 'ac1')}")
def kendall_rolling_ac1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.kendall(W.rolling(S.event_days(spark, sf_dir), 10), "ac1"), ["tau"])


_GRID = f"{S2}, k AS (SELECT series_id, v, (row_number() OVER w - 1) / (count(*) OVER (PARTITION BY series_id) - 1) AS pos FROM s2 WINDOW w AS (PARTITION BY series_id ORDER BY t)), p AS (SELECT series_id, pos AS a, v AS va, lead(pos) OVER w AS b, lead(v) OVER w AS vb FROM k WINDOW w AS (PARTITION BY series_id ORDER BY pos)), grid AS (SELECT i / 16.0 AS g FROM range(0, 17) AS x(i)), y AS (SELECT series_id, CAST(g AS DOUBLE) AS g, CASE WHEN b IS NULL THEN va ELSE va + (vb - va) * (g - a) / (b - a) END AS y FROM p JOIN grid ON g >= a AND (g < b OR (b IS NULL AND g = a)))"


def _on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(i / 16.0,) for i in range(17)], "g double")
    rows = W.indexed(S.nation_share(spark, sf_dir)).withColumn("pos", F.try_divide(F.col("i"), F.col("n") - 1))
    return W.regrid(rows, grid, "pos", "v")


@query("grid_interp", f"WITH {_GRID} SELECT series_id, g, round(y, 6) AS y FROM y")
def grid_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_on_grid(spark, sf_dir), ["y"])


@query("aligned_band", f"WITH {_GRID} SELECT g, CAST(count(y) AS BIGINT) AS n, round(median(y), 6) AS median, round(quantile_cont(y, 0.1), 6) AS p10, round(quantile_cont(y, 0.9), 6) AS p90 FROM y GROUP BY 1 HAVING count(y) >= 3")
def aligned_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.band(_on_grid(spark, sf_dir), ["g"]), ["median", "p10", "p90"])


_PROFILE = f"WITH {S1} SELECT series_id, CAST(count(*) AS BIGINT) AS n_obs, min(t) AS t_start, max(t) AS t_end, round(max(v), 2) AS peak, round(median(v), 4) AS median FROM s1 GROUP BY 1"


@query("series_profile", _PROFILE)
def series_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segment_orders(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_obs"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.round(F.max("v"), 2).alias("peak"), F.round(F.median("v"), 4).alias("median"))
