"""Feature queries over the segments' cumulative orders, with SQL twins worked out from the features' formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import curves
from tidewatch.plans.series_sql import S1, residual, tau
from tidewatch.registry import query
from tidewatch.sources import series as S

#: Each series scaled to 0 .. 1, with its places, first and second derivatives; u is scaled once more, as the theory features do.
_BASE = f"""WITH {S1},
i0 AS (SELECT series_id, CAST(row_number() OVER w - 1 AS INTEGER) AS i, CAST(count(*) OVER (PARTITION BY series_id) AS INTEGER) AS n, (v - min(v) OVER (PARTITION BY series_id)) / (max(v) OVER (PARTITION BY series_id) - min(v) OVER (PARTITION BY series_id) + 1e-12) AS x FROM s1 WINDOW w AS (PARTITION BY series_id ORDER BY t)),
i1 AS (SELECT *, CAST(i AS DOUBLE) / (n - 1) AS t, (x - min(x) OVER (PARTITION BY series_id)) / (max(x) OVER (PARTITION BY series_id) - min(x) OVER (PARTITION BY series_id) + 1e-12) AS u FROM i0),
i2 AS (SELECT *, (coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)) * (n - 1) / CASE WHEN i = 0 OR i = n - 1 THEN 1.0 ELSE 2.0 END AS dx, (coalesce(lead(u) OVER w, u) - coalesce(lag(u) OVER w, u)) * (n - 1) / CASE WHEN i = 0 OR i = n - 1 THEN 1.0 ELSE 2.0 END AS v FROM i1 WINDOW w AS (PARTITION BY series_id ORDER BY i)),
k AS (SELECT *, (coalesce(lead(dx) OVER w, dx) - coalesce(lag(dx) OVER w, dx)) * (n - 1) / CASE WHEN i = 0 OR i = n - 1 THEN 1.0 ELSE 2.0 END AS d2, max(dx) OVER (PARTITION BY series_id) AS top, max(v) OVER (PARTITION BY series_id) AS top_v FROM i2 WINDOW w AS (PARTITION BY series_id ORDER BY i)),
p AS (SELECT *, min(CASE WHEN dx = top THEN i END) OVER (PARTITION BY series_id) AS pk, min(CASE WHEN v = top_v THEN i END) OVER (PARTITION BY series_id) AS pv, min(CASE WHEN u > 0.02 THEN t END) OVER (PARTITION BY series_id) AS t0,
  avg(x) OVER (PARTITION BY series_id) AS m, stddev_pop(x) OVER (PARTITION BY series_id) AS sd, avg(dx) OVER (PARTITION BY series_id) AS mv, stddev_pop(dx) OVER (PARTITION BY series_id) AS sv, median(x) OVER (PARTITION BY series_id) AS mid, max(x) OVER (PARTITION BY series_id) AS hi FROM k)"""


def _rounded(names: list[str], digits: int) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), {digits}) AS {n}" for n in names)


def _features(spark: SparkSession, sf_dir: str, names: list[str], digits: int) -> DataFrame:
    low, high = F.array_min("v"), F.array_max("v")
    scaled = S.to_arrays(S.segment_orders(spark, sf_dir)).select("series_id", F.transform("v", lambda y: (y - low) / (high - low + 1e-12)).alias("x"))
    return curves.features(scaled, "x", names).select("series_id", *[F.round(n, digits).alias(n) for n in names])


MOMENTS = ["pre_inflec_concavity", "post_inflec_concavity", "phase_skew_x", "phase_kurtosis_x", "outlier_timing", "histogram_mode", "zero_crossing_rate", "peak_to_rms", "bimodality_coeff", "velocity_kurtosis", "nonlinearity"]
_MOMENTS_SQL = f"""{_BASE},
a AS (SELECT series_id, avg(CASE WHEN i < greatest(1, pk) THEN d2 END) AS pre_inflec_concavity, avg(CASE WHEN i >= pk THEN d2 END) AS post_inflec_concavity, coalesce(avg(CASE WHEN x > mid THEN t END), 0.5) AS outlier_timing, max(x) / (sqrt(avg(x * x)) + 1e-10) AS peak_to_rms,
  (power(avg(power((x - m) / (sd + 1e-10), 3)), 2) + 1) / (avg(power((x - m) / (sd + 1e-10), 4)) + 1e-6) AS bimodality_coeff, avg(power((dx - mv) / (sv + 1e-10), 4)) - 3 AS velocity_kurtosis, any_value(hi) AS hi, any_value(n) AS n FROM p GROUP BY 1),
f AS (SELECT series_id, avg(power((x - lm) / (ls + 1e-10), 3)) AS phase_skew_x, avg(power((x - lm) / (ls + 1e-10), 4)) - 3 AS phase_kurtosis_x FROM (SELECT *, avg(x) OVER (PARTITION BY series_id) AS lm, stddev_pop(x) OVER (PARTITION BY series_id) AS ls FROM p WHERE i >= 10) GROUP BY 1),
h AS (SELECT series_id, min(bin) AS bin FROM (SELECT *, max(c) OVER (PARTITION BY series_id) AS most FROM (SELECT series_id, least(floor(x / hi * 10), 9) AS bin, count(*) AS c FROM p GROUP BY 1, 2)) WHERE c = most GROUP BY 1),
z AS (SELECT series_id, sum(CASE WHEN sign(dx) <> before THEN 1 ELSE 0 END) AS crossings FROM (SELECT series_id, dx, lag(sign(dx)) OVER (PARTITION BY series_id ORDER BY i) AS before FROM p) GROUP BY 1),
g1 AS (SELECT *, t - avg(t) OVER (PARTITION BY series_id) AS p1 FROM p), g2 AS (SELECT *, p1 * p1 - avg(p1 * p1) OVER (PARTITION BY series_id) AS p2, p1 * p1 * p1 - p1 * (sum(p1 * p1 * p1 * p1) OVER (PARTITION BY series_id) / sum(p1 * p1) OVER (PARTITION BY series_id)) AS p3 FROM g1),
g3 AS (SELECT series_id, sum(x * p1) / sum(p1 * p1) AS c1, sum(x * p2) / sum(p2 * p2) AS c2, sum(x * p3) / sum(p3 * p3) AS c3 FROM g2 GROUP BY 1),
g4 AS (SELECT series_id, sum(power(x - m - c1 * p1, 2)) / (sum(power(x - m - c1 * p1 - c2 * p2 - c3 * p3, 2)) + 1e-12) AS nonlinearity FROM g2 JOIN g3 USING (series_id) GROUP BY 1),
o AS (SELECT *, (bin + 0.5) / 10 * hi AS histogram_mode, crossings / greatest(n - 1, 1) AS zero_crossing_rate FROM a JOIN f USING (series_id) JOIN h USING (series_id) JOIN z USING (series_id) JOIN g4 USING (series_id))
SELECT series_id, {_rounded(MOMENTS, 5)} FROM o"""


@query("feat_moments", _MOMENTS_SQL)
def feat_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, MOMENTS, 5)


THEORY = ["tc_exp_onset", "tc_percap_linearity", "tc_velocity_symmetry", "tc_exp_relax", "onset_beta", "approach_expfit", "percap_linearity", "inflection_penetration", "velocity_asymmetry", "takeoff_abruptness", "csd_var_rate", "fold_dwell"]


def _r2(where: str, y: str, x: str, least: int) -> str:
    return f"CASE WHEN count(*) FILTER (WHERE {where}) >= {least} THEN regr_r2(CASE WHEN {where} THEN {y} END, CASE WHEN {where} THEN {x} END) ELSE 0 END"


_PER = "CASE WHEN u > 1e-9 THEN v / u ELSE 0 END"
_TAIL = "ln(greatest(1 - u, 1e-12))"
_ONSET = "u > 0.02 AND u < 0.25 AND t > t0"
_THEORY_SQL = f"""{_BASE},
y AS (SELECT *, avg(v) FILTER (WHERE u > 0.02 AND u < 0.98) OVER (PARTITION BY series_id) AS vm, stddev_pop(v) FILTER (WHERE u > 0.02 AND u < 0.98) OVER (PARTITION BY series_id) AS vs, count(*) FILTER (WHERE u < 0.6) OVER (PARTITION BY series_id) AS pre, greatest(5, n // 8) AS w FROM p),
b AS (SELECT series_id, {_r2("u > 0.02 AND u < 0.40 AND t < 0.6", "ln(u + 1e-9)", "t", 4)} AS tc_exp_onset, {_r2("u > 0.05 AND u < 0.90 AND v > 1e-9", _PER, "u", 5)} AS tc_percap_linearity,
  1 - abs(sum(CASE WHEN i <= pv THEN v ELSE 0 END) - sum(CASE WHEN i >= pv THEN v ELSE 0 END)) / (sum(CASE WHEN i <= pv THEN v ELSE 0 END) + sum(CASE WHEN i >= pv THEN v ELSE 0 END) + 1e-9) AS tc_velocity_symmetry, {_r2("u > 0.60 AND u < 0.985", _TAIL, "t", 4)} AS tc_exp_relax,
  CASE WHEN count(*) FILTER (WHERE {_ONSET}) >= 4 THEN regr_slope(CASE WHEN {_ONSET} THEN ln(u + 1e-9) END, CASE WHEN {_ONSET} THEN ln(t - t0 + 1e-6) END) ELSE 1 END AS onset_beta, {_r2("u > 0.7 AND u < 0.985", _TAIL, "t", 4)} AS approach_expfit, {_r2("u > 0.05 AND u < 0.90 AND v > 1e-9", _PER, "u", 5)} AS percap_linearity,
  max(CASE WHEN i = pv THEN u END) AS inflection_penetration, CASE WHEN count(*) FILTER (WHERE u > 0.02 AND u < 0.98) >= 4 THEN avg(CASE WHEN u > 0.02 AND u < 0.98 THEN power(v - vm, 3) END) / power(greatest(any_value(vs), 1e-12), 3) ELSE 0 END AS velocity_asymmetry,
  coalesce(max(v) / avg(CASE WHEN v > 1e-9 THEN v END), 1) AS takeoff_abruptness, avg(CASE WHEN u < 0.10 THEN 1.0 ELSE 0.0 END) AS fold_dwell FROM y GROUP BY 1),
g AS (SELECT a.series_id, a.i AS j, var_pop(c.x) AS y FROM y a JOIN y c ON a.series_id = c.series_id AND c.i >= a.i AND c.i < a.i + a.w WHERE a.pre > 2 * a.w AND a.i < a.pre - a.w GROUP BY 1, 2), {tau("tau", "g", "y")},
o AS (SELECT b.*, coalesce(tau, 0) AS csd_var_rate FROM b LEFT JOIN tau USING (series_id))
SELECT series_id, {_rounded(THEORY, 4)} FROM o"""


@query("feat_theory", _THEORY_SQL)
def feat_theory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, THEORY, 4)


TEXTURE = ["ac1_early", "ac1_late", "ac1_trend", "var_early", "var_late", "var_trend", "skewness_early", "skewness_late", "residual_var_frac", "ac_decay_rate", "entropy_approx"]


def _phi(name: str, k: int) -> str:
    close = " AND ".join(f"abs(a.x{d} - b.x{d}) <= a.tol" for d in range(k))
    return f"{name} AS (SELECT series_id, sum(ln(CAST(near AS DOUBLE) / (n - {k - 1}))) / any_value(n - {k - 1}) AS phi FROM (SELECT a.series_id, a.i, any_value(a.n) AS n, count(*) AS near FROM e a JOIN e b ON a.series_id = b.series_id AND {close} WHERE a.i < a.n - {k} AND b.i <= b.n - {k} GROUP BY 1, 2) GROUP BY 1)"


_TEXTURE_SQL = f"""{_BASE}, {residual("r", 2, 20)}, {residual("q", 3, 8)},
l AS (SELECT *, CAST(floor(greatest(5, 0.4 * n)) AS INTEGER) AS n40, CAST(greatest(5, floor(0.3 * n)) AS INTEGER) AS w FROM r),
h AS (SELECT *, i < n40 AS early, avg(r) OVER e AS rm, stddev_pop(r) OVER e AS rs FROM l WINDOW e AS (PARTITION BY series_id, i < n40)),
hn AS (SELECT *, lead(r) OVER (PARTITION BY series_id, early ORDER BY i) AS nr FROM h),
hh AS (SELECT series_id, early, sum((r - rm) * (nr - rm)) / sum((r - rm) * (r - rm)) AS ac, var_pop(r) AS va, avg(power((r - rm) / (rs + 1e-10), 3)) AS sk FROM hn GROUP BY 1, 2),
st AS (SELECT DISTINCT series_id, w, j, CAST(floor(j * ((n - w) / CAST(9 AS DOUBLE))) AS INTEGER) AS s FROM l, range(0, 10) AS g(j)),
wi AS (SELECT st.series_id, st.j, l.i, l.r, avg(l.r) OVER (PARTITION BY st.series_id, st.j) AS rm, lead(l.r) OVER (PARTITION BY st.series_id, st.j ORDER BY l.i) AS nr FROM st JOIN l ON l.series_id = st.series_id AND l.i >= st.s AND l.i < st.s + st.w),
ww AS (SELECT series_id, j, sum((r - rm) * (nr - rm)) / sum((r - rm) * (r - rm)) AS ac, var_pop(r) AS va FROM wi GROUP BY 1, 2), {tau("ta", "ww", "ac")}, {tau("tv", "ww", "va")},
rf AS (SELECT series_id, var_pop(r) / (var_pop(x) + 1e-10) AS residual_var_frac FROM q GROUP BY 1),
c AS (SELECT series_id, i, n, x - m AS c FROM p), lg AS (SELECT a.series_id, g.k, sum(a.c * b.c) AS top FROM c a, range(1, 21) AS g(k), c b WHERE b.series_id = a.series_id AND b.i = a.i + g.k AND g.k <= a.n // 4 GROUP BY 1, 2),
de AS (SELECT lg.series_id, -regr_slope(ln(greatest(top / whole, 1e-6) + 1e-6), k) AS ac_decay_rate FROM lg JOIN (SELECT series_id, sum(c * c) AS whole FROM c GROUP BY 1) USING (series_id) GROUP BY 1),
e AS (SELECT series_id, i, n, 0.2 * sd AS tol, x AS x0, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2 FROM p WINDOW w AS (PARTITION BY series_id ORDER BY i)), {_phi("f2", 2)}, {_phi("f3", 3)},
o AS (SELECT x.series_id, x.ac AS ac1_early, z.ac AS ac1_late, ta.tau AS ac1_trend, x.va AS var_early, z.va AS var_late, tv.tau AS var_trend, x.sk AS skewness_early, z.sk AS skewness_late, residual_var_frac, ac_decay_rate, abs(f2.phi - f3.phi) AS entropy_approx
  FROM hh x JOIN hh z ON x.series_id = z.series_id AND x.early AND NOT z.early JOIN ta ON ta.series_id = x.series_id JOIN tv ON tv.series_id = x.series_id JOIN rf ON rf.series_id = x.series_id JOIN de ON de.series_id = x.series_id JOIN f2 ON f2.series_id = x.series_id JOIN f3 ON f3.series_id = x.series_id)
SELECT series_id, {_rounded(TEXTURE, 6)} FROM o"""


@query("feat_texture", _TEXTURE_SQL)
def feat_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, TEXTURE, 6)
