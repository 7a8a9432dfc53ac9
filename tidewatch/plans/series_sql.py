"""SQL of the series builders, for the queries' SQL twins."""

S1 = "s1 AS (SELECT series_id, t, CAST(sum(x) OVER (PARTITION BY series_id ORDER BY t) AS DOUBLE) AS v FROM (SELECT c_mktsegment AS series_id, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS t, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))"
S2 = "s2 AS (SELECT series_id, t, 100.0 * CAST(part AS DOUBLE) / whole AS v FROM (SELECT CAST(c_nationkey AS VARCHAR) AS series_id, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS t, count(*) FILTER (WHERE o_orderstatus = 'F') AS part, count(*) AS whole FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) WHERE part > 0)"
S4 = "s4 AS (SELECT event_type AS series_id, CAST(dayofyear(ts) AS INTEGER) AS t, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS v FROM events GROUP BY 1, 2)"
S5 = "seen AS (SELECT CAST(user_id AS VARCHAR) AS series_id, CAST(dayofyear(ts) AS INTEGER) AS t, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2), s5 AS (SELECT c.series_id, CAST(c.t AS INTEGER) AS t, v FROM (SELECT series_id, unnest(range(1, 31)) AS t FROM (SELECT DISTINCT series_id FROM seen)) c LEFT JOIN seen ON seen.series_id = c.series_id AND seen.t = c.t)"


def indexed(source: str, name: str = "r") -> str:
    """A table with i, n, the peak and the place of its first occurrence."""
    return f"{name}0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS INTEGER) AS i, CAST(count(*) OVER (PARTITION BY series_id) AS INTEGER) AS n, max(v) OVER (PARTITION BY series_id) AS peak FROM {source}), {name} AS (SELECT *, min(CASE WHEN v = peak THEN i END) OVER (PARTITION BY series_id) AS pk FROM {name}0)"


def tau(name: str, source: str, value: str) -> str:
    """Kendall's tau-b of a value against its place `j`."""
    return f"{name} AS (SELECT a.series_id, CASE WHEN sum(CASE WHEN a.y <> b.y THEN 1 ELSE 0 END) = 0 THEN 0 ELSE sum(sign(b.y - a.y)) / sqrt(CAST(count(*) AS DOUBLE) * sum(CASE WHEN a.y <> b.y THEN 1 ELSE 0 END)) END AS tau FROM (SELECT series_id, j, {value} AS y FROM {source}) a JOIN (SELECT series_id, j, {value} AS y FROM {source}) b ON a.series_id = b.series_id AND a.j < b.j GROUP BY 1)"


def residual(name: str, least: int, part: int) -> str:
    """x less its Gaussian smoothing of width greatest(least, n / part), ends mirrored."""
    return f"""{name}n AS (SELECT DISTINCT n, greatest({least}, n // {part}) AS s FROM k), {name}o AS (SELECT n, s, unnest(range(-4 * s, 4 * s + 1)) AS o FROM {name}n),
{name}w AS (SELECT n, o, exp(-0.5 * (o / CAST(s AS DOUBLE)) * (o / CAST(s AS DOUBLE))) / sum(exp(-0.5 * (o / CAST(s AS DOUBLE)) * (o / CAST(s AS DOUBLE)))) OVER (PARTITION BY n) AS w FROM {name}o),
{name}m AS (SELECT a.series_id, a.i, a.n, w, (((a.i + o) % (2 * a.n)) + 2 * a.n) % (2 * a.n) AS j FROM k a JOIN {name}w ON a.n = {name}w.n),
{name}s AS (SELECT q.series_id, q.i, sum(w * b.x) AS smooth FROM {name}m q JOIN k b ON b.series_id = q.series_id AND b.i = CASE WHEN j < q.n THEN j ELSE 2 * q.n - 1 - j END GROUP BY 1, 2),
{name} AS (SELECT k.series_id, k.i, k.n, k.x, k.x - smooth AS r FROM k JOIN {name}s USING (series_id, i))"""


def scaled(source: str) -> str:
    """k: the source's series from 0 to 1, with place i of n."""
    return f"k AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS INTEGER) AS i, CAST(count(*) OVER (PARTITION BY series_id) AS INTEGER) AS n, (v - min(v) OVER (PARTITION BY series_id)) / (max(v) OVER (PARTITION BY series_id) - min(v) OVER (PARTITION BY series_id) + 1e-12) AS x FROM {source})"


#: Monotone cubic interpolation of k on 100 places: harmonic means of adjoining slopes, three-point slopes at the ends.
PCHIP = """d AS (SELECT series_id, i, n, x, lead(x) OVER w AS nx, (lead(x) OVER w - x) * (n - 1) AS d1, (x - lag(x) OVER w) * (n - 1) AS d0 FROM k WINDOW w AS (PARTITION BY series_id ORDER BY i)),
e AS (SELECT *, CASE WHEN i = 0 THEN (3 * d1 - lead(d1) OVER w) / 2 WHEN i = n - 1 THEN (3 * d0 - lag(d0) OVER w) / 2 END AS s, CASE WHEN i = 0 THEN d1 ELSE d0 END AS own, CASE WHEN i = 0 THEN lead(d1) OVER w ELSE lag(d0) OVER w END AS far FROM d WINDOW w AS (PARTITION BY series_id ORDER BY i)),
m AS (SELECT series_id, i, n, x, nx, CASE WHEN i > 0 AND i < n - 1 THEN CASE WHEN d0 * d1 > 0 THEN 2 / (1 / d0 + 1 / d1) ELSE 0 END WHEN sign(s) <> sign(own) THEN 0 WHEN sign(own) <> sign(far) AND abs(s) > 3 * abs(own) THEN 3 * own ELSE s END AS m FROM e),
c AS (SELECT *, lead(m) OVER (PARTITION BY series_id ORDER BY i) AS nm FROM m),
g AS (SELECT series_id, n, j, j / CAST(99 AS DOUBLE) * (n - 1) AS pos, CAST(least(greatest(floor(j / CAST(99 AS DOUBLE) * (n - 1)), 0), n - 2) AS INTEGER) AS i FROM (SELECT DISTINCT series_id, n FROM k), range(0, 100) AS r(j)),
h AS (SELECT g.series_id, CAST(j AS INTEGER) AS j, (1 + 2 * (pos - g.i)) * power(1 - (pos - g.i), 2) * x + (pos - g.i) * power(1 - (pos - g.i), 2) / (g.n - 1) * m + power(pos - g.i, 2) * (3 - 2 * (pos - g.i)) * nx + power(pos - g.i, 2) * (pos - g.i - 1) / (g.n - 1) * nm AS x FROM g JOIN c ON c.series_id = g.series_id AND c.i = g.i)"""
