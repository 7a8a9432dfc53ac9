"""Column expressions with one fixed rule for nulls, NaN and degenerate input each."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def finite(x: Column, fallback: float = 0.0) -> Column:
    """x, or the fallback where x is null, NaN or infinite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(fallback)).otherwise(x)


def number(text: Column) -> Column:
    """Text as a double; null where it isn't a number."""
    return text.try_cast("double")


def share(part: Column, whole: Column) -> Column:
    """Percent; null for a zero whole."""
    return 100.0 * F.try_divide(part, whole)


def _over(agg: Column, window: WindowSpec | None) -> Column:
    return agg if window is None else agg.over(window)


def correlation(x: Column, y: Column, constant: float | None = None, window: WindowSpec | None = None) -> Column:
    """Pearson correlation as an aggregate, or over a window; `constant` where a side doesn't vary."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.sqrt(_over(F.var_pop(F.when(both, x)), window) * _over(F.var_pop(F.when(both, y)), window))
    r = F.try_divide(_over(F.covar_pop(x, y), window), spread)
    return r if constant is None else F.coalesce(r, F.lit(constant))


def r_squared(y: Column, x: Column, window: WindowSpec | None = None) -> Column:
    """Share of y's variance that a line over x explains; 0.0 where y doesn't vary."""
    r = correlation(x, y, None, window)
    return F.coalesce(r * r, F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def skew(x: Column, eps: float = 1e-10) -> Column:
    """Mean cubed deviation over (population sd + eps) cubed, from power sums."""
    n, s1, s2, s3 = F.count(x), F.sum(x), F.sum(x * x), F.sum(x * x * x)
    m = s1 / n
    third = s3 / n - 3 * m * s2 / n + 2 * m * m * m
    return third / F.pow(F.sqrt(F.greatest(s2 / n - m * m, F.lit(0.0))) + eps, F.lit(3))


def kurtosis_raw(x: Column, eps: float = 1e-10) -> Column:
    """Mean fourth power deviation over (population sd + eps) to the fourth, from power sums."""
    n, s1, s2, s3, s4 = F.count(x), F.sum(x), F.sum(x * x), F.sum(x * x * x), F.sum(x * x * x * x)
    m = s1 / n
    fourth = s4 / n - 4 * m * s3 / n + 6 * m * m * s2 / n - 3 * m * m * m * m
    return fourth / F.pow(F.sqrt(F.greatest(s2 / n - m * m, F.lit(0.0))) + eps, F.lit(4))


def scale_tag(region: Column, world: tuple[str, ...] = ("world", "global")) -> Column:
    return F.when(F.lower(F.trim(region)).isin(*world), "global").otherwise("national")


def bucket(x: Column, edges: list[float]) -> Column:
    """0-based number of the right-closed interval (edges[i], edges[i + 1]] that x lies in; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        out = F.when((x > edges[i]) & (x <= edges[i + 1]), F.lit(i)).otherwise(out)
    return out
