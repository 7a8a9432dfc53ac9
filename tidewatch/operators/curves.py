"""Array operators: one row a series, curves as arrays, NumPy kernels in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import features as features_of
from tidewatch.functions import kernels as K

CURVE = T.ArrayType(T.DoubleType())


def resampled(v: Column, n: int = 100, clip: bool = True, renormalise: bool = False, eps: float = 1e-12) -> Column:
    """Min-max normalised and on n places by monotone cubic interpolation; null for fewer than two values or a flat series."""

    @F.pandas_udf(CURVE)
    def run(series: pd.Series) -> pd.Series:
        def one(x):
            x = np.asarray(x, float) if x is not None else np.zeros(0)
            return K.resample(K.minmax(x, eps), n, clip, renormalise).tolist() if len(x) > 1 and np.ptp(x) > 0 and np.isfinite(x).all() else None

        return series.map(one)

    return run(v)


def smoothed(v: Column, part: float = 8.0, least: int = 2) -> Column:
    """Gaussian smoothing with sigma = max(least, n / part)."""

    @F.pandas_udf(CURVE)
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda x: K.gaussian(np.asarray(x, float), max(least, int(len(x) / part))).tolist() if x is not None and len(x) else None)

    return run(v)


def features(df: DataFrame, value: str = "x", names: list[str] | None = None) -> DataFrame:
    """Columns of df but the curve, with one double column for each feature and `error`; all 51 features, or the named ones."""
    names = names or features_of.NAMES
    kept = [f for f in df.schema.fields if f.name != value]
    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("error", T.StringType())])
    at = [features_of.NAMES.index(n) for n in names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [features_of.extract(x if x is not None else []) for x in b[value]]
            out = b[[f.name for f in kept]].copy()
            m = np.array([f for f, _ in found], float).reshape(-1, len(features_of.NAMES))
            for name, j in zip(names, at, strict=True):
                out[name] = m[:, j]
            out["error"] = [e for _, e in found]
            yield out

    return df.mapInPandas(run, schema)


def original_points(x: Column, positions: Column, size: int = 500) -> Column:
    """Values of a resampled curve at the places its observations came from; halves round to the even place."""
    return F.transform(positions, lambda p: F.element_at(x, F.bround(p * (size - 1)).cast("int") + 1))
