"""Early-warning statistics on an event stream. An extra: the same trailing windows as the batch operators, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Summed value by event type and time window, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("series_id")).agg(F.sum("value").alias("v"))


def rolling(events: DataFrame, width: int = 10) -> DataFrame:
    """For each series (series_id, t, v), as rows arrive in order of t: variance and lag-1 correlation of the last `width` values.

    The state holds `width` values a series, whatever has passed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        from tidewatch.functions.kernels import lag1_halves

        (kept,) = state.get if state.exists else ([],)
        kept, out = list(kept), []
        for b in batches:
            for t, v in b.sort_values("t")[["t", "v"]].itertuples(index=False):
                kept = [*kept, float(v)][-width:]
                if len(kept) == width:
                    x = np.array(kept)
                    out.append((key[0], int(t), float(x.var()), lag1_halves(x)))
        state.update((kept,))
        yield pd.DataFrame(out, columns=["series_id", "t", "var", "ac1"])

    return events.groupBy("series_id").applyInPandasWithState(step, "series_id string, t long, var double, ac1 double", "kept array<double>", "append", GroupStateTimeout.NoTimeout)
