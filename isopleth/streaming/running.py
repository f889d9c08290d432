"""Incremental forms: windowed means and cumulative averages of event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_mean(stream: DataFrame, time: str, value: str, keys: list[str], width: str, slide: str, late: str) -> DataFrame:
    """(keys, start, mean, n) of sliding windows; rows later than ``late`` are dropped and
    their windows' state with them."""
    w = F.window(time, width, slide)
    agg = stream.withWatermark(time, late).groupBy(w, *keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return agg.select(*keys, F.col("window.start").alias("start"), "mean", "n")


def cumulative_average(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean) after every micro-batch: two numbers of state a key."""

    def update(name, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in frames:
            good = pdf[value].dropna()
            n, total = n + len(good), total + float(good.sum())
        state.update((n, total))
        yield pd.DataFrame({key: [name[0]], "n": [n], "mean": [total / n if n else None]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, n long, mean double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
