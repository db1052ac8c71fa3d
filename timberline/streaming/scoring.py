"""Streams: scoring rows as they come, and a forgetting mean per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timberline.sources.model import Model


def score_stream(rows: DataFrame, model: Model, **options) -> DataFrame:
    """Scores of a streaming DataFrame: scoring is a column expression, so batch and stream share it."""
    return model.score(rows, **options)


def smoothed_stream(rows: DataFrame, key: str, value: str, forget: float = 0.9) -> DataFrame:
    """key, n, smoothed after each micro-batch: the exponentially forgetting mean of the values of a key, in arrival order."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, theta, rinv = state.get if state.exists else (0, 0.0, 0.0)
        for b in batches:
            for y in b[value]:
                rinv = 1.0 if n == 0 else rinv / (forget + rinv)
                theta += rinv * (float(y) - theta)
                n += 1
        state.update((n, theta, rinv))
        yield pd.DataFrame({key: [k[0]], "n": [n], "smoothed": [theta]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, value).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, smoothed double", "n long, theta double, rinv double", "update", GroupStateTimeout.NoTimeout)


def files(reader: DataStreamReader, schema, path: str) -> DataFrame:
    return reader.schema(schema).parquet(path)
