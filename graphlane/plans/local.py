"""Sequential algorithms in one task, behind a check of their input's size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

MOST_ROWS = 5_000_000


def in_one_task(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = MOST_ROWS) -> DataFrame:
    """func of the whole frame in one executor task; ValueError beyond most rows, as that wouldn't fit a task."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"this algorithm is sequential and takes at most {most} rows")
    if n == 0:
        return df.sparkSession.createDataFrame([], schema)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield func(pd.concat(list(batches), ignore_index=True))

    return df.repartition(1).mapInPandas(whole, schema)
