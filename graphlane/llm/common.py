"""Small helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlane.plans.tables import dropped, shared_dir, written

__all__ = ["bucket_of", "dropped", "pieces_of", "shared_dir", "table", "text_or_empty", "type_of", "written"]

PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bucket_of(id_col: str, m: int):
    """crc32 of the id as text, modulo m: the fold that held-out rows are chosen by. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def pieces_of(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows with at most so many bytes of text, or one longer text: what a worker holds as
    Python objects at a time. Null texts are empty."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    start = 0
    while start < len(texts):
        stop = max(int(np.searchsorted(size, (size[start - 1] if start else 0) + most, "right")), start + 1)
        yield start, [t or "" for t in texts.slice(start, stop - start).to_pylist()]
        start = stop
