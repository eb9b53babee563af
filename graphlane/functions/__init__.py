"""User functions: lowered to Spark expressions where they can be, else to Arrow batches."""

from __future__ import annotations

import inspect
import operator
from collections.abc import Callable
from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDUCERS: dict = {
    operator.add: F.sum, np.add: F.sum, sum: F.sum,
    operator.mul: F.product, np.multiply: F.product,
    min: F.min, np.minimum: F.min, max: F.max, np.maximum: F.max,
    operator.and_: F.bool_and, np.logical_and: F.bool_and, operator.or_: F.bool_or, np.logical_or: F.bool_or,
}


def check_arity(func: Callable, n: int) -> None:
    """TypeError if func can't take n positional arguments."""
    if isinstance(func, np.ufunc):
        if func.nin != n:
            raise TypeError(f"{func.__name__} takes {func.nin} arguments, {n} are given")
        return
    try:
        inspect.signature(func).bind(*[None] * n)
    except ValueError:  # a builtin without a signature
        return
    except TypeError:
        raise TypeError(f"{func} can't be called with {n} arguments") from None


def _type_name(value) -> str:
    if isinstance(value, (bool, np.bool_)):
        return "boolean"
    return "long" if isinstance(value, (int, np.integer)) else "double"


def scalar(df: DataFrame, column: str, func: Callable) -> Column:
    """func of the column: as an expression if func takes a Column, else by Arrow batches of values."""
    check_arity(func, 1)
    try:
        out = func(F.col(column))
        if isinstance(out, Column):
            return out
    except Exception:  # it needs values: comparisons in if, math functions, indexing
        pass
    first = df.select(column).first()
    kind = _type_name(func(first[0])) if first else df.schema[column].dataType.simpleString()

    @F.pandas_udf(kind)
    def batch(s: pd.Series) -> pd.Series:
        return s.map(func)

    return batch(F.col(column))


def reducer(func: Callable):
    """Spark's aggregate that does the same, or None."""
    check_arity(func, 2) if func not in (sum,) else None
    try:
        return REDUCERS.get(func)
    except TypeError:
        return None


def reduce_all(df: DataFrame, column: str, func: Callable):
    """One value for the column; func must be associative and commutative. ValueError without rows."""
    built_in = reducer(func)
    if built_in is not None:
        out = df.agg(built_in(column)).first()[0]
    else:
        kind = df.schema[column].dataType.simpleString()

        def part(batches):
            acc, seen = None, False
            for pdf in batches:
                for v in pdf["v"].tolist():
                    acc, seen = (func(acc, v), True) if seen else (v, True)
            if seen:
                yield pd.DataFrame({"v": [acc]})

        parts = [r[0] for r in df.select(F.col(column).alias("v")).mapInPandas(part, f"v {kind}").collect()]  # one a partition
        out = fold(func, parts) if parts else None
    if out is None:
        raise ValueError("nothing to reduce")
    return int(out) if built_in is F.product and df.schema[column].dataType.simpleString() == "bigint" else out


def reduce_by(df: DataFrame, keys: list[str], column: str, func: Callable) -> DataFrame:
    """(keys, column reduced); func must be associative and commutative."""
    kind = df.schema[column].dataType.simpleString()
    built_in = reducer(func)
    if built_in is not None:
        return df.groupBy(*keys).agg(built_in(column).cast(kind).alias(column))
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + f", {column} {kind}"

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.groupby(keys, as_index=False)[column].agg(lambda s: fold(func, s.tolist()))

    def part(batches):
        for pdf in batches:
            if len(pdf):
                yield folded(pdf)[[*keys, column]]

    # what reaches a group is one row a batch, however many rows its key has
    return df.select(*keys, column).mapInPandas(part, schema).groupBy(*keys).applyInPandas(lambda pdf: folded(pdf)[[*keys, column]], schema)
