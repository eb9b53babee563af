"""Edges that arrive as a stream: what can be kept up to date without a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degree_stream(edges: DataFrame, src: str = "src", dst: str = "dst", in_edges: bool = False, out_edges: bool = True) -> DataFrame:
    """(id, value): running degrees of a directed edge stream, for complete or update output. State: a count a node."""
    ends = [c for c, on in ((src, out_edges), (dst, in_edges)) if on]
    if not ends:
        raise ValueError("in_edges or out_edges is needed")
    return edges.select(F.explode(F.array(*ends)).alias("id")).groupBy("id").agg(F.count("*").alias("value"))


def windowed_edges(edges: DataFrame, ts: str, window: str, late: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """(window, src, dst, weight): edge counts of event-time windows; rows later than late are dropped by the
    watermark, which also bounds the state."""
    return edges.withWatermark(ts, late).groupBy(F.window(ts, window), src, dst).agg(F.count("*").alias("weight"))
