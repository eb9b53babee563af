"""Projection of bipartite graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlane.plans.tables import written
from graphlane.registry import algorithm
from graphlane.types import BipartiteGraph, Graph


@algorithm("bipartite.graph_projection")
def graph_projection(bgraph: BipartiteGraph, nodes_retained: int = 0) -> Graph:
    """The nodes of one part, joined where they have a common neighbour; undirected, without weights. A node meets those
    of 64 ids that follow each other at once, as the bits of a number, so what is shuffled grows with such blocks, at
    most with the paths of two edges, which a hub of the other part drives."""
    if nodes_retained not in (0, 1):
        raise ValueError("nodes_retained must be 0 or 1")
    keep, drop = ("src", "dst") if nodes_retained == 0 else ("dst", "src")
    ends = bgraph.edges.select(F.col(keep).alias("k"), F.col(drop).alias("via")).distinct()
    ends = written(ends, "projection")  # so that adaptive execution can split a hub
    block, bit = F.shiftright("k", 6).alias("block"), F.expr("shiftleft(cast(1 as bigint), cast(k & 63 as int))")
    blocks = written(ends.groupBy("via", block).agg(F.bit_or(bit).alias("bits")), "blocks")
    met = ends.select("via", F.col("k").alias("src")).join(blocks.hint("merge"), "via").where(F.col("block") >= F.shiftright("src", 6))
    met = met.groupBy("src", "block").agg(F.bit_or("bits").alias("bits"))
    pairs = met.select("src", "block", "bits", F.explode(F.array(*map(F.lit, range(64)))).alias("at")).where("shiftright(bits, at) & 1 = 1")
    pairs = pairs.select("src", (F.shiftleft("block", 6) + F.col("at")).alias("dst")).where("src < dst")
    return Graph(bgraph.parts[nodes_retained], pairs, is_directed=False)
