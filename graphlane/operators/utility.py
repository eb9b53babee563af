"""Operators on node sets, node maps, edges and whole graphs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.functions import check_arity, reduce_all, reduce_by, reducer, scalar
from graphlane.functions.lots import lot
from graphlane.plans.matching import same_structure
from graphlane.plans.ordering import positions
from graphlane.registry import algorithm
from graphlane.types import EdgeMap, EdgeSet, Graph, NodeMap, NodeSet, Vector


def literal(value):
    """A weight or value: int and float as long and double."""
    if isinstance(value, bool):
        return F.lit(value)
    return F.lit(value).cast("long" if isinstance(value, int) else "double")


@algorithm("util.nodeset.choose_random")
def choose_random(x: NodeSet, k: int, seed: int | None = None) -> NodeSet:
    """k different nodes, chosen at random; ValueError if there are fewer."""
    order = F.rand() if seed is None else lot(seed, "id")
    chosen = x.df.orderBy(order, "id").limit(k)
    if chosen.count() < k:
        raise ValueError(f"fewer than {k} nodes")
    return NodeSet(chosen, unique=True)


@algorithm("util.nodeset.from_vector")
def nodeset_from_vector(x: Vector) -> NodeSet:
    """The distinct values of a vector of integers."""
    if x.dtype != "int":
        raise TypeError("node ids must be integers")
    return NodeSet(x.df, "value")


@algorithm("util.nodemap.sort")
def nodemap_sort(x: NodeMap, ascending: bool = True, limit: int | None = None) -> Vector:
    """Ids by value, then id; at most limit of them (none or 0: all)."""
    order = (F.col("value").asc() if ascending else F.col("value").desc(), F.col("id").asc())
    if limit:
        from pyspark.sql.window import Window

        top = x.df.orderBy(*order).limit(limit)
        return Vector(top.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("pos"), F.col("id").alias("value")))
    return Vector(positions(x.df, *order).select("pos", F.col("id").alias("value")))


@algorithm("util.nodemap.select")
def nodemap_select(x: NodeMap, nodes: NodeSet) -> NodeMap:
    """The part of x whose ids are in nodes; ids that x lacks don't matter."""
    return NodeMap(x.df.join(nodes.df, "id", "left_semi"))


@algorithm("util.nodemap.filter")
def nodemap_filter(x: NodeMap, func: Callable) -> NodeSet:
    """The nodes whose value func holds for."""
    return NodeSet(x.df.where(scalar(x.df, "value", func).cast("boolean")), unique=True)


@algorithm("util.nodemap.apply")
def nodemap_apply(x: NodeMap, func: Callable) -> NodeMap:
    """func of each value; the type may change."""
    return NodeMap(x.df.select("id", scalar(x.df, "value", func).alias("value")))


@algorithm("util.nodemap.reduce")
def nodemap_reduce(x: NodeMap, func: Callable):
    """All values folded by func, which must be associative and commutative; ValueError without values."""
    return reduce_all(x.df, "value", func)


@algorithm("util.edgemap.from_edgeset")
def edgemap_from_edgeset(edgeset: EdgeSet, default_value) -> EdgeMap:
    """Every edge with the same weight."""
    return EdgeMap(edgeset.df.withColumn("weight", literal(default_value)), "src", "dst", "weight", edgeset.is_directed, check=False)


def _incident(graph: Graph, in_edges: bool, out_edges: bool, *columns: str, loops_twice: bool) -> DataFrame:
    """(id, columns): a row for each edge end that counts."""
    ends = []
    if graph.is_directed:
        ends = [c for c, on in (("src", out_edges), ("dst", in_edges)) if on]
        return graph.edges.select(F.explode(F.array(*ends)).alias("id"), *columns) if ends else graph.edges.select(F.col("src").alias("id"), *columns).where(F.lit(False))
    if not (in_edges or out_edges):
        return graph.edges.select(F.col("src").alias("id"), *columns).where(F.lit(False))
    ends = F.array("src", "dst") if loops_twice else F.array_distinct(F.array("src", "dst"))
    return graph.edges.select(F.explode(ends).alias("id"), *columns)


def degrees(graph: Graph, in_edges: bool = False, out_edges: bool = True) -> DataFrame:
    """(id, value) with the degree of each node; isolates have 0. Map-side counts precede the shuffle."""
    counted = _incident(graph, in_edges, out_edges, loops_twice=True).groupBy("id").agg(F.count("*").alias("value"))
    return graph.nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


@algorithm("util.graph.degree")
def degree(graph: Graph, in_edges: bool = False, out_edges: bool = True) -> NodeMap:
    """The number of edges at each node; without either flag 0, undirected loops count twice."""
    return NodeMap(degrees(graph, in_edges, out_edges))


@algorithm("util.graph.aggregate_edges", graph={"edge_type": "map"})
def aggregate_edges(graph: Graph, func: Callable, initial_value, in_edges: bool = False, out_edges: bool = True) -> NodeMap:
    """The weights of each node's edges folded by func, from initial_value; func must be associative and commutative.
    Undirected edges count at both ends if either flag is set, loops once; directed loops once for each flag."""
    check_arity(func, 2) if func is not sum else None
    ends = _incident(graph, in_edges, out_edges, "weight", loops_twice=False)
    start = graph.nodes.select("id", literal(initial_value).alias("weight"))
    kind = "double" if "float" in (graph.edge_dtype, "float" if isinstance(initial_value, float) else "") else "boolean" if graph.edge_dtype == "bool" else "long"
    if reducer(func) is not None:
        rows = ends.select("id", F.col("weight").cast(kind).alias("weight")).unionByName(start.select("id", F.col("weight").cast(kind).alias("weight")))
        return NodeMap(reduce_by(rows, ["id"], "weight", func), value="weight")
    folded = reduce_by(ends.select("id", F.col("weight").cast(kind).alias("weight")), ["id"], "weight", func)

    def begin(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "value": [initial_value if pd.isna(w) else func(initial_value, w) for w in pdf["weight"]]})

    return NodeMap(graph.nodes.select("id").join(folded, "id", "left").mapInPandas(begin, f"id long, value {kind}"))


@algorithm("util.graph.filter_edges", graph={"edge_type": "map"})
def filter_edges(graph: Graph, func: Callable) -> Graph:
    """The graph with the edges whose weight func holds for, and all nodes."""
    return graph.with_edges(graph.edges.where(scalar(graph.edges, "weight", func).cast("boolean")))


@algorithm("util.graph.assign_uniform_weight")
def assign_uniform_weight(graph: Graph, weight=1) -> Graph:
    """Every edge with the same weight."""
    return graph.with_edges(graph.edges.select("src", "dst", literal(weight).alias("weight")))


@algorithm("util.graph.build")
def build(edges: EdgeSet | EdgeMap, nodes: NodeSet | NodeMap | None = None) -> Graph:
    """A graph of the edges, their endpoints and the given nodes."""
    return Graph.from_edges(edges, nodes)


@algorithm("util.graph.collapse_by_label", graph={"is_directed": False})
def collapse_by_label(graph: Graph, labels: NodeMap, aggregator: Callable, keep_loops: bool = True) -> Graph:
    """A node for each label, and the weights of edges between two labels folded by aggregator. Edges inside a label
    become loops unless keep_loops is off. Without weights each edge counts 1."""
    edges = graph.edges if graph.edge_type == "map" else graph.edges.withColumn("weight", F.lit(1).cast("long"))
    ls, ld = labels.df.select(F.col("id").alias("src"), F.col("value").alias("ls")), labels.df.select(F.col("id").alias("dst"), F.col("value").alias("ld"))
    between = edges.join(ls, "src").join(ld, "dst").select(F.least("ls", "ld").alias("src"), F.greatest("ls", "ld").alias("dst"), "weight")
    if not keep_loops:
        between = between.where("src != dst")
    nodes = labels.df.join(graph.nodes, "id", "left_semi").select(F.col("value").alias("id")).distinct()
    return Graph(nodes, reduce_by(between, ["src", "dst"], "weight", aggregator), is_directed=False)


@algorithm("util.graph.isomorphic")
def isomorphic(g1: Graph, g2: Graph) -> bool:
    """Whether the graphs differ only in their ids. Counts and degree histograms are compared first, in Spark."""
    if g1.is_directed != g2.is_directed or g1.nodes.count() != g2.nodes.count() or g1.edges.count() != g2.edges.count():
        return False

    def histogram(g: Graph) -> DataFrame:
        both = degrees(g, True, False).select("id", F.col("value").alias("i")).join(degrees(g, False, True).select("id", F.col("value").alias("o")), "id")
        loops = g.edges.where("src = dst").select(F.col("src").alias("id")).withColumn("l", F.lit(1))
        return both.join(loops, "id", "left").groupBy("i", "o", "l").agg(F.count("*").alias("n"))

    if histogram(g1).exceptAll(histogram(g2)).limit(1).count():
        return False
    return same_structure(g1, g2)

