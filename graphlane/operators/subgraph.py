"""Parts of graphs, dense cores and samples."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.functions.lots import chance, drawn, lot
from graphlane.operators.clustering import oriented
from graphlane.plans.lists import Lists, batched, with_lists
from graphlane.plans.matching import occurs
from graphlane.plans.tables import Parts, dropped, written
from graphlane.registry import algorithm
from graphlane.types import Graph, NodeSet

NodeID = int


def induced(graph: Graph, nodes: DataFrame) -> Graph:
    """The given nodes and the edges between them."""
    ids = nodes.select("id").distinct()
    edges = graph.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return Graph(graph.nodes.join(ids, "id", "left_semi"), edges.select(*graph.edges.columns), graph.is_directed)


@algorithm("subgraph.extract_subgraph")
def extract_subgraph(graph: Graph, nodes: NodeSet) -> Graph:
    """The part of the graph on the nodes, with values and weights."""
    return induced(graph, nodes.df)


@algorithm("subgraph.k_core", graph={"is_directed": False})
def k_core(graph: Graph, k: int) -> Graph:
    """The largest part in which every node has k neighbours or more."""
    edges = written(graph.simple(), "edges")
    nodes, n = graph.nodes.select("id"), graph.nodes.count()
    while True:
        deg = edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
        keep = written(nodes.join(deg, "id", "left").where(F.coalesce("d", F.lit(0)) >= k).select("id"), "core")
        left = keep.count()
        if left == n:
            return induced(graph, keep)
        nodes, n = keep, left
        edges = written(edges.join(keep.select(F.col("id").alias("a")), "a", "left_semi").join(keep.select(F.col("id").alias("b")), "b", "left_semi"), "edges")


@algorithm("subgraph.k_truss", graph={"is_directed": False})
def k_truss(graph: Graph, k: int) -> Graph:
    """The largest part in which every edge is in k - 2 triangles or more, without isolates."""
    edges = written(oriented(graph), "truss")
    n = edges.count()
    while n:
        e = edges
        wedge = e.select(F.col("lo").alias("x"), F.col("hi").alias("y")).join(e.select(F.col("lo").alias("x"), F.col("hi").alias("z")), "x").where("y != z")
        tri = written(wedge.join(e.select(F.col("lo").alias("y"), F.col("hi").alias("z")), ["y", "z"]).select("x", "y", "z"), "triangles")
        sides = tri.select(F.explode(F.array(F.struct(F.col("x").alias("lo"), F.col("y").alias("hi")), F.struct(F.col("x").alias("lo"), F.col("z").alias("hi")), F.struct(F.col("y").alias("lo"), F.col("z").alias("hi")))).alias("e")).select("e.*")
        support = sides.groupBy("lo", "hi").agg(F.count("*").alias("c"))
        edges = written(e.join(support, ["lo", "hi"], "left").where(F.coalesce("c", F.lit(0)) >= k - 2).select("lo", "hi"), "truss")
        left = edges.count()
        if left == n:
            break
        n = left
    kept = edges.select(F.least("lo", "hi").alias("a"), F.greatest("lo", "hi").alias("b"))
    own = graph.edges.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst")).join(kept, ["a", "b"], "left_semi").select(*graph.edges.columns)
    ends = edges.select(F.explode(F.array("lo", "hi")).alias("id")).distinct()
    return Graph(graph.nodes.join(ends, "id", "left_semi"), own, False)


@algorithm("subgraph.maximal_independent_set")
def maximal_independent_set(graph: Graph, seed: int = 0) -> NodeSet:
    """Nodes without edges between them to which none can be added (Luby): by rounds, those whose hash is the least
    around them join, and their neighbours leave."""
    rank = F.struct(lot(seed, "id").alias("h"), F.col("id"))
    edges = graph.simple()
    walk = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    loops = graph.edges.where("src = dst").select(F.col("src").alias("id")).distinct()
    live = written(graph.nodes.select("id").join(loops, "id", "left_anti"), "live")
    walk = written(walk.join(live.select(F.col("id").alias("a")), "a", "left_semi").join(live.select(F.col("id").alias("b")), "b", "left_semi"), "edges")
    chosen = Parts("chosen")
    while live.limit(1).count():
        least = walk.select("a", F.col("b").alias("id")).groupBy("a").agg(F.min(rank).alias("around"))
        joins = written(live.join(least.withColumnRenamed("a", "id"), "id", "left").where(F.col("around").isNull() | (rank < F.col("around"))).select("id"), "chosen")
        gone = joins.unionByName(walk.join(joins.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))).distinct()
        last = live, walk
        live = written(live.join(gone, "id", "left_anti"), "live")
        walk = written(walk.join(live.select(F.col("id").alias("a")), "a", "left_semi").join(live.select(F.col("id").alias("b")), "b", "left_semi"), "edges")
        dropped(*last)
        chosen.add(joins)
    return NodeSet(chosen.whole() if chosen.parts else live, unique=True)


@algorithm("subgraph.subisomorphic")
def subisomorphic(graph: Graph, subgraph: Graph) -> bool:
    """Whether subgraph is isomorphic to the part of graph on some of its nodes. subgraph must be small."""
    if graph.is_directed != subgraph.is_directed:
        return False
    if subgraph.nodes.count() > graph.nodes.count() or subgraph.edges.count() > graph.edges.count():
        return False
    return occurs(subgraph, graph)


def _share(p: float) -> None:
    if not 0 < p <= 1:
        raise ValueError("p must be over 0 and at most 1")


@algorithm("subgraph.sample.node_sampling")
def node_sampling(graph: Graph, p: float = 0.20, seed: int | None = None) -> Graph:
    """Each node with probability p, and the edges between them."""
    _share(p)
    return induced(graph, written(graph.nodes.where(chance(seed, "id") < p).select("id"), "sample"))


@algorithm("subgraph.sample.edge_sampling")
def edge_sampling(graph: Graph, p: float = 0.20, seed: int | None = None) -> Graph:
    """Each edge with probability p, and their ends."""
    _share(p)
    edges = written(graph.edges.where(chance(seed, "src", "dst") < p), "sample")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph(graph.nodes.join(ends, "id", "left_semi"), edges, graph.is_directed)


@algorithm("subgraph.sample.ties")
def ties(graph: Graph, p: float = 0.20, seed: int | None = None) -> Graph:
    """The ends of edges sampled with probability p, and all edges between them."""
    _share(p)
    edges = written(graph.edges.where(chance(seed, "src", "dst") < p), "sample")
    return induced(graph, edges.select(F.explode(F.array("src", "dst")).alias("id")))


@algorithm("subgraph.sample.random_walk")
def random_walk(graph: Graph, num_steps: int | None = None, num_nodes: int | None = None, num_edges: int | None = None, jump_probability: float = 0.15, start_node: NodeID | None = None, seed: int | None = None) -> Graph:
    """The nodes and edges that a single walker meets until a limit is reached. After a jump, and at a dead end, it
    goes to start_node, or to any node without one; an isolated start_node gives just itself."""
    if not 0 < jump_probability <= 1:
        raise ValueError("jump_probability must be over 0 and at most 1")
    if num_steps is None and num_nodes is None and num_edges is None:
        raise ValueError("a limit is needed")
    directed, lots = graph.is_directed, random.getrandbits(32) if seed is None else seed

    def walk(lists: Lists) -> Iterator[dict]:
        nodes = np.unique(lists.keys)
        at = start_node if start_node is not None else int(nodes[int(drawn(lots, 0, 1) * len(nodes))])
        met, used, steps = {at}, set(), 0
        most_nodes = len(nodes)
        isolated = start_node is not None and not lists.size(start_node)
        idle = 0
        while not isolated:
            before = len(met), len(used)
            steps += 1
            way = drawn(lots, steps, 1)
            if drawn(lots, steps, 0) < jump_probability or not (n := lists.size(at)):
                at = start_node if start_node is not None else int(nodes[int(way * len(nodes))])
                met.add(at)
            else:
                edge = lists.nth(at, int(way * n))
                at = edge[1] if edge[0] == at else edge[0]
                met.add(at)
                used.add(edge)
            idle = 0 if (len(met), len(used)) != before else idle + 1
            if num_steps is not None and steps >= num_steps or num_nodes is not None and len(met) >= min(num_nodes, most_nodes) or num_edges is not None and len(used) >= min(num_edges, most_edges):
                break
            if num_steps is None and idle > 10_000 + 100 * (most_nodes + most_edges):  # the rest can't be reached
                break
        met, used = np.array(sorted(met), "int64"), np.array(sorted(used), "int64").reshape(-1, 2)
        yield from batched(edge=np.zeros(len(met)), src=met, dst=met)
        yield from batched(edge=np.ones(len(used)), src=used[:, 0], dst=used[:, 1])

    if start_node is not None and not graph.nodes.where(F.col("id") == start_node).limit(1).count():
        raise ValueError(f"no node {start_node}")
    if not graph.nodes.limit(1).count():
        return graph
    most_edges = graph.edges.count()
    ends = graph.edges.select(F.col("src").alias("key"), "src", "dst")
    if not directed:  # an edge is in the list of both ends, as it is stored
        ends = ends.unionByName(graph.edges.where("src != dst").select(F.col("dst").alias("key"), "src", "dst"))
    met = written(with_lists(ends, graph.nodes.select("id"), walk, "edge long, src long, dst long"), "walk")
    nodes = met.where("edge = 0").select(F.col("src").alias("id"))
    edges = graph.edges.join(met.where("edge = 1"), ["src", "dst"], "left_semi").select(*graph.edges.columns)
    return Graph(graph.nodes.join(nodes, "id", "left_semi"), edges, directed)
