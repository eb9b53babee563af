"""Centrality measures. Iterations keep the edges in one written table and a written state for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.errors import ConvergenceError
from graphlane.operators.traversal import distances
from graphlane.operators.utility import degrees
from graphlane.plans.tables import written
from graphlane.registry import algorithm
from graphlane.types import Graph, NodeMap, NodeSet

NUMBERS = {"edge_type": "map", "edge_dtype": ("int", "float")}


def _sums(edges: DataFrame, state: DataFrame, value: str, by: str = "dst", at: str = "src") -> DataFrame:
    """(id, s): for each node the sum of weight times the value at the edges' other ends."""
    return edges.join(state.select(F.col("id").alias(at), F.col(value).alias("v")), at).groupBy(F.col(by).alias("id")).agg(F.sum(F.col("weight") * F.col("v")).alias("s"))


def _moved(state: DataFrame) -> float:
    return state.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0] or 0.0


@algorithm("centrality.pagerank", graph=NUMBERS)
def pagerank(graph: Graph, damping: float = 0.85, maxiter: int = 50, tolerance: float = 1e-05) -> NodeMap:
    """PageRank of the unweighted graph; what nodes without out-edges hold goes to all alike. ConvergenceError if the
    ranks still move by tolerance a node after maxiter rounds."""
    walk = graph.both_ways()
    out = walk.groupBy("src").agg(F.count("*").alias("n"))
    edges = written(walk.join(out, "src").select("src", "dst", (1.0 / F.col("n")).alias("weight")), "edges")
    n = graph.nodes.count()
    if n == 0:
        return NodeMap(graph.nodes.select("id", F.lit(0.0).alias("value")))
    state = written(graph.nodes.select("id").join(out.select(F.col("src").alias("id"), F.lit(False).alias("stuck")), "id", "left").select("id", F.coalesce("stuck", F.lit(True)).alias("stuck"), F.lit(1.0 / n).alias("x")), "ranks")
    for _ in range(maxiter):
        lost = state.where("stuck").agg(F.sum("x")).first()[0] or 0.0
        new = state.join(_sums(edges, state, "x"), "id", "left").select("id", "stuck", (damping * (F.coalesce("s", F.lit(0.0)) + lost / n) + (1 - damping) / n).alias("x"), F.col("x").alias("old"))
        state = written(new, "ranks")
        if _moved(state) < n * tolerance:
            return NodeMap(state, value="x")
    raise ConvergenceError(f"pagerank did not converge in {maxiter} rounds")


@algorithm("centrality.katz", graph=NUMBERS)
def katz(graph: Graph, attenuation_factor: float = 0.01, immediate_neighbor_weight: float = 1.0, maxiter: int = 50, tolerance: float = 1e-05) -> NodeMap:
    """Katz centrality on weighted in-edges, of length 1."""
    edges = written(graph.both_ways("weight"), "edges")
    n, state = graph.nodes.count(), graph.nodes.select("id", F.lit(0.0).alias("x"))
    for _ in range(maxiter):
        new = state.join(_sums(edges, state, "x"), "id", "left").select("id", (attenuation_factor * F.coalesce("s", F.lit(0.0)) + immediate_neighbor_weight).alias("x"), F.col("x").alias("old"))
        state = written(new, "katz")
        if _moved(state) < n * tolerance:
            length = state.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
            return NodeMap(state.select("id", (F.col("x") / length).alias("value")))
    raise ConvergenceError(f"katz did not converge in {maxiter} rounds")


@algorithm("centrality.eigenvector", graph=NUMBERS)
def eigenvector(graph: Graph, maxiter: int = 50, tolerance: float = 1e-05) -> NodeMap:
    """The dominant eigenvector on weighted in-edges, of length 1, by power iteration on the matrix plus one."""
    edges = written(graph.both_ways("weight"), "edges")
    n = graph.nodes.count()
    state, length = graph.nodes.select("id", F.lit(1.0 / max(n, 1)).alias("x")), 1.0
    for _ in range(maxiter):
        raw = written(state.join(_sums(edges, state, "x"), "id", "left").select("id", (F.col("x") + F.coalesce("s", F.lit(0.0))).alias("y"), F.col("x").alias("old")), "eigen")
        length = raw.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 1.0
        state = raw.select("id", (F.col("y") / length).alias("x"), "old")
        if _moved(state) < n * tolerance:
            return NodeMap(state, value="x")
    raise ConvergenceError(f"eigenvector did not converge in {maxiter} rounds")


@algorithm("centrality.hits", graph={**NUMBERS, "is_directed": True})
def hits(graph: Graph, maxiter: int = 50, tolerance: float = 1e-05, normalize: bool = True) -> tuple[NodeMap, NodeMap]:
    """(hubs, authorities) on weights; with normalize each adds up to 1, else the largest is 1."""
    edges = written(graph.edges, "edges")
    n = graph.nodes.count()
    hubs = graph.nodes.select("id", F.lit(1.0 / max(n, 1)).alias("x"))
    for _ in range(maxiter):
        authorities = written(graph.nodes.select("id").join(_sums(edges, hubs, "x"), "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("x")), "authorities")
        raw = written(hubs.select("id", F.col("x").alias("old")).join(_sums(edges, authorities, "x", by="src", at="dst"), "id", "left").select("id", "old", F.coalesce("s", F.lit(0.0)).alias("y")), "hubs")
        most = raw.agg(F.max("y")).first()[0] or 1.0
        hubs = raw.select("id", (F.col("y") / most).alias("x"), "old")
        if _moved(hubs) < tolerance:
            scaled = []
            for part in (hubs, authorities):
                total = part.agg(F.sum("x") if normalize else F.max("x")).first()[0] or 1.0
                scaled.append(NodeMap(part.select("id", (F.col("x") / total).alias("value"))))
            return scaled[0], scaled[1]
    raise ConvergenceError(f"hits did not converge in {maxiter} rounds")


@algorithm("centrality.degree")
def degree_centrality(graph: Graph, in_edges: bool = False, out_edges: bool = True) -> NodeMap:
    """Degrees divided by the number of other nodes; a single node has 1."""
    n = graph.nodes.count()
    value = F.col("value") / (n - 1) if n > 1 else F.lit(1.0)
    return NodeMap(degrees(graph, in_edges, out_edges).select("id", value.cast("double").alias("value")))


@algorithm("centrality.closeness", graph=NUMBERS)
def closeness(graph: Graph, nodes: NodeSet | None = None) -> NodeMap:
    """Of each node ((r - 1) / sum of distances to it) * ((r - 1) / (n - 1)), r the nodes that reach it with itself."""
    n = graph.nodes.count()
    scored = graph.nodes.select("id") if nodes is None else graph.nodes.select("id").join(nodes.df, "id", "left_semi")
    back = Graph(graph.nodes, graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), graph.is_directed)
    near = distances(back, scored).where("s != id").groupBy(F.col("s").alias("id")).agg(F.count("*").alias("r"), F.sum("d").alias("total"))
    value = F.when(F.coalesce("total", F.lit(0)) > 0, F.col("r") / F.col("total") * F.col("r") / max(n - 1, 1)).otherwise(0.0)
    return NodeMap(scored.join(near, "id", "left").select("id", value.cast("double").alias("value")))


@algorithm("centrality.betweenness", graph=NUMBERS)
def betweenness(graph: Graph, nodes: NodeSet | None = None, normalize: bool = False) -> NodeMap:
    """The shares of shortest paths between the given nodes (all by default) that pass a node, ends left out; weights
    must be positive for paths to be countable. Paths are counted forward along shortest-path edges, dependencies
    backward, for all sources at once."""
    ends = graph.nodes.select("id") if nodes is None else nodes.df
    walk = written(graph.both_ways("weight"), "edges")
    best = written(distances(graph, ends), "distances")
    tail, head = best.select("s", F.col("id").alias("u"), F.col("d").alias("du")), best.select("s", F.col("id").alias("v"), F.col("d").alias("dv"))
    tight = F.abs(F.col("du") + F.col("weight") - F.col("dv")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("dv"))
    dag = written(tail.join(walk.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight"), "u").where("weight > 0").join(head, ["s", "v"]).where(tight).select("s", "u", "v"), "dag")
    settled = written(best.where("s = id").select("s", "id", F.lit(1.0).alias("sigma"), F.lit(0).alias("level")), "sigma")
    waiting, level = dag, 0
    while waiting.limit(1).count():
        level += 1
        # nodes all of whose shortest-path edges come from settled nodes
        known = written(waiting.join(settled.select("s", F.col("id").alias("u"), "sigma"), ["s", "u"], "left").groupBy("s", F.col("v").alias("id")).agg(F.sum("sigma").alias("sigma"), F.bool_or(F.col("sigma").isNull()).alias("open")), "sigma")
        fresh = known.where("not open").select("s", "id", "sigma", F.lit(level).alias("level"))
        settled = written(settled.unionByName(fresh), "sigma")
        waiting = written(waiting.join(fresh.select("s", F.col("id").alias("v")), ["s", "v"], "left_anti"), "dag")
    target = ends.select("id", F.lit(1.0).alias("aim"))
    state = written(settled.join(target, "id", "left").select("s", "id", "sigma", "level", F.when(F.col("s") == F.col("id"), 0.0).otherwise(F.coalesce("aim", F.lit(0.0))).alias("aim")), "delta")
    steps = written(dag.join(settled.select("s", F.col("id").alias("u"), F.col("sigma").alias("su")), ["s", "u"]), "dag")
    delta = state.select("s", "id", "sigma", "level", "aim", F.lit(0.0).alias("delta"))
    for at in range(level, 0, -1):
        done = delta.where(F.col("level") == at).select("s", F.col("id").alias("v"), F.col("sigma").alias("sv"), (F.col("aim") + F.col("delta")).alias("w"))
        add = steps.join(done, ["s", "v"]).groupBy("s", F.col("u").alias("id")).agg(F.sum(F.col("su") / F.col("sv") * F.col("w")).alias("add"))
        delta = written(delta.join(add, ["s", "id"], "left").select("s", "id", "sigma", "level", "aim", (F.col("delta") + F.coalesce("add", F.lit(0.0))).alias("delta")), "delta")
    total = delta.where("s != id").groupBy("id").agg(F.sum("delta").alias("b"))
    n = graph.nodes.count()
    scale = 1.0 if graph.is_directed else 0.5
    if normalize:
        scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return NodeMap(graph.nodes.select("id").join(total, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("value")))
