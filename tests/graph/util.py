"""The small graphs that the operators' known results belong to."""

from graphlane import EdgeMap, EdgeSet, Graph, NodeSet
from graphlane.sources import node_set


def graph(spark, edges, directed=True, nodes=()):
    if len(edges[0]) == 2:
        e = EdgeSet(spark.createDataFrame([(int(a), int(b)) for a, b in edges], "source long, target long"), is_directed=directed)
    else:
        kind = "double" if any(isinstance(w, float) for _, _, w in edges) else "long"
        e = EdgeMap(spark.createDataFrame([(a, b, float(w) if kind == "double" else w) for a, b, w in edges], f"source long, target long, weight {kind}"), is_directed=directed)
    return Graph.from_edges(e, node_set(spark, list(nodes)) if nodes else None)


def values(m):
    return {r[0]: r[1] for r in m.df.collect()}


def edges(g):
    return {tuple(r) for r in g.edges.collect()}


def ids(g):
    return {r[0] for r in (g.df if isinstance(g, NodeSet) else g.nodes).select("id").collect()}


STANDARD = [(0, 3, 1), (1, 0, 2), (1, 4, 3), (2, 4, 4), (2, 5, 5), (2, 7, 6), (3, 1, 7), (3, 4, 8), (4, 5, 9), (5, 6, 10), (6, 2, 11)]
