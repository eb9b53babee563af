"""Searches, shortest paths and spanning trees."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.functions import check_arity
from graphlane.plans.components import components
from graphlane.plans.lists import BLOCK, Lists, batched, with_lists
from graphlane.plans.ordering import positions
from graphlane.plans.tables import Parts, dropped, written
from graphlane.registry import algorithm
from graphlane.types import Graph, NodeMap, Vector

NUMBERS = {"edge_type": "map", "edge_dtype": ("int", "float")}
NodeID = int


def _start(graph: Graph, node: int) -> None:
    if not graph.nodes.where(F.col("id") == node).limit(1).count():
        raise ValueError(f"no node {node}")


def distances(graph: Graph, sources: DataFrame) -> DataFrame:
    """(s, id, d): the least weight of a walk from each source to each node that it reaches; written.

    Each round only relaxes edges of nodes whose distance has fallen. ValueError if there is a negative cycle, which
    shows in distances that still fall after as many rounds as there are nodes."""
    walk = written(graph.both_ways("weight"), "edges")
    zero = F.lit(0).cast(dict(graph.edges.dtypes)["weight"])
    last = best = written(sources.select(F.col("id").alias("s"), "id", zero.alias("d")), "distances")
    fallen, rounds = best, 0
    most = graph.nodes.count()
    while fallen.limit(1).count():
        if rounds > most:
            raise ValueError("the graph has a negative cycle")
        rounds += 1
        reached = fallen.join(walk, fallen["id"] == walk["src"]).groupBy("s", F.col("dst").alias("id")).agg(F.min(F.col("d") + F.col("weight")).alias("new"))
        merged = written(best.join(reached, ["s", "id"], "full").select("s", "id", F.least("d", "new").alias("d"), (F.col("new").isNotNull() & (F.col("d").isNull() | (F.col("new") < F.col("d")))).alias("fell")), "distances")
        dropped(last)
        last, best, fallen = merged, merged.select("s", "id", "d"), merged.where("fell").select("s", "id", "d")
    dropped(walk)
    return best


def _parents(graph: Graph, best: DataFrame) -> DataFrame:
    """(s, id, parent): for each node but the source the predecessor on a shortest path, the one with the least number
    of edges from the source, then the least id. Counting edges keeps edges of weight 0 from making cycles."""
    walk = graph.both_ways("weight")
    tail, head = best.select("s", F.col("id").alias("u"), F.col("d").alias("du")), best.select("s", F.col("id").alias("v"), F.col("d").alias("dv"))
    tight = F.abs(F.col("du") + F.col("weight") - F.col("dv")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(F.col("dv").cast("double")))
    steps = written(tail.join(walk.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight"), "u").join(head, ["s", "v"]).where(tight & (F.col("u") != F.col("v"))).select("s", "u", "v", F.col("weight") <= 0), "tight")
    steps = steps.toDF("s", "u", "v", "free")
    if not steps.where("free").limit(1).count():  # distances rise along every step
        return steps.where("s != v").groupBy("s", F.col("v").alias("id")).agg(F.min("u").alias("parent"))
    seen = best.where("s = id").select("s", "id", F.col("id").alias("parent"))
    edge = seen
    while edge.limit(1).count():
        edge = written(edge.select("s", F.col("id").alias("u")).join(steps, ["s", "u"]).groupBy("s", F.col("v").alias("id")).agg(F.min("u").alias("parent")).join(seen.select("s", "id"), ["s", "id"], "left_anti"), "parents")
        seen = written(seen.unionByName(edge), "parents")
    return seen.where("s != id")


def _single_source(graph: Graph, node: int) -> tuple[NodeMap, NodeMap]:
    _start(graph, node)
    best = distances(graph, graph.nodes.where(F.col("id") == node).select("id"))
    parents = _parents(graph, best).select("id", "parent").union(best.where("s = id").select("id", F.col("id").alias("parent")))
    return NodeMap(parents, value="parent"), NodeMap(best, value="d")


@algorithm("traversal.bellman_ford", graph=NUMBERS)
def bellman_ford(graph: Graph, source_node: NodeID) -> tuple[NodeMap, NodeMap]:
    """(parents, distances) of the nodes that source_node reaches; its own parent is itself. ValueError if there is a
    negative cycle."""
    return _single_source(graph, source_node)


@algorithm("traversal.dijkstra", graph={**NUMBERS, "edge_has_negative_weights": False})
def dijkstra(graph: Graph, source_node: NodeID) -> tuple[NodeMap, NodeMap]:
    """As bellman_ford, for graphs without negative weights."""
    return _single_source(graph, source_node)


@algorithm("traversal.all_pairs_shortest_paths", graph=NUMBERS)
def all_pairs_shortest_paths(graph: Graph) -> tuple[Graph, Graph]:
    """(parents, distances) as directed graphs: an edge from each node to each other one that it reaches, weighted by
    the last node before it and by the distance."""
    best = distances(graph, graph.nodes.select("id"))
    parents = _parents(graph, best).select(F.col("s").alias("src"), F.col("id").alias("dst"), F.col("parent").alias("weight"))
    return Graph(graph.nodes, parents), Graph(graph.nodes, best.where("s != id").select(F.col("s").alias("src"), F.col("id").alias("dst"), F.col("d").alias("weight")))


def levels(graph: Graph, node: int, depth_limit: int = -1) -> DataFrame:
    """(id, depth, parent) of a breadth-first search; parent is the least id of the level before. Written, by
    parts."""
    _start(graph, node)
    walk = written(graph.both_ways(), "edges")
    edge = written(graph.nodes.where(F.col("id") == node).select("id", F.lit(0).alias("depth"), F.col("id").alias("parent")), "bfs")
    seen, depth = Parts("bfs", edge), 0
    while depth != depth_limit:
        depth += 1
        step = edge.select(F.col("id").alias("src")).join(walk, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        fresh = written(step.join(seen.whole().select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "parent"), "bfs")
        if not fresh.limit(1).count():
            break
        seen.add(fresh)
        edge = seen.whole().where(F.col("depth") == depth)
    dropped(walk)
    return seen.whole()


@algorithm("traversal.bfs_iter")
def bfs_iter(graph: Graph, source_node: NodeID, depth_limit: int = -1) -> Vector:
    """Nodes by breadth-first search, by id inside a level; -1: no limit."""
    return Vector(positions(levels(graph, source_node, depth_limit), F.col("depth"), F.col("id")).select("pos", F.col("id").alias("value")))


@algorithm("traversal.bfs_tree")
def bfs_tree(graph: Graph, source_node: NodeID, depth_limit: int = -1) -> tuple[NodeMap, NodeMap]:
    """(depths, parents) of a breadth-first search."""
    seen = levels(graph, source_node, depth_limit)
    return NodeMap(seen, value="depth"), NodeMap(seen, value="parent")


def _reachable(graph: Graph, node: int, *columns: str) -> DataFrame:
    """(key, dst, columns): the edges that a walk from node can use."""
    seen = levels(graph, node).select(F.col("id").alias("src"))
    return graph.both_ways(*columns).join(seen, "src", "left_semi").withColumnRenamed("src", "key")


def _just(graph: Graph, node: int) -> DataFrame:
    return graph.nodes.where(F.col("id") == node).select("id")


def _depth_first(graph: Graph, node: int) -> DataFrame:
    def search(lists: Lists) -> Iterator[dict]:
        order, parents, met = array("q", [node]), array("q", [node]), {node}
        first, end = lists.rows(node)
        # of each node on the way down: itself, the row that it has come to, the end of its rows, the place in that row
        at, row, last, skip = array("q", [node]), array("q", [first]), array("q", [end]), array("q", [0])
        while at:
            down = None
            while down is None and row[-1] < last[-1]:
                near = lists.read(row[-1], skip[-1], BLOCK)["dst"].tolist()
                if not near:
                    row[-1], skip[-1] = row[-1] + 1, 0
                    continue
                for i, x in enumerate(near, 1):
                    if x not in met:
                        down = x
                        break
                skip[-1] += i
            if down is None:
                for column in (at, row, last, skip):
                    column.pop()
                continue
            met.add(down)
            order.append(down)
            parents.append(at[-1])
            first, end = lists.rows(down)
            for column, value in ((at, down), (row, first), (last, end), (skip, 0)):
                column.append(value)
        yield from batched(pos=range(len(order)), id=order, parent=parents)

    return with_lists(_reachable(graph, node), _just(graph, node), search, "pos long, id long, parent long")


@algorithm("traversal.dfs_iter")
def dfs_iter(graph: Graph, source_node: NodeID) -> Vector:
    """Nodes in the order in which a depth-first search meets them, neighbours by id."""
    return Vector(_depth_first(graph, source_node), value="id")


@algorithm("traversal.dfs_tree")
def dfs_tree(graph: Graph, source_node: NodeID) -> NodeMap:
    """The parent of each node in that search; that of source_node is itself."""
    return NodeMap(_depth_first(graph, source_node), value="parent")


@algorithm("traversal.minimum_spanning_tree", graph={**NUMBERS, "is_directed": False})
def minimum_spanning_tree(graph: Graph) -> Graph:
    """A spanning forest of least weight with all nodes (Boruvka): each round every component takes its lightest edge
    out, ties by ends, and the components that these join become one."""
    live = written(graph.edges.where("src != dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("weight", F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), "src", "dst").alias("e")), "edges")
    tree = None
    while live.limit(1).count():
        ends = live.select(F.explode(F.array("a", "b")).alias("c"), "a", "b", "e")
        picked = written(ends.groupBy("c").agg(F.min(F.struct("e", "a", "b")).alias("p")).select("p.*").distinct(), "picked")
        tree = picked.select("e") if tree is None else tree.unionByName(picked.select("e"))
        label = written(components(picked, "a", "b"), "labels")
        la, lb = label.select(F.col("id").alias("a"), F.col("label").alias("la")), label.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        live = written(live.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"), "e").where("a != b"), "edges")
    edges = graph.edges.where(F.lit(False)) if tree is None else tree.select("e.src", "e.dst", "e.weight").distinct()
    return graph.with_edges(edges)


@algorithm("traversal.astar_search", graph=NUMBERS)
def astar_search(graph: Graph, source_node: NodeID, target_node: NodeID, heuristic_func: Callable) -> Vector:
    """The path that A* finds, both ends included; ValueError if there is none. heuristic_func guesses a node's
    distance to the target; ties go to what was found first, neighbours by id, and closed nodes stay closed."""
    check_arity(heuristic_func, 1)
    _start(graph, source_node)
    _start(graph, target_node)

    def search(lists: Lists) -> Iterator[dict]:
        heap, number, seen, closed = [(0, 0, source_node, 0, None)], 0, {}, {}
        guess, most = {}, BLOCK
        while heap:
            _, _, at, cost, parent = heapq.heappop(heap)
            if at == target_node:
                path = [at]
                while parent is not None:
                    path.append(parent)
                    parent = closed[parent]
                yield from batched(pos=range(len(path)), id=path[::-1])
                return
            if at in closed:
                continue
            closed[at] = parent
            for near in lists.near(at):
                for x, w in near.tolist():
                    if x not in closed and cost + w < seen.get(x, float("inf")):
                        seen[x] = cost + w
                        number += 1
                        guess[x] = cost + w + heuristic_func(x)
                        heapq.heappush(heap, (guess[x], number, x, cost + w, at))
            if len(heap) > most:  # entries that come up after their node is closed by a cheaper one
                heap = [e for e in heap if e[2] not in closed and (e[3] == seen[e[2]] or not e[0] > guess[e[2]])]
                heapq.heapify(heap)
                most = 2 * len(heap) + BLOCK

    found = written(with_lists(_reachable(graph, source_node, "weight"), _just(graph, source_node), search, "pos long, id long"), "path")
    if not found.limit(1).count():
        raise ValueError(f"no path from {source_node} to {target_node}")
    return Vector(found, value="id")
