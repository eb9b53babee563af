"""Components, communities, triangles and colourings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.functions.lots import lot
from graphlane.operators.utility import collapse_by_label, degrees
from graphlane.plans.components import components
from graphlane.plans.ordering import positions
from graphlane.plans.tables import Parts, dropped, written
from graphlane.registry import algorithm
from graphlane.types import Graph, NodeMap

UNDIRECTED = {"is_directed": False}


def _dense(labels: DataFrame) -> NodeMap:
    """(id, label) with labels renumbered from 0 in their order."""
    numbers = positions(labels.select("label").distinct(), F.col("label"), pos="value")
    return NodeMap(labels.join(numbers, "label").select("id", "value"))


def weak_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the least id of each node's component."""
    found = components(edges)
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


@algorithm("clustering.connected_components", graph=UNDIRECTED)
def connected_components(graph: Graph) -> NodeMap:
    """The number of each node's component; components are numbered from 0 by their least ids."""
    return _dense(weak_labels(graph.nodes, graph.edges))


def strong_labels(graph: Graph) -> DataFrame:
    """(id, label): the least id of each node's strong component."""
    nodes, edges = written(graph.nodes.select("id"), "nodes"), written(graph.edges.where("src != dst").select("src", "dst").distinct(), "edges")
    done = None
    while nodes.limit(1).count():
        # nodes without an edge in or out are components of their own
        while True:
            both = edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
            both = written(both, "nodes")
            alone = nodes.join(both, "id", "left_anti").select("id", F.col("id").alias("label"))
            n_alone = alone.count()
            done = written(alone if done is None else done.unionByName(alone), "strong")
            nodes = both
            if not n_alone:
                break
            edges = written(edges.join(both.select(F.col("id").alias("src")), "src", "left_semi").join(both.select(F.col("id").alias("dst")), "dst", "left_semi"), "edges")
        if not nodes.limit(1).count():
            break
        # the least id that reaches each node; that id's strong component is what also reaches it inside its colour
        colour = written(nodes.select("id", F.col("id").alias("c")), "colour")
        moved = colour
        while moved.limit(1).count():
            low = moved.select(F.col("id").alias("src"), F.col("c").alias("new")).join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.min("new").alias("new"))
            merged = written(colour.join(low, "id", "left").select("id", F.least("c", "new").alias("c"), (F.col("new") < F.col("c")).alias("m")), "colour")
            colour, moved = merged.select("id", "c"), merged.where("m").select("id", "c")
        cs, cd = colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), colour.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
        inside = written(edges.join(cs, "src").join(cd, "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c")), "edges")
        seen = written(colour.where("id = c"), "back")
        front = seen
        while front.limit(1).count():
            front = written(front.select(F.col("id").alias("dst")).join(inside, "dst").select(F.col("src").alias("id"), "c").distinct().join(seen.select("id"), "id", "left_anti"), "back")
            seen = written(seen.unionByName(front), "back")
        done = written(done.unionByName(seen.select("id", F.col("c").alias("label"))), "strong")
        nodes = written(nodes.join(seen.select("id"), "id", "left_anti"), "nodes")
        edges = written(inside.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"), "edges")
    return graph.nodes.select("id", F.col("id").alias("label")) if done is None else done


@algorithm("clustering.strongly_connected_components", graph={"is_directed": True})
def strongly_connected_components(graph: Graph) -> NodeMap:
    """The number of each node's strong component, from 0."""
    return _dense(strong_labels(graph))


def oriented(graph: Graph) -> DataFrame:
    """(a, b, edge ends by degree, then id): each distinct edge from its end of lower degree. A node then has at most
    about the square root of twice the number of edges on its out side, which bounds triangle joins at hubs."""
    simple = written(graph.simple(), "edges")
    deg = simple.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    da, db = deg.select(F.col("id").alias("a"), F.col("d").alias("da")), deg.select(F.col("id").alias("b"), F.col("d").alias("db"))
    up = F.struct("da", "a") < F.struct("db", "b")
    return written(simple.join(da, "a").join(db, "b").select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("hi")), "oriented")


def triangles(graph: Graph) -> DataFrame:
    """(x, y, z): each triangle once."""
    e = oriented(graph)
    wedge = e.select(F.col("lo").alias("x"), F.col("hi").alias("y")).join(e.select(F.col("lo").alias("x"), F.col("hi").alias("z")), "x").where("y != z")
    return wedge.join(e.select(F.col("lo").alias("y"), F.col("hi").alias("z")), ["y", "z"]).select("x", "y", "z")


@algorithm("clustering.triangle_count", graph=UNDIRECTED)
def triangle_count(graph: Graph) -> int:
    """The number of triangles; weights and loops don't matter."""
    return triangles(graph).count()


@algorithm("clustering.global_clustering_coefficient", graph=UNDIRECTED)
def global_clustering_coefficient(graph: Graph) -> float:
    """3 triangles / paths of two edges; 0 without such paths."""
    ends = graph.simple().select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    paths = ends.agg(F.sum(F.col("d") * (F.col("d") - 1) / 2)).first()[0]
    return 3.0 * triangles(graph).count() / paths if paths else 0.0


def coloured(graph: Graph) -> DataFrame:
    """(id, colour): sequential greedy colouring by falling degree, then by lot, run in parallel (Jones-Plassmann): a
    node is coloured once all its neighbours that come before are. Lots keep chains of such neighbours short."""
    deg = degrees(graph).select("id", F.struct(-F.col("value").alias("d"), lot(0, "id").alias("lot"), "id").alias("r"))
    simple = graph.simple()
    da, db = deg.select(F.col("id").alias("a"), F.col("r").alias("ra")), deg.select(F.col("id").alias("b"), F.col("r").alias("rb"))
    first = F.col("ra") < F.col("rb")
    open_ = written(simple.join(da, "a").join(db, "b").select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("id"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("on"), F.lit(None).cast("long").alias("colour")), "priority")
    fresh = written(graph.nodes.select("id").join(open_.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).cast("long").alias("colour")), "colour")
    done = Parts("colour")
    while open_.limit(1).count():
        # a node's open edges learn the colours that were given last
        told = written(open_.join(fresh.select(F.col("id").alias("on"), F.col("colour").alias("new")), "on", "left").select("id", "on", F.coalesce("colour", "new").alias("colour")), "priority")
        near = told.groupBy("id").agg(F.bool_or(F.col("colour").isNull()).alias("wait"), F.array_sort(F.collect_set("colour")).alias("used"))
        # the least number that is not used: one of 0 .. number of used ones
        free = F.array_min(F.array_except(F.sequence(F.lit(0).cast("long"), F.size("used").cast("long")), F.col("used")))
        given = written(near.where("not wait").select("id", free.alias("colour")), "colour")
        done.add(fresh)
        last, open_ = open_, written(told.join(given.select("id"), "id", "left_anti"), "priority")
        dropped(last, told)
        fresh = given
    done.add(fresh)
    return done.whole()


@algorithm("clustering.coloring.greedy", graph=UNDIRECTED)
def greedy_coloring(graph: Graph) -> tuple[NodeMap, int]:
    """(colours, number of colours): neighbours differ; nodes of high degree come first."""
    done = coloured(graph)
    return NodeMap(done, value="colour"), done.select("colour").distinct().count()


@algorithm("clustering.label_propagation_community", graph=UNDIRECTED)
def label_propagation_community(graph: Graph, maxiter: int = 100) -> NodeMap:
    """Communities by label propagation, numbered from 0. Nodes of one colour move at once, so no two neighbours do; a
    node keeps its label if it is among the most frequent ones around it, else takes the least of these."""
    colour = coloured(graph)
    walk = written(Graph(graph.nodes, graph.simple().select(F.col("a").alias("src"), F.col("b").alias("dst")), False).both_ways(), "edges")
    colours = [r[0] for r in colour.select("colour").distinct().orderBy("colour").collect()]
    last = state = written(colour.select("id", "colour", F.col("id").alias("label")), "labels")
    for _ in range(maxiter):
        changed = 0
        for c in colours:
            votes = walk.join(state.where(F.col("colour") == c).select(F.col("id").alias("src"), F.col("label").alias("own")), "src").join(state.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "own", "label").agg(F.count("*").alias("n"))
            best = votes.groupBy("src").agg(F.min(F.struct(-F.col("n"), F.col("label") != F.col("own"), F.col("label"))).alias("b"))
            new = written(state.join(best.select(F.col("src").alias("id"), F.col("b.label").alias("to")), "id", "left").select("id", "colour", F.coalesce("to", "label").alias("label"), F.coalesce(F.col("to") != F.col("label"), F.lit(False)).alias("moved")), "labels")
            changed += new.where("moved").count()
            dropped(last)
            last, state = new, new.drop("moved")
        if not changed:
            break
    return _dense(state.select("id", "label"))


def modularity(graph: Graph, labels: DataFrame) -> float:
    """Of a partition (id, label) of a weighted undirected graph."""
    la, lb = labels.select(F.col("id").alias("src"), F.col("label").alias("ls")), labels.select(F.col("id").alias("dst"), F.col("label").alias("ld"))
    both = written(graph.edges.join(la, "src").join(lb, "dst").select("ls", "ld", "weight"), "modularity")
    m = both.agg(F.sum("weight")).first()[0]
    if not m:
        return 0.0
    inside = both.where("ls = ld").agg(F.sum("weight")).first()[0] or 0.0
    ends = both.select(F.explode(F.array("ls", "ld")).alias("label"), "weight").groupBy("label").agg(F.sum("weight").alias("k"))
    return inside / m - ends.agg(F.sum((F.col("k") / (2.0 * m)) ** 2)).first()[0]


def _louvain_level(graph: Graph, maxiter: int) -> DataFrame:
    """(id, label) after local moves on one level."""
    m = float(graph.edges.agg(F.sum("weight")).first()[0])
    strength = graph.edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").cast("double").alias("k"))
    colour = coloured(graph)
    last = state = written(colour.join(strength, "id", "left").select("id", "colour", F.coalesce("k", F.lit(0.0)).alias("k"), F.col("id").alias("label")), "louvain")
    walk = written(graph.both_ways("weight").where("src != dst").groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("w")), "edges")
    colours = [r[0] for r in colour.select("colour").distinct().orderBy("colour").collect()]
    for _ in range(maxiter):
        changed = 0
        for c in colours:
            total = state.groupBy("label").agg(F.sum("k").alias("tot"))
            own = state.where(F.col("colour") == c).select(F.col("id").alias("src"), "k", F.col("label").alias("own"))
            near = walk.join(own, "src").join(state.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "k", "own", "label").agg(F.sum("w").alias("w"))
            stay = own.select("src", "k", "own", F.col("own").alias("label"), F.lit(0.0).alias("w"))
            options = near.unionByName(stay).groupBy("src", "k", "own", "label").agg(F.sum("w").alias("w")).join(total, "label")
            rest = F.col("tot") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("w") / m - rest * F.col("k") / (2 * m * m), 12)
            best = options.groupBy("src").agg(F.min(F.struct(-gain, F.col("label") != F.col("own"), F.col("label"))).alias("b"))
            new = written(state.join(best.select(F.col("src").alias("id"), F.col("b.label").alias("to")), "id", "left").select("id", "colour", "k", F.coalesce("to", "label").alias("label"), F.coalesce(F.col("to") != F.col("label"), F.lit(False)).alias("moved")), "louvain")
            changed += new.where("moved").count()
            dropped(last)
            last, state = new, new.drop("moved")
        if not changed:
            break
    return state.select("id", "label")


@algorithm("clustering.louvain_community", graph={**UNDIRECTED, "edge_type": "map", "edge_dtype": ("int", "float")})
def louvain_community(graph: Graph, maxiter: int = 20) -> tuple[NodeMap, float]:
    """(communities from 0, modularity) by local moves and collapsing until modularity no longer rises. Nodes of one
    colour move at once."""
    import operator

    labels = graph.nodes.select("id", F.col("id").alias("label"))
    if not graph.edges.limit(1).count():
        return _dense(labels), 0.0
    level, best = graph, modularity(graph, labels)
    while True:
        moved = _louvain_level(level, maxiter)
        composed = written(labels.join(moved.select(F.col("id").alias("label"), F.col("label").alias("to")), "label").select("id", F.col("to").alias("label")), "louvain")
        q = modularity(graph, composed)
        if q - best < 1e-7:
            return _dense(labels), best
        labels, best = composed, q
        level = collapse_by_label.func(level, NodeMap(moved, value="label"), operator.add)
        level = Graph(written(level.nodes, "nodes"), written(level.edges, "edges"), False)

