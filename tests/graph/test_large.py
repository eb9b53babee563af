"""Searches, walks and joins beyond what one task can hold."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphlane import BipartiteGraph, EdgeSet, Graph, algos, queries
from graphlane.functions.lots import drawn
from graphlane.plans import matching
from graphlane.plans.tables import written
from tests.graph.util import edges, graph, ids

N = 2300


def walked(near, nodes, steps, start, seed, jump=0.15):
    """Nodes and edges of the walk, from lists of (neighbour, edge)."""
    at = nodes[int(drawn(seed, 0, 1) * len(nodes))] if start is None else start
    met, used = {at}, set()
    for step in range(1, steps + 1):
        way = drawn(seed, step, 1)
        if drawn(seed, step, 0) < jump or not near[at]:
            at = nodes[int(way * len(nodes))] if start is None else start
        else:
            at, edge = near[at][int(way * len(near[at]))]
            used.add(edge)
        met.add(at)
    return met, used


@pytest.fixture(scope="module")
def dense(spark):
    """5.3 million edges: all between 2,300 nodes, weighted by the square of the distance."""
    ends = spark.range(N * N).select((F.col("id") % N).alias("src"), F.expr(f"id div {N}").alias("dst")).where("src != dst")
    return Graph(spark.range(N), written(ends.withColumn("weight", (F.col("src") - F.col("dst")) * (F.col("src") - F.col("dst"))), "dense"), True, False)


def test_random_walk_on_five_million_edges(dense):
    near = [[(b, (a, b)) for b in range(N) if b != a] for a in range(N)]
    met, used = walked(near, range(N), 60, 0, 1)
    got = algos.subgraph.sample.random_walk(dense, num_steps=60, start_node=0, seed=1)
    assert ids(got) == met and {e[:2] for e in edges(got)} == used


@pytest.mark.parametrize("start", [None, 3])
def test_random_walk_takes_the_edges_of_a_node_in_their_order(spark, start):
    pairs = [(3, 1), (1, 2), (5, 1), (2, 2), (2, 5), (5, 4), (4, 3)]
    near = {n: [] for n in range(8)}
    for a, b in sorted(pairs):
        near[a].append((b, (a, b)))
        if a != b:
            near[b].append((a, (a, b)))
    met, used = walked(near, range(8), 40, start, 7)
    got = algos.subgraph.sample.random_walk(graph(spark, pairs, directed=False, nodes=[0, 6, 7]), num_steps=40, start_node=start, seed=7)
    assert ids(got) == met and edges(got) == used


def test_searches_on_five_million_edges(dense):
    tree = algos.traversal.dfs_tree(dense, 1).df.toPandas()
    assert dict(zip(tree.id, tree.value, strict=True)) == {1: 1, 0: 1, 2: 0} | {i: i - 1 for i in range(3, N)}
    assert algos.traversal.dfs_iter(dense, 1).to_list() == [1, 0, *range(2, N)]
    assert algos.traversal.astar_search(dense, 5, N - 1, lambda n: 0).to_list() == list(range(5, N))


def test_astar_closes_nodes_at_their_first_visit(spark):
    """A guess that misleads: node 2 is closed by the dearer way before the cheaper one is found."""
    g = graph(spark, [(0, 1, 1), (0, 2, 9), (1, 2, 1), (2, 3, 1), (3, 4, 1)])
    assert algos.traversal.astar_search(g, 0, 4, lambda n: 100 if n == 1 else 0).to_list() == [0, 2, 3, 4]
    with pytest.raises(ValueError):
        algos.traversal.astar_search(g, 4, 0, lambda n: 0)
    assert algos.traversal.dfs_iter(g, 4).to_list() == [4]


@pytest.mark.parametrize("back", [0, 1])
def test_circle_among_more_than_a_million_edges(spark, back):
    """Edges to the next twelve ids make no circle, with one back that is walked both ways neither; with a longer one they do."""
    steps = spark.range(100_000).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 12)).alias("dst"))
    more = spark.createDataFrame([(70_001, 70_000), (90_020, 90_000)][: 1 + back], "src long, dst long")
    g = Graph(spark.range(100_012), written(steps.unionByName(more), "steps"))
    assert algos.subgraph.subisomorphic(g, graph(spark, [(0, 1), (1, 2), (2, 0)])) == bool(back)


PATTERNS = [([(0, 1), (1, 2)], []), ([(0, 1), (1, 0), (1, 2)], []), ([(0, 1), (1, 2), (2, 0), (0, 0)], []), ([(0, 1), (2, 3)], []), ([(0, 1), (1, 2), (2, 3), (3, 0)], []), ([(0, 0)], [1, 2])]


@pytest.mark.parametrize("directed", [True, False])
@pytest.mark.parametrize("pattern, alone", PATTERNS)
def test_small_matches_are_those_of_backtracking(spark, monkeypatch, directed, pattern, alone):
    monkeypatch.setattr(matching, "SLICE", 8)
    rng = random.Random(len(pattern) + 10 * directed)
    pattern = pattern if directed else sorted({tuple(sorted(e)) for e in pattern})
    for share in (0.25, 0.6):
        large = [(a, b) for a in range(6) for b in range(6) if (directed or a <= b) and rng.random() < share]
        want = matching.find_match(*(matching._adjacency(pd.DataFrame([(n, None) for n in nodes] + list(e), columns=["src", "dst"]), directed) for nodes, e in (({*alone, *sum(pattern, ())}, pattern), (range(6), large))), False)
        got = matching.occurs(graph(spark, pattern, directed, alone), graph(spark, large, directed, range(6)))
        assert got == want


def test_pairs_of_parts_are_counted_in_more_tasks_as_lines_grow(spark, monkeypatch):
    monkeypatch.setattr(queries, "LINES", 500, raising=False)
    made = queries.Tables(spark, "/root/testdata/sf0.001").together().edges
    counts = [r[0] for r in made.groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(counts) > 6 and max(counts) < sum(counts) / 3


def shuffled(df):
    """Rows that a query has written to shuffles."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                found += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_projection_shuffles_fewer_rows_than_it_gives(spark):
    ends = spark.range(60 * 600).select((-1 - F.col("id") % 60).alias("source"), F.expr("id div 60").alias("target"))
    made = algos.bipartite.graph_projection(BipartiteGraph(EdgeSet(ends, is_directed=False, check=False), check=False), 1).edges
    assert len(made.collect()) == 600 * 599 // 2 and shuffled(made) < 60_000


@pytest.mark.parametrize("side", [0, 1])
def test_projection_of_ids_around_blocks_of_64(spark, side):
    rng = random.Random(side)
    keys = [-(2**63), -129, -128, -65, -64, -63, -1, 0, 1, 62, 63, 64, 65, 127, 128, 2**63 - 1]
    pairs = {(rng.choice(keys), 10**6 + rng.randrange(8)) for _ in range(40)}
    want = {(a, b) for a, via in pairs for b, other in pairs if via == other and a < b}
    pairs = [p if side == 0 else p[::-1] for p in pairs]
    got = algos.bipartite.graph_projection(BipartiteGraph(EdgeSet(spark.createDataFrame(pairs, "source long, target long"), is_directed=False, check=False), check=False), side)
    assert edges(got) == want and got.edges.count() == len(want)
