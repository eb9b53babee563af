"""Queries that apply each operator of the catalogue to graphs derived from whole tables.

Graphs: trade (nation to nation, by the lines that customers of the one order from suppliers of the other, where these
are more than its mean), parts ordered together twice or more, customers and suppliers with a common order, and
transitions of users in the event stream. The SQL of the same results is in graphlane.oracle.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlane.convert import canonicalize, reindex, symmetrize
from graphlane.operators.clustering import modularity
from graphlane.plans.tables import shared_dir, written
from graphlane.registry import run
from graphlane.sources import coo_to_csr, read_graph, write_graph
from graphlane.streaming import degree_stream, windowed_edges
from graphlane.types import BipartiteGraph, EdgeMap, EdgeSet, Graph, Matrix, NodeMap, NodeSet, Vector

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Lines whose pairs a task holds. Spark's own number of partitions would let a task's share grow with the table.
LINES = 1 << 19


def query(func: Query) -> Query:
    QUERIES[func.__name__] = func
    return func


class Tables:
    """The tables of a folder, and the graphs derived from them; each graph's edges are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def parts_of_lines(self) -> int:
        return max(self.spark.sparkContext.defaultParallelism, -(-self.lineitem.count() // LINES))

    def nations(self) -> NodeSet:
        return NodeSet(self.nation, "n_nationkey", unique=True)

    def trade(self) -> Graph:
        lines = self.lineitem.select("l_orderkey", "l_suppkey").join(self.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        lines = lines.join(self.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(self.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        counts = lines.where("c_nationkey != s_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("weight"))
        own = Window.partitionBy("src")
        strong = counts.withColumn("n", F.count("*").over(own)).withColumn("total", F.sum("weight").over(own)).where(F.col("weight") * F.col("n") > F.col("total"))
        return Graph(self.nations().df, written(strong.select("src", "dst", "weight"), "trade"), True, False)

    def trade_both_ways(self) -> Graph:
        g = self.trade()
        edges = g.edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))
        return Graph(g.nodes, edges, False, False)

    def together(self) -> Graph:
        n = self.parts_of_lines()
        lines = self.lineitem.select("l_orderkey", "l_partkey").repartition(n, "l_orderkey").distinct()
        pairs = lines.select("l_orderkey", F.col("l_partkey").alias("src")).join(lines.select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey").where("src < dst")
        edges = pairs.repartition(n, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("weight")).where("weight >= 2")
        return Graph(self.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("value")), written(edges, "together"), False, False)

    def customers_and_suppliers(self) -> BipartiteGraph:
        pairs = self.lineitem.join(self.orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst")).distinct()
        return BipartiteGraph(EdgeSet(pairs, "src", "dst", is_directed=False, check=False), NodeSet(self.customer, "c_custkey", unique=True), NodeSet(self.supplier.select((-1 - F.col("s_suppkey")).alias("id")), unique=True), check=False)

    def transitions(self) -> Graph:
        """From the user of an event to that of the next one of its type in the same hour."""
        after = F.lead("user_id").over(Window.partitionBy("event_type", F.date_trunc("hour", "ts")).orderBy("ts", "event_id"))
        steps = self.events.select(F.col("user_id").alias("src"), after.alias("dst")).where("dst is not null and src != dst")
        edges = EdgeMap(written(steps.groupBy("src", "dst").agg(F.count("*").alias("weight")), "transitions"), "src", "dst", check=False)
        return Graph.from_edges(edges)

    def start(self) -> int:
        return self.events.agg(F.min("user_id")).first()[0]

    def prices(self) -> NodeMap:
        return NodeMap(self.orders.select("o_orderkey", F.floor("o_totalprice").alias("price")), "o_orderkey", "price")

    def balances(self) -> NodeMap:
        return NodeMap(self.customer, "c_custkey", "c_acctbal")


def on_tables(func: Callable[[Tables], DataFrame]) -> Query:
    def apply(spark: SparkSession, sf_dir: str) -> DataFrame:
        return func(Tables(spark, sf_dir))

    apply.__name__, apply.__doc__ = func.__name__, func.__doc__
    return query(apply)


def one_row(t: Tables, value, name: str, kind: str) -> DataFrame:
    return t.spark.createDataFrame([(value,)], f"{name} {kind}")


def rounded(m: NodeMap, name: str) -> DataFrame:
    return m.df.select("id", F.round("value", 6).alias(name))


# utility


@on_tables
def util_nodeset_choose_random(t):
    return run("util.nodeset.choose_random", NodeSet(t.customer, "c_custkey", unique=True), 100, seed=1).df


@on_tables
def util_nodeset_from_vector(t):
    return run("util.nodeset.from_vector", Vector(t.customer, "c_custkey", "c_nationkey")).df


@on_tables
def util_nodemap_sort(t):
    return run("util.nodemap.sort", t.balances()).df.select("pos", F.col("value").alias("id"))


@on_tables
def util_nodemap_sort_top(t):
    return run("util.nodemap.sort", t.balances(), ascending=False, limit=10).df.select("pos", F.col("value").alias("id"))


@on_tables
def util_nodemap_select(t):
    return run("util.nodemap.select", t.balances(), NodeSet(t.orders, "o_custkey")).df


@on_tables
def util_nodemap_filter(t):
    return run("util.nodemap.filter", t.balances(), lambda x: x > 5000).df


@on_tables
def util_nodemap_apply(t):
    return run("util.nodemap.apply", t.prices(), lambda x: x * 2 + 1).df


@on_tables
def util_nodemap_reduce(t):
    return one_row(t, run("util.nodemap.reduce", t.prices(), operator.add), "total", "long")


@on_tables
def util_edgemap_from_edgeset(t):
    return run("util.edgemap.from_edgeset", t.transitions().edge_set(), 7).df


@on_tables
def util_graph_degree(t):
    g = t.transitions()
    parts = [run("util.graph.degree", g, i, o).df.select("id", F.col("value").alias(name)) for i, o, name in ((False, True, "out_degree"), (True, False, "in_degree"), (True, True, "degree"))]
    return parts[0].join(parts[1], "id").join(parts[2], "id")


@on_tables
def util_graph_aggregate_edges(t):
    return run("util.graph.aggregate_edges", t.transitions(), operator.add, 0, in_edges=True, out_edges=False).df


@on_tables
def util_graph_filter_edges(t):
    return run("util.graph.filter_edges", t.transitions(), lambda w: w > 1).edges


@on_tables
def util_graph_assign_uniform_weight(t):
    return run("util.graph.assign_uniform_weight", t.transitions(), 3).edges


@on_tables
def util_graph_build(t):
    g = t.together()
    return run("util.graph.build", g.edge_map(), NodeMap(g.nodes)).nodes


@on_tables
def util_graph_collapse_by_label(t):
    g = t.together()
    return run("util.graph.collapse_by_label", g, NodeMap(g.nodes), operator.add).edges


@on_tables
def util_graph_isomorphic(t):
    g = t.trade()
    moved = Graph(g.nodes.select((24 - F.col("id")).alias("id")), g.edges.select((24 - F.col("src")).alias("src"), (24 - F.col("dst")).alias("dst")), True)
    return one_row(t, run("util.graph.isomorphic", g, moved), "found", "boolean")


# centrality


@on_tables
def centrality_pagerank(t):
    return rounded(run("centrality.pagerank", t.transitions(), maxiter=200, tolerance=1e-12), "pagerank")


@on_tables
def centrality_katz(t):
    return rounded(run("centrality.katz", t.transitions(), attenuation_factor=0.001, maxiter=200, tolerance=1e-12), "katz")


@on_tables
def centrality_eigenvector(t):
    return rounded(run("centrality.eigenvector", t.transitions(), maxiter=500, tolerance=1e-12), "eigenvector")


@on_tables
def centrality_hits(t):
    hubs, authorities = run("centrality.hits", t.transitions(), maxiter=500, tolerance=1e-10)
    return rounded(hubs, "hub").join(rounded(authorities, "authority"), "id")


@on_tables
def centrality_degree(t):
    return rounded(run("centrality.degree", t.transitions(), True, True), "centrality")


@on_tables
def centrality_closeness(t):
    return rounded(run("centrality.closeness", t.trade()), "closeness")


@on_tables
def centrality_betweenness(t):
    return rounded(run("centrality.betweenness", t.trade()), "betweenness")


# clustering


@on_tables
def clustering_connected_components(t):
    return run("clustering.connected_components", t.together()).df.select("id", F.col("value").alias("component"))


@on_tables
def clustering_strongly_connected_components(t):
    return run("clustering.strongly_connected_components", t.transitions()).df.select("id", F.col("value").alias("component"))


@on_tables
def clustering_triangle_count(t):
    return one_row(t, run("clustering.triangle_count", t.together()), "triangles", "long")


@on_tables
def clustering_global_clustering_coefficient(t):
    return one_row(t, round(run("clustering.global_clustering_coefficient", t.together()), 9), "coefficient", "double")


@on_tables
def clustering_coloring_greedy(t):
    return run("clustering.coloring.greedy", t.together())[0].df.select("id", F.col("value").alias("colour"))


@on_tables
def clustering_label_propagation_community(t):
    return run("clustering.label_propagation_community", t.trade_both_ways()).df.select("id", F.col("value").alias("community"))


@on_tables
def clustering_louvain_community(t):
    found, q = run("clustering.louvain_community", t.trade_both_ways())
    return found.df.select("id", F.col("value").alias("community"), F.lit(round(q, 9)).alias("modularity"))


@on_tables
def clustering_coloring_conflicts(t):
    """Edges between nodes of one colour, and nodes without a colour: none."""
    g = t.together()
    colour = written(run("clustering.coloring.greedy", g)[0].df, "colours")
    near = colour.select(F.col("id").alias("src"), F.col("value").alias("a")), colour.select(F.col("id").alias("dst"), F.col("value").alias("b"))
    conflicts = g.edges.where("src != dst").join(near[0], "src").join(near[1], "dst").where("a = b").count()
    return one_row(t, conflicts, "conflicts", "long").withColumn("uncoloured", F.lit(g.nodes.join(colour, "id", "left_anti").count()).cast("long"))


@on_tables
def clustering_label_propagation_stability(t):
    """Nodes, and those whose community is not among the most frequent ones around them: none."""
    g = t.trade_both_ways()
    label = written(run("clustering.label_propagation_community", g).df, "communities")
    around = g.both_ways().select("src", "dst").where("src != dst").distinct().join(label.select(F.col("id").alias("dst"), "value"), "dst").groupBy("src", "value").agg(F.count("*").alias("n"))
    best = around.groupBy("src").agg(F.max("n").alias("most"))
    own = around.join(label.select(F.col("id").alias("src"), "value"), ["src", "value"], "right").join(best, "src", "left")
    unstable = own.where(F.coalesce("n", F.lit(0)) < F.coalesce("most", F.lit(0))).count()
    return one_row(t, label.count(), "nodes", "long").withColumn("unstable", F.lit(unstable).cast("long"))


@on_tables
def clustering_louvain_consistency(t):
    """Nodes, the difference of the modularity that is returned from that of the communities, and whether it is at least
    that of the regions."""
    g = t.trade_both_ways()
    found, q = run("clustering.louvain_community", g)
    regions = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("label"))
    labels = written(found.df.select("id", F.col("value").alias("label")), "communities")
    better = bool(q >= modularity(g, regions))
    return one_row(t, labels.count(), "nodes", "long").withColumns({"difference": F.lit(abs(round(q - modularity(g, labels), 9))), "better": F.lit(better)})


@on_tables
def clustering_modularity(t):
    """Of the regions as communities of the trade graph."""
    regions = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("label"))
    return one_row(t, round(modularity(t.trade_both_ways(), regions), 9), "modularity", "double")


# traversal


@on_tables
def traversal_bfs_iter(t):
    return run("traversal.bfs_iter", t.transitions(), t.start()).df.select("pos", F.col("value").alias("id"))


@on_tables
def traversal_bfs_tree(t):
    depth, parent = run("traversal.bfs_tree", t.transitions(), t.start())
    return depth.df.select("id", F.col("value").alias("depth")).join(parent.df.select("id", F.col("value").alias("parent")), "id")


@on_tables
def traversal_dfs_iter(t):
    return run("traversal.dfs_iter", t.transitions(), t.start()).df.select("pos", F.col("value").alias("id"))


@on_tables
def traversal_dfs_tree(t):
    return run("traversal.dfs_tree", t.transitions(), t.start()).df.select("id", F.col("value").alias("parent"))


def _paths(found: tuple[NodeMap, NodeMap]) -> DataFrame:
    parents, dist = found
    return dist.df.select("id", F.col("value").alias("distance")).join(parents.df.select("id", F.col("value").alias("parent")), "id")


@on_tables
def traversal_bellman_ford(t):
    return _paths(run("traversal.bellman_ford", t.transitions(), t.start()))


@on_tables
def traversal_dijkstra(t):
    return _paths(run("traversal.dijkstra", t.transitions(), t.start()))


@on_tables
def traversal_all_pairs_shortest_paths(t):
    parents, dist = run("traversal.all_pairs_shortest_paths", t.trade())
    return dist.edges.select("src", "dst", F.col("weight").alias("distance")).join(parents.edges.select("src", "dst", F.col("weight").alias("parent")), ["src", "dst"])


@on_tables
def traversal_minimum_spanning_tree(t):
    return run("traversal.minimum_spanning_tree", t.trade_both_ways()).edges


@on_tables
def traversal_astar_search(t):
    """From a user to the one that is farthest away."""
    start, g = t.start(), t.transitions()
    far = run("traversal.dijkstra", g, start)[1].df.orderBy(F.desc("value"), "id").first()
    return run("traversal.astar_search", g, start, far["id"], lambda n: 0).df.select("pos", F.col("value").alias("id"))


@on_tables
def traversal_astar_length(t):
    """The length of the path that A* finds to the user farthest away."""
    start, g = t.start(), t.transitions()
    far = run("traversal.dijkstra", g, start)[1].df.orderBy(F.desc("value"), "id").first()
    path = run("traversal.astar_search", g, start, far["id"], lambda n: 0).df
    steps = path.select("pos", F.col("value").alias("src")).join(path.select((F.col("pos") - 1).alias("pos"), F.col("value").alias("dst")), "pos")
    return steps.join(g.edges, ["src", "dst"]).agg(F.sum("weight").alias("length"))


# flow


def _ends(g: Graph) -> tuple[int, int]:
    """The nation of least id, and the one that most lines go to besides."""
    return 0, g.edges.where("dst != 0").groupBy("dst").agg(F.sum("weight").alias("n")).orderBy(F.desc("n"), "dst").first()["dst"]


@on_tables
def flow_max_flow(t):
    g = t.trade()
    return run("flow.max_flow", g, *_ends(g))[1].edges


@on_tables
def flow_min_cut(t):
    g = t.trade()
    return run("flow.min_cut", g, *_ends(g))[1].edges


@on_tables
def flow_values(t):
    """Of the largest flow and the least cut: their difference is 0."""
    g = t.trade()
    ends = _ends(g)
    return one_row(t, run("flow.max_flow", g, *ends)[0] - run("flow.min_cut", g, *ends)[0], "difference", "double")


@on_tables
def flow_balance(t):
    """Edges of the largest flow beyond their capacity, and inner nodes that take in more or less than they give: none."""
    g = t.trade()
    ends = _ends(g)
    flow = written(run("flow.max_flow", g, *ends)[1].edges, "flow")
    over = flow.withColumnRenamed("weight", "f").join(g.edges, ["src", "dst"], "left").where("weight is null or f > weight or f < 0").count()
    net = flow.select(F.col("src").alias("id"), (-F.col("weight")).alias("w")).unionByName(flow.select(F.col("dst").alias("id"), F.col("weight").alias("w")))
    odd = net.where(~F.col("id").isin(*ends)).groupBy("id").agg(F.sum("w").alias("w")).where("abs(w) > 1e-9").count()
    return one_row(t, over, "over_capacity", "long").withColumn("unbalanced", F.lit(odd).cast("long"))


@on_tables
def flow_cut(t):
    """Paths from source to target that avoid the edges of the least cut: none; and its capacity beyond the flow: 0."""
    g = t.trade()
    ends = _ends(g)
    value, cut = run("flow.min_cut", g, *ends)
    left = Graph(g.nodes, written(g.edges.join(cut.edges.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "weight"), "uncut"), True)
    reached = run("traversal.bfs_tree", left, ends[0])[0].df.where(F.col("id") == ends[1]).count()
    return one_row(t, reached, "target_reached", "long").withColumn("excess", F.lit(float(cut.edges.agg(F.sum("weight")).first()[0] or 0) - float(value)))


# subgraphs and samples


@on_tables
def subgraph_extract_subgraph(t):
    return run("subgraph.extract_subgraph", t.together(), NodeSet(t.part.where("p_size <= 25"), "p_partkey", unique=True)).edges


@on_tables
def subgraph_k_core(t):
    return run("subgraph.k_core", t.together(), 3).edges


@on_tables
def subgraph_k_truss(t):
    return run("subgraph.k_truss", t.together(), 3).edges


@on_tables
def subgraph_maximal_independent_set(t):
    return run("subgraph.maximal_independent_set", t.together()).df


@on_tables
def subgraph_independence(t):
    """Edges inside the independent set, and nodes that could join it: none."""
    g = t.together()
    chosen = run("subgraph.maximal_independent_set", g).df
    inside = run("subgraph.extract_subgraph", g, NodeSet(chosen, unique=True)).edges.where("src != dst").agg(F.count("*").alias("edges_inside"))
    beside = g.both_ways().join(chosen.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    loops = g.edges.where("src = dst").select(F.col("src").alias("id"))
    open_ = g.nodes.select("id").join(chosen, "id", "left_anti").join(beside, "id", "left_anti").join(loops, "id", "left_anti").agg(F.count("*").alias("nodes_open"))
    return one_row(t, inside.first()[0], "edges_inside", "long").withColumn("nodes_open", F.lit(open_.first()[0]).cast("long"))


@on_tables
def subgraph_subisomorphic(t):
    """Whether a circle of three one-way steps occurs among the transitions."""
    circle = Graph.from_edges(EdgeSet(t.spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long"), "src", "dst"))
    return one_row(t, run("subgraph.subisomorphic", t.transitions(), circle), "found", "boolean")


@on_tables
def subgraph_sample_node_sampling(t):
    return run("subgraph.sample.node_sampling", t.together(), 0.4, seed=1).nodes.select("id")


@on_tables
def subgraph_sample_edge_sampling(t):
    return run("subgraph.sample.edge_sampling", t.together(), 0.2, seed=1).edges


@on_tables
def subgraph_sample_ties(t):
    return run("subgraph.sample.ties", t.together(), 0.1, seed=1).edges


@on_tables
def subgraph_sample_random_walk(t):
    return run("subgraph.sample.random_walk", t.transitions(), num_steps=500, start_node=t.start(), seed=1).edges


# bipartite


@on_tables
def bipartite_graph_projection(t):
    return run("bipartite.graph_projection", t.customers_and_suppliers(), 1).edges


# embeddings


@on_tables
def embedding_apply_nodes(t):
    matrix = Matrix(t.embeddings, "vec_id", "embedding")
    to_row = NodeMap(t.embeddings.select((F.col("vec_id") + 1000).alias("id"), F.col("vec_id").alias("row")), "id", "row")
    asked = Vector(t.embeddings.select(F.col("vec_id").alias("pos"), (F.col("vec_id") + 1000).alias("value")))
    rows = run("embedding.apply.nodes", matrix, to_row, asked).df
    return rows.select("row", F.posexplode("values").alias("k", "x")).select("row", F.col("k").cast("long").alias("k"), F.round("x", 6).alias("x"))


def _vectors(found: tuple[Matrix, NodeMap]) -> DataFrame:
    matrix, to_row = found
    return to_row.df.select("id", F.col("value").alias("row")).join(matrix.df, "row").select("id", "values")


@on_tables
def embedding_train_node2vec(t):
    return _vectors(run("embedding.train.node2vec", t.transitions(), walks_per_node=2, walk_length=5))


def _region_vectors(t: Tables) -> DataFrame:
    g, regions = t.trade(), [r[0] for r in t.region.select("r_regionkey").orderBy("r_regionkey").collect()]
    own = [g.edges.join(t.nation.where(F.col("n_regionkey") == r).select(F.col("n_nationkey").cast("long").alias("src")), "src", "left_semi") for r in regions]
    return run("embedding.train.graph2vec", [Graph.from_edges(EdgeSet(e, "src", "dst")) for e in own]).df


@on_tables
def embedding_train_graph2vec(t):
    """A vector for the trade inside and out of each region."""
    return _region_vectors(t)


@on_tables
def embedding_train_graphwave(t):
    scales = Vector(t.spark.createDataFrame([(0, 5.0), (1, 10.0)], "pos long, value double"))
    return _vectors(run("embedding.train.graphwave", t.trade_both_ways(), scales, sample_point_count=5, chebyshev_degree=5))


@on_tables
def embedding_train_hope_katz(t):
    return _vectors(run("embedding.train.hope.katz", t.trade(), embedding_size=4, beta=0.001))


def _sage(t: Tables):
    """The trade graph with degrees as features, and a model trained on them."""
    g = t.trade()
    features = run("util.graph.degree", g, True, False).df.select("id", F.col("value").cast("double").alias("i")).join(run("util.graph.degree", g, False, True).df.select("id", F.col("value").cast("double").alias("o")), "id")
    matrix, to_row = Matrix(features.select(F.col("id").alias("row"), F.array("i", "o").alias("values"))), NodeMap(features.select("id", F.col("id").alias("value")))
    return g, matrix, to_row, run("embedding.train.graph_sage.mean", g, matrix, to_row, layer_sizes=[8, 4], samples_per_layer=[3, 3], epochs=2)


@on_tables
def embedding_train_graph_sage_mean(t):
    """The weights of the trained layers."""
    model = _sage(t)[3]
    rows = [(k, i, [float(x) for x in row]) for k, w in enumerate(model.weights) for i, row in enumerate(w)]
    return t.spark.createDataFrame(rows, "layer long, row long, values array<double>")


@on_tables
def embedding_apply_graph_sage(t):
    g, matrix, to_row, model = _sage(t)
    return run("embedding.apply.graph_sage", model, g, matrix, to_row).df


@on_tables
def embedding_train_line(t):
    return _vectors(run("embedding.train.line", t.trade(), embedding_size=8, epochs=3))


def _sizes(found: DataFrame, key: str = "id") -> DataFrame:
    """Which vectors there are, and how many finite numbers each has."""
    return found.select(F.col(key).alias("id"), F.expr("size(filter(values, x -> x is not null and not isnan(x) and abs(x) < double('infinity')))").cast("long").alias("numbers"))


@on_tables
def embedding_sizes_node2vec(t):
    return _sizes(_vectors(run("embedding.train.node2vec", t.transitions(), walks_per_node=2, walk_length=5)))


@on_tables
def embedding_sizes_graph2vec(t):
    return _sizes(_region_vectors(t), "row")


@on_tables
def embedding_sizes_graphwave(t):
    scales = Vector(t.spark.createDataFrame([(0, 5.0), (1, 10.0)], "pos long, value double"))
    return _sizes(_vectors(run("embedding.train.graphwave", t.trade_both_ways(), scales, sample_point_count=5, chebyshev_degree=5)))


@on_tables
def embedding_sizes_hope_katz(t):
    return _sizes(_vectors(run("embedding.train.hope.katz", t.trade(), embedding_size=4, beta=0.001)))


@on_tables
def embedding_sizes_line(t):
    return _sizes(_vectors(run("embedding.train.line", t.trade(), embedding_size=8, epochs=3)))


@on_tables
def embedding_sizes_graph_sage(t):
    g, matrix, to_row, model = _sage(t)
    return _sizes(run("embedding.apply.graph_sage", model, g, matrix, to_row).df, "row")


@on_tables
def embedding_sizes_graph_sage_mean(t):
    """The rows of each layer's weights and their width."""
    rows = [(k, len(w), len(w[0])) for k, w in enumerate(_sage(t)[3].weights)]
    return t.spark.createDataFrame(rows, "layer long, rows long, width long")


# conversions, sources and streams


@on_tables
def convert_symmetrize(t):
    return symmetrize(t.together().edge_map()).df


@on_tables
def convert_canonicalize(t):
    return canonicalize(symmetrize(t.together().edge_map())).df


@on_tables
def convert_reindex(t):
    """The transitions with users numbered from 0 in the reverse order of their ids."""
    g = t.transitions()
    g = Graph(g.nodes.select((-3 * F.col("id")).alias("id")), g.edges.select((-3 * F.col("src")).alias("src"), (-3 * F.col("dst")).alias("dst"), "weight"), True)
    return reindex(g)[0].edges


@on_tables
def source_csr(t):
    g = reindex(t.transitions())[0]
    n = g.nodes.count()
    _, pointers = coo_to_csr(g.edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("value")), (n, n))
    return pointers.toDF("row", "pointer").select(F.col("row").cast("long").alias("row"), F.col("pointer").cast("long").alias("pointer"))


@on_tables
def source_round_trip(t):
    path = f"{shared_dir(t.spark)}/tables/graph-{t.spark.sparkContext.applicationId}-{id(t)}"
    write_graph(t.together(), path, mode="overwrite")
    return read_graph(t.spark, path, is_directed=False).edges


@on_tables
def stream_degree(t):
    """Degrees kept up to date while the events arrive as a stream, as they are at its end. A pattern names the table,
    as the stream reader takes either a single file or a folder that way."""
    edges = t.spark.readStream.schema(t.events.schema).parquet(f"{t.dir}/event[s].parquet").select(F.col("user_id").alias("src"), F.xxhash64("event_type").alias("dst"))
    base = f"{shared_dir(t.spark)}/tables/stream-{t.spark.sparkContext.applicationId}-{id(t)}"
    stream = degree_stream(edges).writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    stream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out")).start().awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("id", F.col("value").alias("degree"))


@on_tables
def stream_windowed_edges(t):
    """User and value bucket by windows of six hours."""
    edges = t.events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("src"), F.floor("value").alias("dst"))
    return windowed_edges(edges, "ts", "6 hours", "1 hour").groupBy("src", "dst").agg(F.count("*").alias("windows"), F.sum("weight").alias("edges"))
