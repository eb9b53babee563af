"""Registered queries against their SQL in DuckDB, and invariants of those that SQL can't express."""

import glob
import os

import duckdb
import pytest

from graphlane.oracle import ORACLE_SQL
from graphlane.queries import QUERIES, Tables

SF = "/root/testdata/sf0.001"
QUICK = [q for q in ORACLE_SQL if q.startswith(("util_", "subgraph_extract", "subgraph_k_truss", "bipartite", "embedding_apply", "convert_", "source_", "stream_", "traversal_b", "traversal_all", "centrality_degree", "clustering_triangle", "clustering_modularity", "flow_", "subgraph_sample", "traversal_dfs"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(pdf):
    return sorted(repr(tuple(float(x) if isinstance(x, float) else x for x in r)) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False))


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_colours_differ_along_edges(spark):
    colour = {r.id: r.colour for r in QUERIES["clustering_coloring_greedy"](spark, SF).collect()}
    assert all(colour[e.src] != colour[e.dst] for e in Tables(spark, SF).together().edges.collect())


def test_flow_is_kept_at_inner_nodes(spark):
    flow = QUERIES["flow_max_flow"](spark, SF).collect()
    room = {(e.src, e.dst): e.weight for e in Tables(spark, SF).trade().edges.collect()}
    net = {}
    for r in flow:
        assert 0 <= r.weight <= room[r.src, r.dst]
        net[r.src], net[r.dst] = net.get(r.src, 0) - r.weight, net.get(r.dst, 0) + r.weight
    assert sum(1 for v in net.values() if v) in (0, 2)


def test_searches_visit_what_they_reach(spark):
    order = [r.id for r in QUERIES["traversal_dfs_iter"](spark, SF).orderBy("pos").collect()]
    tree = {r.id: r.parent for r in QUERIES["traversal_dfs_tree"](spark, SF).collect()}
    edges = {(e.src, e.dst) for e in Tables(spark, SF).transitions().edges.collect()}
    assert sorted(order) == sorted(tree) and all(i == p or (p, i) in edges for i, p in tree.items())


@pytest.mark.parametrize("name", ["embedding_train_node2vec", "embedding_train_graphwave", "embedding_train_line", "embedding_apply_graph_sage"])
def test_embeddings_have_a_vector_for_each_node(spark, name):
    found = QUERIES[name](spark, SF).collect()
    sizes = {len(r["values"]) for r in found}
    assert found and len(sizes) == 1 and all(x == x for r in found for x in r["values"])
