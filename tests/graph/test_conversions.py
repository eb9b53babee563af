import numpy as np
import pytest

from graphlane import CONFIG, EdgeMap, EdgeSet, Matrix, NodeMap, NodeSet, Vector, algorithm, convert, describe, list_algorithms, list_types, plan, run, solve_algorithm
from graphlane.convert import canonicalize, from_mask, from_numpy, reindex, symmetrize
from graphlane.sources import from_pandas_edges, node_map, node_set, read_edges, write_edges
from tests.graph.util import STANDARD, edges, graph, ids


def pairs(e):
    return {tuple(r) for r in e.df.collect()}


def test_edges_both_ways_and_back(spark):
    e = EdgeMap(spark.createDataFrame([(0, 1, 2.5), (2, 1, 1.0), (3, 3, 0.0)], "source long, target long, weight double"), is_directed=False)
    both = symmetrize(e)
    assert both.is_directed and pairs(both) == {(0, 1, 2.5), (1, 0, 2.5), (2, 1, 1.0), (1, 2, 1.0), (3, 3, 0.0)}
    assert pairs(canonicalize(both)) == {(0, 1, 2.5), (1, 2, 1.0), (3, 3, 0.0)} == pairs(canonicalize(e))
    assert pairs(e.edge_set()) == {(0, 1), (2, 1), (3, 3)} and e.has_negative_weights is False
    with pytest.raises(ValueError):
        canonicalize(EdgeSet(spark.createDataFrame([(0, 1)], "source long, target long")))


def test_local_values(spark):
    m = node_map(spark, {3: 1.5, 7: 2.0})
    assert convert(m, "dict") == {3: 1.5, 7: 2.0} and convert(m, "set") == {3, 7} and m[[7, 3]] == [2.0, 1.5] and 3 in m and len(m) == 2
    with pytest.raises(KeyError):
        m[4]
    assert convert(node_set(spark, [1, 5]), "set") == {1, 5}
    v, a = from_numpy(spark, np.array([3, 1, 2])), from_numpy(spark, np.arange(6.0).reshape(2, 3))
    assert isinstance(v, Vector) and convert(v, "list") == [3, 1, 2] and isinstance(a, Matrix) and convert(a, "numpy").tolist() == [[0, 1, 2], [3, 4, 5]]
    assert isinstance(from_mask(spark, [True, False, True]), NodeSet) and isinstance(from_mask(spark, [True, False], [4, 5]), NodeMap)
    with pytest.raises(ValueError):
        convert(m, "nothing known")


def test_ids_are_renumbered_in_order(spark):
    g, number = reindex(graph(spark, [(10, 70, 1), (70, 30, 2)]))
    assert ids(g) == {0, 1, 2} and edges(g) == {(0, 2, 1), (2, 1, 2)} and convert(number, "dict") == {10: 0, 30: 1, 70: 2}


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_edges_survive_files(spark, tmp_path, kind):
    e = from_pandas_edges(spark, spark.createDataFrame([(0, 1, 2), (1, 2, 3)], "source long, target long, weight long").toPandas())
    write_edges(e, str(tmp_path / "e"), kind, **({"header": "true"} if kind == "csv" else {}))
    back = read_edges(spark, str(tmp_path / "e"), kind, src="src", dst="dst", **({"header": "true", "inferSchema": "true"} if kind == "csv" else {}))
    assert pairs(back) == {(0, 1, 2), (1, 2, 3)}


def test_catalogue(spark, capsys):
    assert len(list_algorithms()) >= 58 and describe("centrality.pagerank")["signature"].startswith("(graph")
    assert plan.subgraph.extract_subgraph(graph(spark, STANDARD), node_set(spark, [0, 3]))["plans"]
    with pytest.raises(KeyError):
        run("no.such.operator")

    @algorithm("test.own.count")
    def count(x: NodeSet) -> int:
        return len(x)

    CONFIG["log_plans"] = True
    try:
        assert run("test.own.count", node_set(spark, [1, 2])) == 2
    finally:
        CONFIG["log_plans"] = False
    assert "test.own.count" in capsys.readouterr().out


def test_choices_and_conversions_of_dispatch(spark):
    m = node_map(spark, {1: 5, 2: 6})

    @algorithm("test.own.size", version=1)
    def size(x: NodeSet) -> int:
        return len(x)

    @algorithm("test.own.size", version=1, impl="doubled")
    def doubled(x: NodeSet) -> int:
        return 2 * len(x)

    s = node_set(spark, [1, 2, 3])
    assert s.run("test.own.size") == 3 == run("test.own.size", s) and run("test.own.size", s, impl="doubled") == 6 == size(s, impl="doubled")
    assert run("test.own.size", m) == 2  # a node map serves as a node set
    assert solve_algorithm("test.own.size", m)["arguments"]["x"] == {"given": "NodeMap", "used": "NodeSet"}
    with pytest.raises(KeyError):
        run("test.own.size", s, impl="unknown")
    CONFIG["allow_conversion"] = False
    try:
        assert "must be NodeSet" in solve_algorithm("test.own.size", m)["error"]
        with pytest.raises(TypeError):
            run("test.own.size", m)
    finally:
        CONFIG["allow_conversion"] = True
    with pytest.warns(UserWarning, match="no version 7"):
        algorithm("test.own.size", version=7, impl="newer")(lambda x: 0)
    CONFIG["outdated_version"] = "raise"
    try:
        with pytest.raises(ValueError):
            algorithm("test.own.size", version=0, impl="older")(lambda x: 0)
    finally:
        CONFIG["outdated_version"] = "ignore"
    assert describe("test.own.size")["implementations"] == ["dataframe", "doubled", "newer"] and "NodeSet" in list_types()["NodeMap"]


def test_loops_leave_one_state_on_disk(spark):
    import os

    from graphlane.operators.traversal import distances
    from graphlane.plans.components import components
    from graphlane.plans.tables import tables_dir

    folder = tables_dir(spark).removeprefix("file:")
    here = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = here()
    path = spark.createDataFrame([(i, i + 1, 1) for i in range(40)], "src long, dst long, weight long")
    assert components(path).where("label = 0").count() == 41
    assert [x.split("-")[0] for x in here() - before] == ["labels"]
    before = here()
    g = graph(spark, [(i, i + 1, 1) for i in range(12)])
    assert distances(g, g.nodes.where("id = 0").select("id")).count() == 13
    assert [x.split("-")[0] for x in here() - before] == ["distances"]


def test_loader_errors(spark):
    from graphlane.sources import coo_to_csr

    coo = spark.createDataFrame([(0, 1, 1.0), (0, 3, 2.0), (4, 0, 3.0)], "row long, col long, value double")
    placed, pointers = coo_to_csr(coo, (5, 4))
    assert [r.start for r in pointers.orderBy("row").collect()] == [0, 2, 2, 2, 2, 3] and placed.count() == 3
    for shape in ((4, 4), (5, 3)):
        with pytest.raises(ValueError):
            coo_to_csr(coo, shape)
    assert [r.start for r in coo_to_csr(coo.limit(0), (2, 2))[1].orderBy("row").collect()] == [0, 0, 0]
