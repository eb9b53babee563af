import operator

import numpy as np
import pytest

from graphlane import BipartiteGraph, ConvergenceError, EdgeMap, EdgeSet, Matrix, NodeLabels, NodeMap, Vector, algos, assert_equal, run
from graphlane.sources import coo_to_csr, node_map, node_set
from tests.graph.util import STANDARD, edges, graph, ids, values


def near(got, want, tol=1e-6):
    assert got.keys() == want.keys()
    for k in want:
        assert abs(got[k] - want[k]) <= tol, (k, got[k], want[k])


def parts(m):
    found = {}
    for k, v in values(m).items():
        found.setdefault(v, set()).add(k)
    assert sorted(found) == list(range(len(found)))
    return sorted(map(sorted, found.values()))


def test_betweenness(spark):
    near(values(algos.centrality.betweenness(graph(spark, STANDARD))), {0: 1, 1: 1, 2: 9, 3: 6, 4: 12, 5: 13, 6: 11, 7: 0})
    hub = [(0, 1, 2.0), (0, 3, 0.1), (1, 5, 1.0), (2, 5, 5.0), (2, 7, 6.0), (3, 1, 7.0), (3, 4, 0.1), (4, 1, 3.0), (4, 2, 1.0), (5, 6, 10.0), (6, 2, 11.0)]
    near(values(algos.centrality.betweenness(graph(spark, hub))), {0: 0, 1: 6, 2: 7, 3: 3, 4: 7, 5: 7, 6: 4, 7: 0})


def test_katz_and_pagerank(spark):
    g = graph(spark, [(a, b, 1) for a, b in [(0, 1), (0, 2), (2, 0), (1, 2), (1, 5), (3, 2), (3, 4), (5, 4)]])
    near(values(algos.centrality.katz(g, tolerance=1e-7)), dict(enumerate([0.40695499, 0.40687482, 0.41497162, 0.40280527, 0.41090207, 0.40687402])), 1e-5)
    g = graph(spark, [(a, b, 1) for a, b in [(0, 1), (0, 2), (2, 0), (1, 2), (3, 2)]])
    near(values(algos.centrality.pagerank(g, tolerance=1e-7)), {0: 0.37252685, 1: 0.19582391, 2: 0.39414924, 3: 0.0375})
    with pytest.raises(ConvergenceError):
        algos.centrality.pagerank(g, maxiter=2, tolerance=1e-9)
    assert parts(algos.clustering.strongly_connected_components(g)) == [[0, 1, 2], [3]]


def test_eigenvector_and_hits_satisfy_their_equations(spark):
    g = graph(spark, STANDARD, directed=False)
    x = values(algos.centrality.eigenvector(g, tolerance=1e-8, maxiter=300))
    a = np.zeros((8, 8))
    for s, t, w in STANDARD:
        a[s, t] = a[t, s] = w
    v = np.array([x[i] for i in range(8)])
    assert np.allclose(a @ v, (v @ a @ v) * v, atol=1e-4) and abs(np.linalg.norm(v) - 1) < 1e-9
    hubs, authority = algos.centrality.hits(graph(spark, STANDARD), tolerance=1e-8, maxiter=200)
    assert abs(sum(values(hubs).values()) - 1) < 1e-9 and abs(sum(values(authority).values()) - 1) < 1e-9


def test_degree_and_closeness(spark):
    g = graph(spark, [(0, 1, 5), (0, 4, 2), (1, 2, 2), (2, 0, 1), (2, 2, 4), (3, 0, 1), (3, 4, 7), (4, 0, 6)])
    assert values(algos.util.graph.degree(g)) == {0: 2, 1: 1, 2: 2, 3: 2, 4: 1}
    assert values(algos.util.graph.degree(g, True, False)) == {0: 3, 1: 1, 2: 2, 3: 0, 4: 2}
    assert values(algos.util.graph.degree(g, True, True)) == {0: 5, 1: 2, 2: 4, 3: 2, 4: 3}
    assert set(values(algos.util.graph.degree(g, False, False)).values()) == {0}
    u = graph(spark, [(0, 1), (0, 2), (0, 4), (1, 2), (2, 2), (2, 4)], directed=False, nodes=[3])
    assert values(algos.util.graph.degree(u)) == {0: 3, 1: 2, 2: 5, 3: 0, 4: 2}
    near(values(algos.centrality.degree(u)), {0: 3 / 4, 1: 2 / 4, 2: 5 / 4, 3: 0, 4: 2 / 4})
    star = graph(spark, [(0, 1, 1), (1, 2, 1)], directed=False)
    near(values(algos.centrality.closeness(star)), {0: 2 / 3, 1: 1, 2: 2 / 3})


def test_components_and_communities(spark):
    two = [e for e in STANDARD if e not in ((2, 4, 4), (4, 5, 9))]
    g = graph(spark, two, directed=False)
    want = [[0, 1, 3, 4], [2, 5, 6, 7]]
    assert parts(algos.clustering.connected_components(g)) == want
    assert parts(algos.clustering.label_propagation_community(g)) == want
    found, q = algos.clustering.louvain_community(g)
    assert q > 0.45 and len(values(found)) == 8
    tree = algos.traversal.minimum_spanning_tree(g)
    assert {w for _, _, w in edges(tree)} == {1, 2, 3, 5, 6, 10} and ids(tree) == set(range(8))
    tree = algos.traversal.minimum_spanning_tree(graph(spark, STANDARD, directed=False))
    assert {w for _, _, w in edges(tree)} == {1, 2, 3, 4, 5, 6, 10}


def test_triangles_colours_and_cores(spark):
    t = graph(spark, [(0, 1), (0, 3), (0, 4), (1, 3), (1, 4), (2, 4), (2, 5), (2, 6), (3, 4), (5, 6), (6, 7)], directed=False)
    assert algos.clustering.triangle_count(t) == 5
    c = graph(spark, [(1, 2), (1, 5), (2, 3), (2, 5), (3, 4), (4, 5), (4, 6)], directed=False)
    assert abs(algos.clustering.global_clustering_coefficient(c) - 3 / 11) < 1e-12
    colours, n = algos.clustering.coloring.greedy(graph(spark, [(0, 1), (0, 3), (0, 5), (1, 2), (2, 4), (3, 5), (4, 5)], directed=False))
    colours = values(colours)
    assert n == 3 and len({colours[0], colours[3], colours[5]}) == 3
    core = graph(spark, [(1, 0, 2), (1, 4, 3), (2, 5, 5), (2, 7, 6), (3, 1, 7), (5, 6, 10), (6, 2, 11)], directed=False)
    want = {(2, 5, 5), (5, 6, 10), (6, 2, 11)}
    assert edges(algos.subgraph.k_core(core, 2)) == want == edges(algos.subgraph.extract_subgraph(core, node_set(spark, [2, 5, 6])))
    truss = graph(spark, [(0, 1), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4), (2, 4), (2, 5), (3, 4)], directed=False)
    assert edges(algos.subgraph.k_truss(truss, 3)) == edges(truss) - {(2, 5)}
    assert edges(algos.subgraph.k_truss(truss, 4)) == {(0, 1), (0, 3), (0, 4), (1, 3), (1, 4), (3, 4)}


def test_shortest_paths(spark):
    g = graph(spark, STANDARD)
    for f in (algos.traversal.bellman_ford, algos.traversal.dijkstra):
        parents, dist = f(g, 0)
        assert values(dist) == {0: 0, 3: 1, 1: 8, 4: 9, 5: 18, 6: 28, 2: 39, 7: 45}
        assert values(parents) == {0: 0, 3: 0, 1: 3, 4: 3, 5: 4, 6: 5, 2: 6, 7: 2}
    negative = graph(spark, [(0, 1, 4), (0, 2, 5), (2, 1, -3)])
    assert values(run("traversal.bellman_ford", negative, 0)[1]) == {0: 0, 1: 2, 2: 5}
    with pytest.raises(TypeError):
        algos.traversal.dijkstra(negative, 0)
    with pytest.raises(ValueError):
        algos.traversal.bellman_ford(graph(spark, [(0, 1, 1), (1, 0, -2)]), 0)
    g = graph(spark, [(12, 13, 1), (12, 4, 3), (13, 4, 9), (13, 19, 2), (4, 19, 4)], directed=False)
    parents, dist = algos.traversal.all_pairs_shortest_paths(g)
    d = {(a, b): w for a, b, w in edges(dist)}
    assert d[12, 19] == 3 and d[13, 4] == 4 and d[4, 19] == 4 and len(d) == 12
    assert {(a, b): w for a, b, w in edges(parents)}[12, 19] == 13


def test_searches(spark):
    g = graph(spark, [(0, 3), (1, 0), (1, 4), (2, 4), (2, 5), (2, 7), (3, 4), (4, 5), (5, 6), (6, 2)])
    assert algos.traversal.bfs_iter(g, 0).to_list() == [0, 3, 4, 5, 6, 2, 7]
    assert algos.traversal.bfs_iter(g, 0, 4).to_list() == [0, 3, 4, 5, 6]
    g = graph(spark, [(0, 3), (0, 1), (1, 3), (1, 4), (2, 4), (2, 5), (2, 7), (3, 4), (4, 5), (5, 6), (6, 2)])
    depth, parent = algos.traversal.bfs_tree(g, 0)
    assert values(depth) == {0: 0, 1: 1, 3: 1, 4: 2, 5: 3, 6: 4, 2: 5, 7: 6} and values(parent)[4] in (1, 3)
    assert set(values(algos.traversal.bfs_tree(g, 0, 3)[0])) == {0, 1, 3, 4, 5}
    g = graph(spark, [(0, 3), (0, 1), (1, 4), (2, 4), (2, 5), (2, 7), (3, 4), (4, 5), (5, 6), (6, 2)])
    order = algos.traversal.dfs_iter(g, 0).to_list()
    assert order[0] == 0 and order[2:7] == [4, 5, 6, 2, 7] and abs(order.index(1) - order.index(3)) == 6
    assert values(algos.traversal.dfs_tree(g, 0))[0] == 0


def test_astar(spark):
    wall = {40 + y for y in range(1, 9)}
    e = [(10 * x + y, 10 * (x + a) + y + b, 1) for x in range(10) for y in range(10) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and 0 <= x + a < 10 and 0 <= y + b < 10]
    g = graph(spark, [t for t in e if t[0] not in wall and t[1] not in wall])
    path = algos.traversal.astar_search(g, 0, 99, lambda n: (9 - n // 10) ** 2 + (9 - n % 10) ** 2).to_list()
    assert path == [0, 11, 22, 33, 34, 35, 36, 37, 38, 49, 59, 69, 79, 89, 99]


def test_flow(spark):
    arcs = [(0, 1, 9), (0, 3, 10), (1, 4, 3), (2, 7, 6), (3, 1, 2), (3, 4, 8), (4, 5, 7), (4, 2, 4), (5, 2, 5), (5, 6, 1), (6, 2, 11)]
    value, flow = algos.flow.max_flow(graph(spark, arcs), 0, 7)
    assert value == 6 and len(edges(flow)) == len(arcs)
    for node in (2, 4):
        assert sum(w for a, _, w in edges(flow) if a == node) == 6 == sum(w for _, b, w in edges(flow) if b == node)
    value, cut = algos.flow.min_cut(graph(spark, [(a, b, 1 if (a, b) == (4, 5) else w) for a, b, w in arcs]), 0, 7)
    assert value == 5 and edges(cut) == {(4, 5, 1), (4, 2, 4)} and ids(cut) == set(range(8))


def test_bipartite(spark):
    e = EdgeSet(spark.createDataFrame([(0, 5), (0, 6), (2, 6), (2, 7), (2, 8), (3, 9)], "source long, target long"), is_directed=False)
    b = BipartiteGraph(e, node_set(spark, [0, 1, 2, 3]), node_set(spark, [5, 6, 7, 8, 9]))
    p = algos.bipartite.graph_projection(b, 1)
    assert edges(p) == {(5, 6), (6, 7), (6, 8), (7, 8)} and ids(p) == {5, 6, 7, 8, 9}
    with pytest.raises(ValueError):
        BipartiteGraph(e, node_set(spark, [0, 2, 3, 5]), node_set(spark, [5, 6, 7, 8, 9]))
    with pytest.raises(ValueError):
        BipartiteGraph(e, node_set(spark, [0]), node_set(spark, [5, 6, 7, 8, 9]))


def test_isomorphism(spark):
    g1 = graph(spark, [(0, 0), (0, 1), (0, 3), (1, 2), (2, 0), (2, 1), (3, 1), (3, 2), (4, 0)])
    g2 = graph(spark, [(0, 3), (0, 4), (1, 2), (2, 0), (2, 2), (2, 4), (3, 2), (3, 4), (4, 3)])
    assert algos.util.graph.isomorphic(g1, g2)
    assert not algos.util.graph.isomorphic(g1, graph(spark, [(0, 0), (0, 1), (0, 3), (1, 2), (2, 0), (2, 1), (3, 1), (3, 2), (0, 4)]))
    assert algos.subgraph.subisomorphic(graph(spark, STANDARD, directed=False), graph(spark, [(0, 1), (1, 2), (2, 0)], directed=False))
    assert not algos.subgraph.subisomorphic(graph(spark, [(0, 1), (1, 2), (2, 3)]), graph(spark, [(0, 1), (1, 0)]))


def test_samples(spark):
    full = [(a, b) for a in range(25) for b in range(a + 1, 25)]
    g = graph(spark, full, directed=False, nodes=list(range(50)))
    n = algos.subgraph.sample.node_sampling(g, 0.4, seed=1)
    k = len([i for i in ids(n) if i < 25])
    assert len(edges(n)) == k * (k - 1) // 2 and any(i >= 25 for i in ids(n))
    s = algos.subgraph.sample.edge_sampling(g, 0.1, seed=1)
    assert ids(s) == {x for e in edges(s) for x in e} and len(edges(s)) < len(full)
    t = algos.subgraph.sample.ties(g, 0.02, seed=1)
    assert len(edges(t)) == len(ids(t)) * (len(ids(t)) - 1) // 2
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            algos.subgraph.sample.node_sampling(g, bad)
    path = graph(spark, [(i, i + 1) for i in range(50)])
    assert ids(algos.subgraph.sample.random_walk(path, num_edges=20, start_node=0, jump_probability=1e-9)) == set(range(21))
    two = graph(spark, [(a + o, b + o) for o in (0, 10) for a in range(7) for b in range(7) if a != b])
    assert ids(algos.subgraph.sample.random_walk(two, num_nodes=7, start_node=12)) == set(range(10, 17))
    lone = graph(spark, [(0, 1)], nodes=[12])
    assert ids(algos.subgraph.sample.random_walk(lone, num_steps=100, start_node=12)) == {12}
    mis = ids(algos.subgraph.maximal_independent_set(graph(spark, STANDARD, directed=False)))
    assert not any(a in mis and b in mis for a, b, _ in STANDARD)
    assert all(n in mis or any(n in (a, b) and (a in mis or b in mis) for a, b, _ in STANDARD) for n in range(8))


def test_node_maps(spark):
    m = node_map(spark, {1: 11, 2: 22, 3: 33, 4: 44})
    assert values(algos.util.nodemap.select(m, node_set(spark, [2, 3, 9]))) == {2: 22, 3: 33}
    assert ids(algos.util.nodemap.filter(m, lambda x: x % 2 == 0)) == {2, 4}
    assert values(algos.util.nodemap.apply(m, lambda x: x * 100)) == {1: 1100, 2: 2200, 3: 3300, 4: 4400}
    assert values(algos.util.nodemap.apply(m, lambda x: 1.5 if x > 22 else 0.0)) == {1: 0.0, 2: 0.0, 3: 1.5, 4: 1.5}
    assert algos.util.nodemap.reduce(m, operator.add) == 110 == algos.util.nodemap.reduce(m, lambda a, b: a + b)
    assert algos.util.nodemap.reduce(m, np.multiply) == 11 * 22 * 33 * 44
    with pytest.raises(TypeError):
        algos.util.nodemap.filter(m, lambda a, b: True)
    s = node_map(spark, {i: 100 * i for i in range(1, 8)})
    assert algos.util.nodemap.sort(s).to_list() == [1, 2, 3, 4, 5, 6, 7]
    assert algos.util.nodemap.sort(s, limit=4).to_list() == [1, 2, 3, 4]
    assert algos.util.nodemap.sort(s, False, 3).to_list() == [7, 6, 5]
    chosen = ids(algos.util.nodeset.choose_random(node_set(spark, [100, 200, 300, 400]), 3))
    assert len(chosen) == 3 and chosen <= {100, 200, 300, 400}
    with pytest.raises(ValueError):
        algos.util.nodeset.choose_random(node_set(spark, [1]), 2)
    v = Vector(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 2)], "pos long, value long"))
    assert ids(algos.util.nodeset.from_vector(v)) == {1, 2, 3}


def test_edges_and_building(spark):
    g = graph(spark, STANDARD)
    assert values(algos.util.graph.aggregate_edges(g, operator.add, 0)) == {n: sum(w for a, _, w in STANDARD if a == n) for n in range(8)}
    assert values(algos.util.graph.aggregate_edges(g, lambda a, b: a * b, 1.0, in_edges=True, out_edges=False))[4] == 3 * 4 * 8
    assert {w for _, _, w in edges(algos.util.graph.filter_edges(g, lambda w: w > 5))} == {6, 7, 8, 9, 10, 11}
    assert {w for _, _, w in edges(algos.util.graph.assign_uniform_weight(g, 3))} == {3}
    m = algos.util.edgemap.from_edgeset(EdgeSet(spark.createDataFrame([(0, 7), (2, 7), (7, 0), (7, 2)], "source long, target long")), 9)
    assert {r[2] for r in m.df.collect()} == {9}
    u = graph(spark, [(1, 3, 3), (1, 5, 1), (3, 4, 4), (3, 5, 9), (4, 5, 2)], directed=False, nodes=[2, 9])
    assert ids(u) == {1, 2, 3, 4, 5, 9}
    c = algos.util.graph.collapse_by_label(u, node_map(spark, {1: 0, 3: 0, 4: 1, 5: 1, 2: 2, 9: 2}), operator.add)
    assert edges(c) == {(0, 0, 3), (0, 1, 14), (1, 1, 2)} and ids(c) == {0, 1, 2}
    with pytest.raises(ValueError):
        EdgeSet(spark.createDataFrame([(0, 1), (1, 0)], "source long, target long"), is_directed=False)
    with pytest.raises(TypeError):
        EdgeMap(spark.createDataFrame([(0, 1)], "a long, b long"))
    with pytest.raises(TypeError):
        NodeMap(spark.createDataFrame([(1, 2), (1, 3)], "id long, value long"), check=True)
    labels = NodeLabels(spark.createDataFrame([(0, "a"), (1, "b")], "id long, label string"))
    assert labels[[1, 0]] == ["b", "a"] and labels.ids("a") == 0
    with pytest.raises(KeyError):
        labels[7]


def test_dispatch_and_equality(spark):
    g = graph(spark, STANDARD)
    with pytest.raises(TypeError, match="is_directed"):
        algos.clustering.triangle_count(g)
    with pytest.raises(TypeError):
        algos.traversal.bfs_iter(g, 1.5)
    with pytest.raises(TypeError):
        algos.util.nodemap.sort(g)
    assert_equal(g, graph(spark, list(reversed(STANDARD))))
    with pytest.raises(AssertionError):
        assert_equal(g, graph(spark, STANDARD[:-1]))


def test_csr(spark):
    coo = spark.createDataFrame(list(zip([0, 0, 4, 4, 4, 8, 9], [1, 3, 0, 3, 5, 7, 7], range(1, 8), strict=True)), "row long, col long, value long")
    entries, pointers = coo_to_csr(coo, (10, 10))
    assert [r[1] for r in pointers.orderBy("row").collect()] == [0, 2, 2, 2, 2, 5, 5, 5, 5, 6, 7]
    assert [r[0] for r in entries.orderBy("at").select("value").collect()] == list(range(1, 8))
    with pytest.raises(ValueError):
        coo_to_csr(coo, (9, 10))


def test_gather(spark):
    m = Matrix(spark.createDataFrame([(0, [0.0, 1.0, 2.0]), (1, [3.0, 4.0, 5.0])], "row long, values array<double>"))
    to_row = node_map(spark, {9990: 0, 9991: 1})
    v = Vector(spark.createDataFrame([(0, 9991), (1, 9990), (2, 9991)], "pos long, value long"))
    assert algos.embedding.apply.nodes(m, to_row, v).to_numpy().tolist() == [[3, 4, 5], [0, 1, 2], [3, 4, 5]]
    with pytest.raises(KeyError):
        algos.embedding.apply.nodes(m, to_row, Vector(spark.createDataFrame([(0, 5)], "pos long, value long")))
