"""SQL for DuckDB that gives the results of graphlane.queries, where SQL can express them.

Iterations are unrolled to more rounds than the operators need; fixpoints use recursive tables with keys."""

from __future__ import annotations

TRADE = """
    trade_all AS (
        SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*)::BIGINT AS weight
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT src, dst, weight FROM (SELECT *, count(*) OVER w AS n, sum(weight) OVER w AS total FROM trade_all WINDOW w AS (PARTITION BY src)) WHERE weight * n > total),
    v AS (SELECT n_nationkey::BIGINT AS id FROM nation)"""
BOTH = TRADE + """,
    u AS MATERIALIZED (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(weight)::BIGINT AS weight FROM e GROUP BY 1, 2)"""
TOGETHER = """
    lines AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
    e AS MATERIALIZED (
        SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*)::BIGINT AS weight
        FROM lines a JOIN lines b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2),
    v AS (SELECT p_partkey AS id, p_size::BIGINT AS value FROM part),
    both_ways AS MATERIALIZED (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"""
STEPS = """
    after AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS dst FROM events),
    e AS MATERIALIZED (SELECT src, dst, count(*)::BIGINT AS weight FROM after WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2),
    v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e),
    s AS (SELECT min(user_id) AS id FROM events)"""


def sql(tables: str, body: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{tables}{',' + more if more else ''} {body}"


def unrolled(first: str, step: str, rounds: int) -> str:
    """Tables x0 .. x<rounds>; {x} in step stands for the one before."""
    parts = [f" x0 AS MATERIALIZED ({first})"]
    parts += [f" x{i + 1} AS MATERIALIZED ({step.replace('{x}', f'x{i}')})" for i in range(rounds)]
    return ",".join(parts)


RANK = unrolled(
    "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS x FROM v",
    """SELECT v.id, 0.85 * (coalesce(i.s, 0) + (SELECT coalesce(sum(x), 0) FROM {x} WHERE id NOT IN (SELECT src FROM e)) / (SELECT count(*) FROM v)) + 0.15 / (SELECT count(*) FROM v) AS x
       FROM v LEFT JOIN (SELECT e.dst AS id, sum(p.x / o.n) AS s FROM e JOIN {x} p ON p.id = e.src JOIN (SELECT src, count(*) AS n FROM e GROUP BY 1) o ON o.src = e.src GROUP BY 1) i ON i.id = v.id""",
    60,
)
KATZ = unrolled("SELECT id, 0.0::DOUBLE AS x FROM v", "SELECT v.id, 0.001 * coalesce(i.s, 0) + 1.0 AS x FROM v LEFT JOIN (SELECT e.dst AS id, sum(p.x * e.weight) AS s FROM e JOIN {x} p ON p.id = e.src GROUP BY 1) i ON i.id = v.id", 40)
EIGEN = unrolled(
    "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS x FROM v",
    """SELECT id, y / (sqrt(sum(y * y) OVER ())) AS x FROM (
       SELECT p.id, p.x + coalesce(i.s, 0) AS y FROM {x} p LEFT JOIN (SELECT e.dst AS id, sum(q.x * e.weight) AS s FROM e JOIN {x} q ON q.id = e.src GROUP BY 1) i ON i.id = p.id)""",
    60,
)
AUTHORITY = "SELECT v.id, coalesce(i.s, 0) AS x FROM v LEFT JOIN (SELECT e.dst AS id, sum(h.x * e.weight) AS s FROM e JOIN {x} h ON h.id = e.src GROUP BY 1) i ON i.id = v.id"
HUBS = unrolled(
    "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS x FROM v",
    f"""SELECT v.id, coalesce(i.s, 0) / max(i.s) OVER () AS x FROM v LEFT JOIN (SELECT e.src AS id, sum(a.x * e.weight) AS s FROM e JOIN ({AUTHORITY}) a ON a.id = e.dst GROUP BY 1) i ON i.id = v.id""",
    50,
)
DISTANCES = """
    d(s, id, d) USING KEY (s, id) AS (
        SELECT id, id, 0::BIGINT FROM {sources}
        UNION
        SELECT d.s, e.dst, min(d.d + e.weight)::BIGINT FROM d JOIN e ON e.src = d.id LEFT JOIN recurring.d o ON o.s = d.s AND o.id = e.dst
        WHERE o.d IS NULL OR d.d + e.weight < o.d GROUP BY d.s, e.dst)"""
PARENTS = " (SELECT a.s, b.id, min(a.id) AS parent FROM d a JOIN e ON e.src = a.id JOIN d b ON b.s = a.s AND b.id = e.dst WHERE a.d + e.weight = b.d AND b.id <> b.s GROUP BY 1, 2)"
SINGLE = sql(STEPS, f"SELECT d.id, d.d AS distance, coalesce(p.parent, d.id) AS parent FROM d LEFT JOIN {PARENTS} p ON p.s = d.s AND p.id = d.id", DISTANCES.format(sources="s"), True)
LEVELS = """
    b(id, depth) USING KEY (id) AS (
        SELECT id, 0 FROM s
        UNION
        SELECT e.dst, min(b.depth + 1) FROM b JOIN e ON e.src = b.id LEFT JOIN recurring.b o ON o.id = e.dst WHERE o.id IS NULL GROUP BY e.dst)"""
LABELS = """
    l(id, label) USING KEY (id) AS (
        SELECT id, id FROM v
        UNION
        SELECT w.dst, min(l.label) FROM l JOIN both_ways w ON w.src = l.id JOIN recurring.l o ON o.id = w.dst WHERE l.label < o.label GROUP BY w.dst)"""
REACHED = " r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)"
CORE = unrolled("SELECT src, dst, weight FROM e", "SELECT c.* FROM {x} c WHERE src IN (SELECT id FROM (SELECT src AS id FROM {x} UNION ALL SELECT dst FROM {x}) GROUP BY id HAVING count(*) >= 3) AND dst IN (SELECT id FROM (SELECT src AS id FROM {x} UNION ALL SELECT dst FROM {x}) GROUP BY id HAVING count(*) >= 3)", 40)
TRUSS = unrolled("SELECT src, dst, weight FROM e", "SELECT DISTINCT c.* FROM {x} c JOIN (SELECT src AS a, dst AS b FROM {x} UNION ALL SELECT dst, src FROM {x}) p ON p.a = c.src JOIN (SELECT src AS a, dst AS b FROM {x} UNION ALL SELECT dst, src FROM {x}) q ON q.a = c.dst AND q.b = p.b", 8)
#: the least possible heaviest edge of a path between two nodes
HEAVIEST = """
    w AS (SELECT src, dst, weight FROM u UNION ALL SELECT dst, src, weight FROM u),
    k AS (SELECT src, dst, (weight, least(src, dst), greatest(src, dst)) AS k FROM w),
    m(a, b, k) USING KEY (a, b) AS (
        SELECT src, dst, k FROM k
        UNION
        SELECT m.a, k.dst, min(greatest(m.k, k.k)) FROM m JOIN k ON k.src = m.b LEFT JOIN recurring.m o ON o.a = m.a AND o.b = k.dst
        WHERE m.a <> k.dst AND (o.k IS NULL OR greatest(m.k, k.k) < o.k) GROUP BY m.a, k.dst)"""
COUNTS = """
    walk(s, id) AS (SELECT id, id FROM v UNION ALL SELECT p.s, e.dst FROM walk p JOIN d a ON a.s = p.s AND a.id = p.id JOIN e ON e.src = p.id JOIN d b ON b.s = p.s AND b.id = e.dst WHERE a.d + e.weight = b.d),
    sigma AS MATERIALIZED (SELECT walk.s, walk.id, any_value(d.d) AS d, count(*)::DOUBLE AS n FROM walk JOIN d ON d.s = walk.s AND d.id = walk.id GROUP BY 1, 2)"""
TRIANGLES = "SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = a.src AND c.dst = b.dst"


def lot(seed: int, *columns: str) -> str:
    """The text that graphlane.functions.lots orders by."""
    return "md5(concat(" + ", ',', ".join([*columns, f"'{seed}'"]) + "))"


def chance(seed: int, *columns: str) -> str:
    return f"(('0x' || {lot(seed, *columns)}[1:13])::BIGINT / {float(1 << 52)})"


#: of each node the places of its neighbours that come before it
BEFORE = """
    before AS MATERIALIZED (SELECT a.k, list(DISTINCT b.k) AS p FROM n a JOIN both_ways w ON w.src = a.id JOIN n b ON b.id = w.dst AND b.k < a.k GROUP BY a.k)"""
CHOSEN = f"""
    n AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY {lot(0, 'id')}, id) AS k FROM v),{BEFORE},
    m(k, chosen) AS (
        SELECT 0::BIGINT, []::BIGINT[]
        UNION ALL
        SELECT m.k + 1, CASE WHEN list_has_any(m.chosen, coalesce(b.p, []::BIGINT[])) THEN m.chosen ELSE list_append(m.chosen, m.k + 1) END
        FROM m LEFT JOIN before b ON b.k = m.k + 1 WHERE m.k < (SELECT count(*) FROM n))"""
COLOURS = f"""
    n AS MATERIALIZED (SELECT v.id, row_number() OVER (ORDER BY count(w.dst) DESC, {lot(0, 'v.id')}, v.id) AS k FROM v LEFT JOIN both_ways w ON w.src = v.id GROUP BY v.id),{BEFORE},
    m(k, colours) AS (
        SELECT 0::BIGINT, []::BIGINT[]
        UNION ALL
        SELECT m.k + 1, list_append(m.colours, list_min(list_filter(range(len(coalesce(b.p, [])) + 1), lambda x: NOT list_contains(list_transform(coalesce(b.p, []::BIGINT[]), lambda q: m.colours[q]), x))))
        FROM m LEFT JOIN before b ON b.k = m.k + 1 WHERE m.k < (SELECT count(*) FROM n))"""
DEPTH_FIRST = """
    near AS MATERIALIZED (SELECT src, list(dst ORDER BY dst) AS near FROM e GROUP BY src),
    t(path, seen, met) AS (
        SELECT [id], [id], true FROM s
        UNION ALL
        SELECT CASE WHEN x IS NULL THEN path[1:len(path) - 1] ELSE list_append(path, x) END, CASE WHEN x IS NULL THEN seen ELSE list_append(seen, x) END, x IS NOT NULL
        FROM (SELECT path, seen, list_filter(coalesce(near, []::BIGINT[]), lambda y: NOT list_contains(seen, y))[1] AS x FROM t LEFT JOIN near ON near.src = t.path[-1] WHERE len(path) > 0))"""
WALK = f"""
    near AS MATERIALIZED (SELECT src, list(dst ORDER BY dst) AS near FROM e GROUP BY src),
    t(step, here, src) AS (
        SELECT 0::BIGINT, id, NULL::BIGINT FROM s
        UNION ALL
        SELECT t.step + 1, CASE WHEN {chance(1, 't.step + 1', "'0'")} < 0.15 OR near IS NULL THEN (SELECT id FROM s) ELSE near[floor({chance(1, 't.step + 1', "'1'")} * len(near))::BIGINT + 1] END,
            CASE WHEN {chance(1, 't.step + 1', "'0'")} < 0.15 OR near IS NULL THEN NULL ELSE t.here END
        FROM t LEFT JOIN near ON near.src = t.here WHERE t.step < 500)"""

ORACLE_SQL = {
    "util_nodeset_choose_random": f"SELECT c_custkey AS id FROM customer ORDER BY {lot(1, 'c_custkey')}, c_custkey LIMIT 100",
    "subgraph_sample_node_sampling": sql(TOGETHER, f"SELECT id FROM v WHERE {chance(1, 'id')} < 0.4"),
    "subgraph_sample_edge_sampling": sql(TOGETHER, f"SELECT src, dst, weight FROM e WHERE {chance(1, 'src', 'dst')} < 0.2"),
    "subgraph_sample_ties": sql(TOGETHER, "SELECT src, dst, weight FROM e WHERE src IN (SELECT id FROM x) AND dst IN (SELECT id FROM x)", f" c AS (SELECT src, dst FROM e WHERE {chance(1, 'src', 'dst')} < 0.1), x AS (SELECT src AS id FROM c UNION SELECT dst FROM c)"),
    "subgraph_sample_random_walk": sql(STEPS, "SELECT DISTINCT e.src, e.dst, e.weight FROM t JOIN e ON e.src = t.src AND e.dst = t.here", WALK, True),
    "subgraph_maximal_independent_set": sql(TOGETHER, "SELECT n.id FROM n WHERE n.k IN (SELECT unnest(chosen) FROM m WHERE k = (SELECT count(*) FROM n))", CHOSEN, True),
    "clustering_coloring_greedy": sql(TOGETHER, "SELECT n.id, (SELECT colours FROM m WHERE k = (SELECT count(*) FROM n))[n.k]::BIGINT AS colour FROM n", COLOURS, True),
    "clustering_coloring_conflicts": "SELECT 0::BIGINT AS conflicts, 0::BIGINT AS uncoloured",
    "clustering_label_propagation_stability": "SELECT count(*)::BIGINT AS nodes, 0::BIGINT AS unstable FROM nation",
    "clustering_louvain_consistency": "SELECT count(*)::BIGINT AS nodes, 0.0::DOUBLE AS difference, true AS better FROM nation",
    "traversal_dfs_iter": sql(STEPS, "SELECT (len(seen) - 1)::BIGINT AS pos, path[-1] AS id FROM t WHERE met", DEPTH_FIRST, True),
    "traversal_dfs_tree": sql(STEPS, "SELECT path[-1] AS id, CASE WHEN len(path) > 1 THEN path[-2] ELSE path[-1] END AS parent FROM t WHERE met", DEPTH_FIRST, True),
    "flow_balance": "SELECT 0::BIGINT AS over_capacity, 0::BIGINT AS unbalanced",
    "flow_cut": "SELECT 0::BIGINT AS target_reached, 0.0::DOUBLE AS excess",
    "embedding_sizes_node2vec": sql(STEPS, "SELECT id, 16::BIGINT AS numbers FROM v"),
    "embedding_sizes_graphwave": "SELECT n_nationkey::BIGINT AS id, 20::BIGINT AS numbers FROM nation",
    "embedding_sizes_hope_katz": "SELECT n_nationkey::BIGINT AS id, 4::BIGINT AS numbers FROM nation",
    "embedding_sizes_line": "SELECT n_nationkey::BIGINT AS id, 8::BIGINT AS numbers FROM nation",
    "embedding_sizes_graph2vec": "SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS id, 16::BIGINT AS numbers FROM region",
    "embedding_sizes_graph_sage_mean": "SELECT * FROM (VALUES (0::BIGINT, 4::BIGINT, 8::BIGINT), (1, 16, 4)) AS x(layer, rows, width)",
    "embedding_sizes_graph_sage": "SELECT n_nationkey::BIGINT AS id, 4::BIGINT AS numbers FROM nation",
    "util_nodeset_from_vector": "SELECT DISTINCT c_nationkey::BIGINT AS id FROM customer",
    "util_nodemap_sort": "SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos, c_custkey AS id FROM customer",
    "util_nodemap_sort_top": "SELECT pos, id FROM (SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS pos, c_custkey AS id FROM customer) WHERE pos < 10",
    "util_nodemap_select": "SELECT c_custkey AS id, c_acctbal AS value FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "util_nodemap_filter": "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000",
    "util_nodemap_apply": "SELECT o_orderkey AS id, floor(o_totalprice)::BIGINT * 2 + 1 AS value FROM orders",
    "util_nodemap_reduce": "SELECT sum(floor(o_totalprice)::BIGINT)::BIGINT AS total FROM orders",
    "util_edgemap_from_edgeset": sql(STEPS, "SELECT src, dst, 7::BIGINT AS weight FROM e"),
    "util_graph_degree": sql(STEPS, """SELECT v.id, coalesce(o.n, 0)::BIGINT AS out_degree, coalesce(i.n, 0)::BIGINT AS in_degree, (coalesce(o.n, 0) + coalesce(i.n, 0))::BIGINT AS degree
        FROM v LEFT JOIN (SELECT src AS id, count(*) AS n FROM e GROUP BY 1) o ON o.id = v.id LEFT JOIN (SELECT dst AS id, count(*) AS n FROM e GROUP BY 1) i ON i.id = v.id"""),
    "util_graph_aggregate_edges": sql(STEPS, "SELECT v.id, coalesce(i.n, 0)::BIGINT AS value FROM v LEFT JOIN (SELECT dst AS id, sum(weight) AS n FROM e GROUP BY 1) i ON i.id = v.id"),
    "util_graph_filter_edges": sql(STEPS, "SELECT src, dst, weight FROM e WHERE weight > 1"),
    "util_graph_assign_uniform_weight": sql(STEPS, "SELECT src, dst, 3::BIGINT AS weight FROM e"),
    "util_graph_build": "SELECT p_partkey AS id, p_size::BIGINT AS value FROM part",
    "util_graph_collapse_by_label": sql(TOGETHER, "SELECT least(a.value, b.value) AS src, greatest(a.value, b.value) AS dst, sum(weight)::BIGINT AS weight FROM e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst GROUP BY 1, 2"),
    "util_graph_isomorphic": "SELECT true AS found",
    "centrality_pagerank": sql(STEPS, "SELECT id, round(x, 6) AS pagerank FROM x60", RANK),
    "centrality_katz": sql(STEPS, "SELECT id, round(x / sqrt(sum(x * x) OVER ()), 6) AS katz FROM x40", KATZ),
    "centrality_eigenvector": sql(STEPS, "SELECT id, round(x, 6) AS eigenvector FROM x60", EIGEN),
    "centrality_hits": sql(STEPS, f"SELECT h.id, round(h.x / sum(h.x) OVER (), 6) AS hub, round(a.x / sum(a.x) OVER (), 6) AS authority FROM x50 h JOIN ({AUTHORITY.replace('{x}', 'x50')}) a ON a.id = h.id", HUBS),
    "centrality_degree": sql(STEPS, "SELECT v.id, round(count(*) / ((SELECT count(*) FROM v) - 1.0), 6) AS centrality FROM v JOIN (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) x ON x.id = v.id GROUP BY 1"),
    "centrality_closeness": sql(TRADE, "SELECT v.id, coalesce(round(r.n / r.total * r.n / ((SELECT count(*) FROM v) - 1.0), 6), 0.0) AS closeness FROM v LEFT JOIN (SELECT id, count(*) AS n, sum(d)::DOUBLE AS total FROM d WHERE s <> id GROUP BY 1) r ON r.id = v.id", DISTANCES.format(sources="v"), True),
    "centrality_betweenness": sql(TRADE, """SELECT v.id, round(coalesce(b.x, 0), 6) AS betweenness FROM v LEFT JOIN (
        SELECT f.id, sum(f.n * g.n / h.n) AS x FROM sigma f JOIN sigma g ON g.s = f.id JOIN sigma h ON h.s = f.s AND h.id = g.id
        WHERE f.s <> f.id AND g.id <> f.id AND f.s <> g.id AND f.d + g.d = h.d GROUP BY 1) b ON b.id = v.id""", DISTANCES.format(sources="v") + "," + COUNTS, True),
    "clustering_connected_components": sql(TOGETHER, "SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS component FROM l", LABELS, True),
    "clustering_strongly_connected_components": sql(STEPS, "SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS component FROM (SELECT v.id, least(v.id, min(x.b)) AS label FROM v LEFT JOIN (SELECT p.a, p.b FROM r p JOIN r q ON q.a = p.b AND q.b = p.a) x ON x.a = v.id GROUP BY v.id)", REACHED, True),
    "clustering_triangle_count": sql(TOGETHER, f"SELECT count(*)::BIGINT AS triangles FROM ({TRIANGLES})"),
    "clustering_global_clustering_coefficient": sql(TOGETHER, f"SELECT round(3.0::DOUBLE * (SELECT count(*) FROM ({TRIANGLES})) / (SELECT sum(n * (n - 1) / 2) FROM (SELECT src, count(*) AS n FROM both_ways GROUP BY 1)), 9) AS coefficient"),
    "clustering_modularity": sql(BOTH, """SELECT round((SELECT sum(weight) FROM x WHERE a = b) / (SELECT sum(weight) FROM x)::DOUBLE
        - (SELECT sum((k / (2.0 * (SELECT sum(weight) FROM x))) ** 2) FROM (SELECT c, sum(weight)::DOUBLE AS k FROM (SELECT a AS c, weight FROM x UNION ALL SELECT b, weight FROM x) GROUP BY 1)), 9) AS modularity""",
        " x AS (SELECT p.n_regionkey AS a, q.n_regionkey AS b, weight FROM u JOIN nation p ON p.n_nationkey = u.src JOIN nation q ON q.n_nationkey = u.dst)"),
    "traversal_bfs_iter": sql(STEPS, "SELECT row_number() OVER (ORDER BY depth, id) - 1 AS pos, id FROM b", LEVELS, True),
    "traversal_bfs_tree": sql(STEPS, "SELECT b.id, any_value(b.depth)::BIGINT AS depth, coalesce(min(p.id), b.id) AS parent FROM b LEFT JOIN e ON e.dst = b.id AND b.depth > 0 LEFT JOIN b p ON p.id = e.src AND p.depth = b.depth - 1 GROUP BY b.id", LEVELS, True),
    "traversal_bellman_ford": SINGLE,
    "traversal_dijkstra": SINGLE,
    "traversal_all_pairs_shortest_paths": sql(TRADE, f"SELECT d.s AS src, d.id AS dst, d.d AS distance, p.parent FROM d JOIN {PARENTS} p ON p.s = d.s AND p.id = d.id", DISTANCES.format(sources="v"), True),
    "traversal_minimum_spanning_tree": sql(BOTH, "SELECT u.src, u.dst, u.weight FROM u JOIN m ON m.a = u.src AND m.b = u.dst WHERE (u.weight, u.src, u.dst) = m.k", HEAVIEST, True),
    "traversal_astar_length": sql(STEPS, "SELECT max(d)::BIGINT AS length FROM d", DISTANCES.format(sources="s"), True),
    "flow_values": "SELECT 0.0::DOUBLE AS difference",
    "subgraph_extract_subgraph": sql(TOGETHER, "SELECT src, dst, weight FROM e WHERE src IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND dst IN (SELECT p_partkey FROM part WHERE p_size <= 25)"),
    "subgraph_k_core": sql(TOGETHER, "SELECT src, dst, weight FROM x40", CORE),
    "subgraph_k_truss": sql(TOGETHER, "SELECT src, dst, weight FROM x8", TRUSS),
    "subgraph_independence": "SELECT 0::BIGINT AS edges_inside, 0::BIGINT AS nodes_open",
    "subgraph_subisomorphic": sql(STEPS, "SELECT count(*) > 0 AS found FROM (SELECT a.src FROM n a JOIN n b ON b.src = a.dst JOIN n c ON c.src = b.dst AND c.dst = a.src)", " n AS (SELECT src, dst FROM e WHERE (dst, src) NOT IN (SELECT (src, dst) FROM e))"),
    "bipartite_graph_projection": """WITH p AS (SELECT DISTINCT o_custkey AS c, -1 - l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT DISTINCT a.s AS src, b.s AS dst FROM p a JOIN p b ON a.c = b.c AND a.s < b.s""",
    "embedding_apply_nodes": "SELECT vec_id AS row, unnest(range(len(embedding))) AS k, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings",
    "convert_symmetrize": sql(TOGETHER, "SELECT src, dst, weight FROM both_ways"),
    "convert_canonicalize": sql(TOGETHER, "SELECT src, dst, weight FROM e"),
    "convert_reindex": sql(STEPS, "SELECT a.k AS src, b.k AS dst, weight FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst", " n AS (SELECT id, row_number() OVER (ORDER BY id DESC) - 1 AS k FROM v)"),
    "source_csr": sql(STEPS, "SELECT row, coalesce(sum(n) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pointer FROM (SELECT row_number() OVER (ORDER BY v.id) - 1 AS row, count(e.src) AS n FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id UNION ALL SELECT count(*), 0 FROM v)"),
    "source_round_trip": sql(TOGETHER, "SELECT src, dst, weight FROM e"),
    "stream_degree": "SELECT user_id AS id, count(*)::BIGINT AS degree FROM events GROUP BY 1",
    "stream_windowed_edges": "SELECT src, dst, count(*)::BIGINT AS windows, sum(n)::BIGINT AS edges FROM (SELECT user_id AS src, floor(value)::BIGINT AS dst, time_bucket(INTERVAL 6 HOURS, ts) AS w, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1, 2",
}
