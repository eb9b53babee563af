"""Node and graph embeddings: gather, walks with Word2Vec, spectral methods by joins, and small trainers in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.operators.utility import degrees
from graphlane.plans.local import in_one_task
from graphlane.plans.ordering import positions
from graphlane.plans.tables import written
from graphlane.registry import algorithm
from graphlane.types import Graph, Matrix, NodeMap, Vector

ROWS_A_PART = 100_000
MOST_NODES = 5_000_000


def _numbered(rows: DataFrame, vector: str) -> tuple[Matrix, NodeMap]:
    """(matrix, node to row) of (id, vector), rows by id."""
    placed = written(positions(rows, F.col("id"), pos="row"), "embedding")
    return Matrix(placed, values=vector), NodeMap(placed, value="row")


@algorithm("embedding.apply.nodes")
def apply_nodes(matrix: Matrix, node2row: NodeMap, nodes: Vector) -> Matrix:
    """The rows of the nodes, in the vector's order. KeyError if a node has no row."""
    rows = nodes.df.join(node2row.df.select(F.col("id").alias("value"), F.col("value").alias("gl_row")), "value", "left")
    missing = rows.where("gl_row is null").select("value").first()
    if missing:
        raise KeyError(missing[0])
    return Matrix(rows.select("pos", F.col("gl_row").alias("row")).join(matrix.df, "row").select(F.col("pos").alias("row"), "values"))


def walks(graph: Graph, p: float, q: float, per_node: int, length: int, seed: int) -> DataFrame:
    """(wid, step, id): second-order random walks. A step's choice is the least of exponential variates made from a
    hash, so it doesn't depend on how rows are partitioned. The table of candidates is a walk's edges at its node."""
    has_weight = graph.edge_type == "map"
    walk = written(graph.both_ways(*(["weight"] if has_weight else [])).withColumn("weight", F.col("weight").cast("double") if has_weight else F.lit(1.0)).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "edges")
    at = written(graph.nodes.select(F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("k"), "id").select(F.xxhash64("id", "k").alias("wid"), F.lit(None).cast("long").alias("prev"), F.col("id").alias("cur")), "walks")
    parts = [at.select("wid", F.lit(0).alias("step"), F.col("cur").alias("id"))]
    close = walk.select(F.col("src").alias("prev"), "dst", F.lit(True).alias("near"))
    for step in range(1, length):
        u = (F.shiftrightunsigned(F.xxhash64("wid", F.lit(step), "dst", F.lit(seed)), 11) + 1) / F.lit(float((1 << 53) + 1))
        bias = F.when(F.col("prev").isNull(), 1.0).when(F.col("dst") == F.col("prev"), 1.0 / p).when(F.col("near"), 1.0).otherwise(1.0 / q) * F.col("weight")
        options = at.join(walk.withColumnRenamed("src", "cur"), "cur").join(close, ["prev", "dst"], "left")
        at = written(options.groupBy("wid").agg(F.min(F.struct((-F.log(u) / bias).alias("t"), F.col("dst"), F.col("cur"))).alias("b")).select("wid", F.col("b.cur").alias("prev"), F.col("b.dst").alias("cur")), "walks")
        parts.append(at.select("wid", F.lit(step).alias("step"), F.col("cur").alias("id")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@algorithm("embedding.train.node2vec")
def node2vec(graph: Graph, p: float = 1.0, q: float = 1.0, walks_per_node: int = 8, walk_length: int = 8, embedding_size: int = 16, epochs: int = 1, learning_rate: float = 0.025, seed: int = 0) -> tuple[Matrix, NodeMap]:
    """Skip-gram vectors of biased walks, trained in a part for each 100,000 of them (64 at most) whose vectors are
    averaged. ValueError beyond 5 million nodes, whose vectors the trainer would hold on the driver."""
    from pyspark.ml.feature import Word2Vec

    sentences = walks(graph, p, q, walks_per_node, walk_length, seed).groupBy("wid").agg(F.expr("transform(array_sort(collect_list(struct(step, id))), x -> cast(x.id as string))").alias("words"))
    sentences = written(sentences, "sentences")
    n = sentences.count()
    if graph.nodes.count() > MOST_NODES:
        raise ValueError(f"the vectors of at most {MOST_NODES} nodes fit the driver that trains them")
    model = Word2Vec(vectorSize=embedding_size, minCount=0, maxIter=max(epochs, 1), stepSize=learning_rate, windowSize=5, numPartitions=max(1, min(n // ROWS_A_PART, 64)), seed=seed, inputCol="words", outputCol="v").fit(sentences)
    from pyspark.ml.functions import vector_to_array

    return _numbered(model.getVectors().select(F.col("word").cast("long").alias("id"), vector_to_array("vector").alias("vec")), "vec")


@algorithm("embedding.train.graph2vec")
def graph2vec(graphs: list, subgraph_degree: int = 2, embedding_size: int = 16, epochs: int = 1, learning_rate: float = 0.025) -> Matrix:
    """A row for each graph of the list: TF-IDF of Weisfeiler-Lehman labels up to subgraph_degree rounds, reduced by the
    spectrum of the Gram matrix, whose size is that of the list. epochs and learning_rate don't apply."""
    edges = nodes = None
    for k, g in enumerate(graphs):
        e, n = g.both_ways().select(F.lit(k).alias("g"), "src", "dst"), degrees(g).select(F.lit(k).alias("g"), "id", F.col("value").alias("label"))
        edges, nodes = (e, n) if edges is None else (edges.union(e), nodes.union(n))
    edges, state = written(edges, "edges"), written(nodes, "wl")
    bag = state.select("g", F.xxhash64(F.lit(0), "label").alias("w"))
    for depth in range(1, subgraph_degree + 1):
        near = edges.join(state.select("g", F.col("id").alias("dst"), "label"), ["g", "dst"]).groupBy("g", F.col("src").alias("id")).agg(F.sum(F.xxhash64("label").cast("decimal(38,0)")).alias("s"))
        state = written(state.join(near, ["g", "id"], "left").select("g", "id", F.xxhash64("label", F.coalesce(F.col("s").cast("string"), F.lit("-"))).alias("label")), "wl")
        bag = bag.union(state.select("g", F.xxhash64(F.lit(depth), "label").alias("w")))
    tf = written(bag.groupBy("g", "w").agg(F.count("*").alias("n")), "wl-counts")
    idf = tf.groupBy("w").agg((F.log(F.lit(float(len(graphs) + 1)) / F.count("*")) + 1e-3).alias("idf"))
    weighted = tf.join(idf, "w").select("g", "w", (F.log1p("n") * F.col("idf")).alias("x"))
    dot = weighted.select(F.col("g").alias("a"), "w", F.col("x").alias("xa")).join(weighted.select(F.col("g").alias("b"), "w", F.col("x").alias("xb")), "w").groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("s"))
    gram = np.zeros((len(graphs), len(graphs)))
    for a, b, s in dot.toLocalIterator():  # the list's length squared
        gram[a, b] = s
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-12))
    value, vector = np.linalg.eigh(gram / scale[:, None] / scale[None, :])
    top = np.argsort(-value)[:embedding_size]
    out = np.zeros((len(graphs), embedding_size))
    out[:, : len(top)] = vector[:, top] * np.sqrt(np.maximum(value[top], 0))
    spark = edges.sparkSession
    return Matrix(spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(out)], "row long, values array<double>"))


@algorithm("embedding.train.graphwave", graph={"is_directed": False})
def graphwave(graph: Graph, scales: Vector, sample_point_count: int = 10, sample_point_max: float = 100.0, chebyshev_degree: int = 10) -> tuple[Matrix, NodeMap]:
    """Of each node the characteristic function of its heat wavelet's values, real and imaginary, at sample points for
    each scale. Wavelets are Chebyshev sums of the normalised Laplacian, all nodes at once as (source, node, value)."""
    n = graph.nodes.count()
    taus = [float(x) for x in scales.to_list()]
    deg = degrees(graph).select("id", F.greatest(F.col("value"), F.lit(1)).alias("d"))
    ds, dd = deg.select(F.col("id").alias("src"), F.col("d").alias("ds")), deg.select(F.col("id").alias("dst"), F.col("d").alias("dd"))
    # the Laplacian's spectrum lies in 0..2; shifted by one it is minus the normalised adjacency
    op = written(graph.both_ways().distinct().join(ds, "src").join(dd, "dst").select("src", "dst", (-1.0 / F.sqrt(F.col("ds") * F.col("dd"))).alias("a")), "laplacian")
    theta = (np.arange(200) + 0.5) * np.pi / 200
    coefficient = [[float(2 / 200 * (np.exp(-t * (np.cos(theta) + 1)) * np.cos(k * theta)).sum()) for k in range(chebyshev_degree + 1)] for t in taus]
    before = None
    now = written(graph.nodes.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("x")), "chebyshev")
    total = now.select("s", "id", *[(F.col("x") * c[0] / 2).alias(f"w{i}") for i, c in enumerate(coefficient)])
    for k in range(1, chebyshev_degree + 1):
        step = now.join(op.select(F.col("src").alias("id"), "dst", "a"), "id").groupBy("s", F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("a") * (1 if k == 1 else 2)).alias("x"))
        if before is not None:
            step = step.unionByName(before.select("s", "id", (-F.col("x")).alias("x"))).groupBy("s", "id").agg(F.sum("x").alias("x"))
        before, now = now, written(step, "chebyshev")
        total = total.unionByName(now.select("s", "id", *[(F.col("x") * c[k]).alias(f"w{i}") for i, c in enumerate(coefficient)]))
    wave = written(total.groupBy("s", "id").agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(taus))]), "wavelets")
    points = [float(x) for x in np.linspace(0, sample_point_max, sample_point_count)]
    aggs = []
    for i in range(len(taus)):
        for t in points:  # nodes that the wavelet doesn't reach have the value 0: cos 1, sin 0
            aggs += [((F.sum(F.cos(F.col(f"w{i}") * t)) + n - F.count("*")) / n), F.sum(F.sin(F.col(f"w{i}") * t)) / n]
    return _numbered(wave.groupBy(F.col("s").alias("id")).agg(F.array(*aggs).alias("vec")), "vec")


def _times(edges: DataFrame, state: DataFrame, cols: list[str], nodes: DataFrame, scale: float) -> DataFrame:
    """scale times the weighted adjacency times a matrix of columns, rows by id."""
    got = edges.join(state.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*[(F.sum(F.col("weight") * F.col(c)) * scale).alias(c) for c in cols])
    return written(nodes.join(got, "id", "left").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols]), "block")


def _katz_times(edges: DataFrame, state: DataFrame, cols: list[str], nodes: DataFrame, beta: float, terms: int) -> DataFrame:
    """(sum of (beta A)^k for k from 1 to terms) times a matrix."""
    total, now = None, state
    for _ in range(terms):
        now = _times(edges, now, cols, nodes, beta)
        total = now if total is None else total.unionByName(now)
    return written(total.groupBy("id").agg(*[F.sum(c).alias(c) for c in cols]), "katz")


def _gram(x: DataFrame, cols: list[str]) -> np.ndarray:
    """x' x, of as many rows and columns as there are columns."""
    row = x.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]]).first()
    out = np.zeros((len(cols), len(cols)))
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            out[i, j] = out[j, i] = row[f"{a}_{cols[j]}"] or 0.0
    return out


def _right(x: DataFrame, cols: list[str], m: np.ndarray, names: list[str]) -> DataFrame:
    """x times a small matrix."""
    return x.select("id", *[sum((F.col(c) * float(m[i, j]) for i, c in enumerate(cols)), F.lit(0.0)).alias(name) for j, name in enumerate(names)])


@algorithm("embedding.train.hope.katz", graph={"edge_type": "map", "is_directed": True})
def hope_katz(graph: Graph, embedding_size: int = 16, beta: float = 0.1, terms: int = 8, seed: int = 0) -> tuple[Matrix, NodeMap]:
    """Source and target halves of the Katz proximity's leading singular vectors, by randomised projection: only
    products of the sparse adjacency with thin blocks and small Gram matrices are needed."""
    half = max(embedding_size // 2, 1)
    n = graph.nodes.count()
    wide = min(half + 4, max(n, 1))
    cols = [f"c{j}" for j in range(wide)]
    nodes = written(graph.nodes.select("id"), "nodes")
    forth = written(graph.edges.select("src", "dst", F.col("weight").cast("double").alias("weight")), "edges")
    back = forth.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")

    def orthonormal(y: DataFrame) -> DataFrame:
        value, vector = np.linalg.eigh(_gram(y, cols))
        keep = np.where(value > 1e-12 * max(value.max(), 1e-300), 1 / np.sqrt(np.maximum(value, 1e-300)), 0.0)
        return written(_right(y, cols, vector * keep[None, :], cols), "basis")

    start = nodes.select("id", *[(F.shiftrightunsigned(F.xxhash64("id", F.lit(j), F.lit(seed)), 11) / float(1 << 52) - 1.0).alias(c) for j, c in enumerate(cols)])
    basis = orthonormal(_katz_times(forth, start, cols, nodes, beta, terms))
    for _ in range(2):
        basis = orthonormal(_katz_times(forth, orthonormal(_katz_times(back, basis, cols, nodes, beta, terms)), cols, nodes, beta, terms))
    right = _katz_times(back, basis, cols, nodes, beta, terms)
    value, vector = np.linalg.eigh(_gram(right, cols))
    top = np.argsort(-value)[:half]
    sigma = np.sqrt(np.maximum(value[top], 1e-300))
    names_s, names_t = [f"s{j}" for j in range(len(top))], [f"t{j}" for j in range(len(top))]
    source = _right(basis, cols, vector[:, top] * np.sqrt(sigma)[None, :], names_s)
    target = _right(right, cols, vector[:, top] / np.sqrt(sigma)[None, :], names_t)
    pad = [F.lit(0.0)] * (half - len(top))
    return _numbered(source.join(target, "id").select("id", F.array(*names_s, *pad, *names_t, *pad).alias("vec")), "vec")


class GraphSageNodeEmbedding:
    """Trained weights of the mean aggregator, a matrix for each layer."""

    def __init__(self, weights: list[np.ndarray], samples: list[int]) -> None:
        self.weights, self.samples = weights, samples


def _features(node_features: Matrix, node2row: NodeMap) -> DataFrame:
    return node2row.df.select("id", F.col("value").alias("row")).join(node_features.df, "row").select("id", F.col("values").alias("h"))


def _sampled(graph: Graph, k: int, seed: int) -> DataFrame:
    """(src, dst): at most k neighbours of each node, those of least hash; partial top-k runs before the shuffle."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("src").orderBy(F.xxhash64("src", "dst", F.lit(seed)), "dst")
    return graph.both_ways().distinct().withColumn("n", F.row_number().over(by)).where(F.col("n") <= k).select("src", "dst")


@algorithm("embedding.apply.graph_sage")
def apply_graph_sage(embedding: GraphSageNodeEmbedding, graph: Graph, node_features: Matrix, node2row: NodeMap, seed: int = 0) -> Matrix:
    """A row for each row of node_features: the vectors of nodes of any graph by trained weights."""
    state = written(_features(node_features, node2row), "sage")
    for layer, w in enumerate(embedding.weights):
        width = w.shape[0] // 2
        near = _sampled(graph, embedding.samples[layer], seed).join(state.select(F.col("id").alias("dst"), "h"), "dst").groupBy(F.col("src").alias("id")).agg(F.array(*[F.avg(F.element_at("h", j + 1)) for j in range(width)]).alias("m"))
        both = state.join(near, "id", "left").select("id", F.concat("h", F.coalesce("m", F.array(*[F.lit(0.0)] * width))).alias("x"))
        last = layer == len(embedding.weights) - 1

        def forward(batches, w=w, last=last):
            for pdf in batches:
                y = np.array(pdf["x"].tolist()).reshape(-1, w.shape[0]) @ w
                y = y if last else np.maximum(y, 0)
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"id": pdf["id"], "h": list(y)})

        state = written(both.mapInPandas(forward, "id long, h array<double>"), "sage")
    rows = node2row.df.select("id", F.col("value").alias("row")).join(state, "id")
    return Matrix(rows, values="h")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@algorithm("embedding.train.graph_sage.mean")
def train_graph_sage(graph: Graph, node_features: Matrix, node2row: NodeMap, walk_length: int = 4, walks_per_node: int = 4, layer_sizes: Vector | list | None = None, samples_per_layer: Vector | list | None = None, epochs: int = 20, learning_rate: float = 0.05, batch_size: int = 512, seed: int = 0) -> GraphSageNodeEmbedding:
    """Weights of mean aggregators, trained so that nodes on a common walk are alike and others not. Walks and samples
    are made in Spark; the gradient steps run in one task, behind a size check."""
    sizes = [int(x) for x in (layer_sizes.to_list() if isinstance(layer_sizes, Vector) else layer_sizes or [16, 16])]
    samples = [int(x) for x in (samples_per_layer.to_list() if isinstance(samples_per_layer, Vector) else samples_per_layer or [10] * len(sizes))]
    steps = written(walks(graph, 1.0, 1.0, walks_per_node, walk_length, seed), "walks")
    pairs = steps.alias("a").join(steps.alias("b"), F.expr("a.wid = b.wid and a.step < b.step and a.id != b.id")).select(F.lit(0).alias("kind"), F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.lit(None).cast("array<double>").alias("h"))
    near = _sampled(graph, max(samples), seed).select(F.lit(1).alias("kind"), "src", "dst", F.lit(None).cast("array<double>").alias("h"))
    own = _features(node_features, node2row).select(F.lit(2).alias("kind"), F.col("id").alias("src"), F.col("id").alias("dst"), "h")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        feats = pdf[pdf.kind == 2].sort_values("src")
        ids, x0 = feats.src.to_numpy(), np.array(feats.h.tolist())
        e, pr = pdf[pdf.kind == 1], pdf[pdf.kind == 0].sort_values(["src", "dst"])
        a, b = np.searchsorted(ids, e.src.to_numpy()), np.searchsorted(ids, e.dst.to_numpy())
        u, v = np.searchsorted(ids, pr.src.to_numpy()), np.searchsorted(ids, pr.dst.to_numpy())
        count = np.maximum(np.bincount(a, minlength=len(ids)), 1)[:, None]
        dims = [x0.shape[1], *sizes]
        w = [rng.normal(0, np.sqrt(1 / dims[k]), (2 * dims[k], dims[k + 1])) for k in range(len(sizes))]

        def mean(h: np.ndarray) -> np.ndarray:
            out = np.zeros_like(h)
            np.add.at(out, a, h[b])
            return out / count

        for _ in range(epochs):
            h, kept = x0, []
            for k, m in enumerate(w):
                x = np.hstack([h, mean(h)])
                y = x @ m
                z = y if k == len(w) - 1 else np.maximum(y, 0)
                norm = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                kept.append((x, y, norm))
                h = z / norm
            g = np.zeros_like(h)
            if len(u):
                for at in range(0, len(u), batch_size):
                    i, j = u[at : at + batch_size], v[at : at + batch_size]
                    r = rng.integers(0, len(ids), len(i))
                    up, down = (_sigmoid((h[i] * h[j]).sum(1)) - 1)[:, None], _sigmoid((h[i] * h[r]).sum(1))[:, None]
                    np.add.at(g, i, up * h[j] + down * h[r])
                    np.add.at(g, j, up * h[i])
                    np.add.at(g, r, down * h[i])
                g /= len(u)
            for k in range(len(w) - 1, -1, -1):
                x, y, norm = kept[k]
                z = (y if k == len(w) - 1 else np.maximum(y, 0)) / norm
                g = (g - z * (g * z).sum(1, keepdims=True)) / norm
                if k < len(w) - 1:
                    g = g * (y > 0)
                step, gx = x.T @ g, g @ w[k].T
                w[k] = w[k] - learning_rate * len(ids) ** 0.5 * step
                d = x.shape[1] // 2
                back = np.zeros((len(ids), d))
                np.add.at(back, b, (gx[:, d:] / count)[a])
                g = gx[:, :d] + back
        return pd.DataFrame({"layer": range(len(w)), "rows": [m.shape[0] for m in w], "values": [m.ravel().tolist() for m in w]})

    found = in_one_task(pairs.unionByName(near).unionByName(own), train, "layer int, rows int, values array<double>")
    weights = [np.array(r["values"]).reshape(r["rows"], -1) for r in found.orderBy("layer").collect()]  # a row a layer
    return GraphSageNodeEmbedding(weights, samples)


@algorithm("embedding.train.line")
def line(graph: Graph, walks_per_node: int = 10, negative_sample_count: int = 5, embedding_size: int = 16, epochs: int = 20, learning_rate: float = 0.05, batch_size: int = 256, seed: int = 0) -> tuple[Matrix, NodeMap]:
    """First- and second-order proximity, half of the vector each, by sampled edges with negative samples; in one task,
    behind a size check. walks_per_node times the nodes edges are drawn in an epoch."""
    half = max(embedding_size // 2, 1)
    weight = F.col("weight").cast("double") if graph.edge_type == "map" else F.lit(1.0)
    arcs = (graph.both_ways("weight") if graph.edge_type == "map" else graph.both_ways()).select("src", "dst", weight.alias("w"))
    rows = arcs.unionByName(graph.nodes.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("w")))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        ids = np.sort(pdf.loc[pdf.dst.isna(), "src"].to_numpy().astype(np.int64))
        e = pdf[pdf.dst.notna()].sort_values(["src", "dst"])
        a, b, w = np.searchsorted(ids, e.src.to_numpy().astype(np.int64)), np.searchsorted(ids, e.dst.to_numpy().astype(np.int64)), np.abs(e.w.to_numpy())
        n, parts = len(ids), []
        noise = np.bincount(b, minlength=n).astype(float) ** 0.75 + 1e-9
        noise, share = noise / noise.sum(), w / w.sum() if len(w) and w.sum() else None
        for order in (1, 2):
            x = rng.normal(0, 0.1, (n, half))
            y = x if order == 1 else np.zeros((n, half))
            for epoch in range(epochs if len(a) else 0):
                draws, rate = rng.choice(len(a), max(walks_per_node * n, 1), p=share), learning_rate * (1 - epoch / epochs) + 1e-4
                for at in range(0, len(draws), batch_size):
                    d = draws[at : at + batch_size]
                    u = np.repeat(a[d], 1 + negative_sample_count)
                    t = np.column_stack([b[d], rng.choice(n, (len(d), negative_sample_count), p=noise)]).ravel()
                    aim = np.tile(np.r_[1.0, np.zeros(negative_sample_count)], len(d))
                    g = (rate * (aim - _sigmoid((x[u] * y[t]).sum(1))))[:, None]
                    gx, gy = g * y[t], g * x[u]
                    np.add.at(x, u, gx)
                    np.add.at(y, t, gy)
            parts.append(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
        out = np.hstack(parts)
        return pd.DataFrame({"id": ids, "vec": list(out)})

    return _numbered(in_one_task(rows, train, "id long, vec array<double>"), "vec")
