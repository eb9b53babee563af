"""Conversions between representations, and equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlane.plans.ordering import positions
from graphlane.types import EdgeMap, EdgeSet, Graph, Matrix, NodeMap, NodeSet, Vector


def symmetrize(edges: EdgeMap | EdgeSet) -> EdgeMap | EdgeSet:
    """Undirected edges as directed ones in both directions, loops once."""
    columns = edges.df.columns
    back = edges.df.where("src != dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *columns[2:])
    df = edges.df if edges.is_directed else edges.df.unionByName(back)
    return _edges(df, True)


def canonicalize(edges: EdgeMap | EdgeSet) -> EdgeMap | EdgeSet:
    """Symmetric directed edges as undirected ones from the lower id. ValueError if they aren't symmetric."""
    if edges.is_directed:
        flipped = edges.df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *edges.df.columns[2:])
        if edges.df.exceptAll(flipped).limit(1).count():
            raise ValueError("edges aren't symmetric")
        return _edges(edges.df.where("src <= dst"), False)
    return _edges(edges.df.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *edges.df.columns[2:]), False)


def _edges(df: DataFrame, is_directed: bool) -> EdgeMap | EdgeSet:
    if "weight" in df.columns:
        return EdgeMap(df, "src", "dst", "weight", is_directed, check=False)
    return EdgeSet(df, "src", "dst", is_directed, check=False)


def reindex(graph: Graph) -> tuple[Graph, NodeMap]:
    """The graph with ids 0 to n - 1 in the order of the old ones, and the new id of each old one."""
    number = positions(graph.nodes.select("id"), F.col("id"), pos="value")
    ns, nd = number.select(F.col("id").alias("src"), F.col("value").alias("s")), number.select(F.col("id").alias("dst"), F.col("value").alias("d"))
    edges = graph.edges.join(ns, "src").join(nd, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), *graph.edges.columns[2:])
    nodes = graph.nodes.join(number.select("id", F.col("value").alias("new")), "id").select(F.col("new").alias("id"), *graph.nodes.columns[1:])
    return Graph(nodes, edges, graph.is_directed), NodeMap(number)


def from_mask(spark: SparkSession, mask, values=None) -> NodeSet | NodeMap:
    """The places where mask is true, with values if given."""
    on = [i for i, m in enumerate(mask) if m]
    if values is None:
        return NodeSet(spark.createDataFrame([(i,) for i in on], "id long"))
    import numpy as np

    kind = {"b": "boolean", "i": "long", "u": "long"}.get(np.asarray(values).dtype.kind, "double")
    return NodeMap(spark.createDataFrame([(i, np.asarray(values)[i].item()) for i in on], f"id long, value {kind}"))


def from_numpy(spark: SparkSession, a) -> Vector | Matrix:
    if a.ndim == 1:
        kind = {"b": "boolean", "i": "long", "u": "long"}.get(a.dtype.kind, "double")
        return Vector(spark.createDataFrame([(i, x.item()) for i, x in enumerate(a)], f"pos long, value {kind}"))
    return Matrix(spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(a)], "row long, values array<double>"))


def convert(x, to: str):
    """x as 'spark', 'pandas', 'dict', 'set', 'list' or 'numpy'; the last four and pandas bring it to the driver."""
    if isinstance(x, Graph):
        if to == "spark":
            return x.nodes, x.edges
        if to == "pandas":
            return x.nodes.toPandas(), x.edges.toPandas()
        raise ValueError(f"a graph can't become {to}")
    if to == "spark":
        return x.df
    if to == "pandas":
        return x.df.toPandas()
    if to == "dict" and isinstance(x, NodeMap):
        return {r[0]: r[1] for r in x.df.collect()}
    if to == "set" and isinstance(x, (NodeSet, NodeMap)):
        return {r[0] for r in x.df.select("id").collect()}
    if to in ("list", "numpy") and isinstance(x, Vector):
        import numpy as np

        return x.to_list() if to == "list" else np.array(x.to_list())
    if to == "numpy" and isinstance(x, Matrix):
        return x.to_numpy()
    raise ValueError(f"{type(x).__name__} can't become {to}")


def _same(a: DataFrame, b: DataFrame, keys: list[str], value: str | None, rel_tol: float, abs_tol: float) -> bool:
    joined = a.select(*keys, *([F.col(value).alias("va")] if value else []), F.lit(1).alias("ina")).join(b.select(*keys, *([F.col(value).alias("vb")] if value else []), F.lit(1).alias("inb")), keys, "full")
    wrong = F.col("ina").isNull() | F.col("inb").isNull()
    if value:
        if dict(a.dtypes)[value] in ("double", "float") or dict(b.dtypes)[value] in ("double", "float"):
            wrong |= F.abs(F.col("va") - F.col("vb")) > F.greatest(F.lit(abs_tol), rel_tol * F.greatest(F.abs("va"), F.abs("vb")))
        else:
            wrong |= F.col("va") != F.col("vb")
    return joined.where(wrong).limit(1).count() == 0


def assert_equal(a, b, rel_tol: float = 1e-9, abs_tol: float = 0.0) -> None:
    """AssertionError unless a and b are of one kind, agree in their properties, and hold the same: exactly for ids,
    integers and booleans, within tolerances for floats."""
    assert type(a) is type(b), f"{type(a).__name__} and {type(b).__name__}"
    if isinstance(a, Graph):
        assert a.is_directed == b.is_directed and a.node_type == b.node_type and a.edge_type == b.edge_type, f"{a.props()} and {b.props()}"
        ea, eb = (g.edges if g.is_directed else g.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *g.edges.columns[2:]) for g in (a, b))
        assert _same(a.nodes, b.nodes, ["id"], "value" if a.node_type == "map" else None, rel_tol, abs_tol), "nodes differ"
        assert _same(ea, eb, ["src", "dst"], "weight" if a.edge_type == "map" else None, rel_tol, abs_tol), "edges differ"
        return
    keys = {"NodeSet": ["id"], "NodeMap": ["id"], "EdgeSet": ["src", "dst"], "EdgeMap": ["src", "dst"], "Vector": ["pos"]}[type(a).__name__]
    value = {"NodeMap": "value", "EdgeMap": "weight", "Vector": "value"}.get(type(a).__name__)
    if hasattr(a, "is_directed"):
        assert a.is_directed == b.is_directed, "directedness differs"
    if value:
        assert dict(a.df.dtypes)[value] == dict(b.df.dtypes)[value], "value types differ"
    assert _same(a.df, b.df, keys, value, rel_tol, abs_tol), f"{type(a).__name__} objects differ"
