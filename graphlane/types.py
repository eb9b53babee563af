"""Graph data as DataFrames with fixed columns and explicit properties. All objects are immutable."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {T.BooleanType: "bool", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int", T.FloatType: "float", T.DoubleType: "float"}
_CASTS = {"bool": "boolean", "int": "long", "float": "double"}


def dtype_of(df: DataFrame, column: str) -> str:
    """int, float or bool; other types can't be values or weights."""
    kind = _KINDS.get(type(df.schema[column].dataType))
    if kind is None:
        raise TypeError(f"{column} has type {df.schema[column].dataType.simpleString()}; int, float or bool is needed")
    return kind


def _ids(df: DataFrame, column: str):
    if column not in df.columns:
        raise TypeError(f"no column {column}")
    if dtype_of(df, column) != "int":
        raise TypeError(f"{column} must hold integers")
    return F.col(column).cast("long")


def _values(df: DataFrame, column: str):
    if column not in df.columns:
        raise TypeError(f"no column {column}")
    return F.col(column).cast(_CASTS[dtype_of(df, column)])


class NodeSet:
    """Distinct integer ids: (id)."""

    def __init__(self, df: DataFrame, id: str = "id", unique: bool = False) -> None:
        df = df.select(_ids(df, id).alias("id"))
        self.df = df if unique else df.distinct()

    def __contains__(self, node: int) -> bool:
        return self.df.where(F.col("id") == node).limit(1).count() > 0

    def __len__(self) -> int:
        return self.df.count()


class NodeMap:
    """A value of one type for each id: (id, value). Ids that repeat raise TypeError where that is checked."""

    def __init__(self, df: DataFrame, id: str = "id", value: str = "value", check: bool = False) -> None:
        self.df = df.select(_ids(df, id).alias("id"), _values(df, value).alias("value"))
        if check and self.df.groupBy("id").count().where("count > 1").limit(1).count():
            raise TypeError("ids of a node map must be distinct")

    @property
    def dtype(self) -> str:
        return dtype_of(self.df, "value")

    def node_set(self) -> NodeSet:
        return NodeSet(self.df, unique=True)

    def __getitem__(self, nodes):
        """The value of a node, or those of a list of nodes in its order; KeyError for ids that it lacks."""
        wanted = list(nodes) if isinstance(nodes, (list, tuple)) else [nodes]
        found = {r[0]: r[1] for r in self.df.where(F.col("id").isin(wanted)).collect()}
        if missing := [n for n in wanted if n not in found]:
            raise KeyError(missing[0])
        return [found[n] for n in wanted] if isinstance(nodes, (list, tuple)) else found[nodes]

    def __contains__(self, node: int) -> bool:
        return self.df.where(F.col("id") == node).limit(1).count() > 0

    def __len__(self) -> int:
        return self.df.count()


class Vector:
    """Ordered values of one type: (pos, value), pos from 0."""

    def __init__(self, df: DataFrame, pos: str = "pos", value: str = "value") -> None:
        self.df = df.select(_ids(df, pos).alias("pos"), _values(df, value).alias("value"))

    @property
    def dtype(self) -> str:
        return dtype_of(self.df, "value")

    def to_list(self) -> list:
        return [r[0] for r in self.df.orderBy("pos").select("value").toLocalIterator()]


class Matrix:
    """Dense rows: (row, values)."""

    def __init__(self, df: DataFrame, row: str = "row", values: str = "values") -> None:
        self.df = df.select(_ids(df, row).alias("row"), F.col(values).cast("array<double>").alias("values"))

    def to_numpy(self):
        import numpy as np

        return np.array([r[0] for r in self.df.orderBy("row").select("values").toLocalIterator()])


class EdgeSet:
    """Edges without weights: (src, dst). Undirected edges are stored once, in either direction; loops are allowed."""

    def __init__(self, df: DataFrame, src: str = "source", dst: str = "target", is_directed: bool = True, check: bool = True) -> None:
        self.df, self.is_directed = df.select(_ids(df, src).alias("src"), _ids(df, dst).alias("dst")), is_directed
        _once(self.df, is_directed, check)


class EdgeMap:
    """Edges with weights: (src, dst, weight)."""

    def __init__(self, df: DataFrame, src: str = "source", dst: str = "target", weight: str = "weight", is_directed: bool = True, check: bool = True) -> None:
        self.df, self.is_directed = df.select(_ids(df, src).alias("src"), _ids(df, dst).alias("dst"), _values(df, weight).alias("weight")), is_directed
        _once(self.df, is_directed, check)

    @property
    def dtype(self) -> str:
        return dtype_of(self.df, "weight")

    @cached_property
    def has_negative_weights(self) -> bool | None:
        return _negative(self.df)

    def edge_set(self) -> EdgeSet:
        return EdgeSet(self.df, "src", "dst", self.is_directed, check=False)


def _negative(df: DataFrame) -> bool | None:
    if dtype_of(df, "weight") == "bool":
        return None
    least = df.agg(F.min("weight")).first()[0]
    return least is not None and least < 0


def _once(df: DataFrame, is_directed: bool, check: bool) -> None:
    if check and not is_directed:
        pairs = df.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        if pairs.groupBy("a", "b").count().where("count > 1").limit(1).count():
            raise ValueError("an undirected edge must be given once")


class Graph:
    """Nodes (id and maybe value) and edges (src, dst and maybe weight); nodes may lack edges.

    A single missing weight makes the edges a set, a single missing value the nodes."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, is_directed: bool = True, edge_has_negative_weights: bool | None = None) -> None:
        self.nodes = nodes.select(_ids(nodes, "id").alias("id"), *([_values(nodes, "value").alias("value")] if "value" in nodes.columns else []))
        self.edges = edges.select(_ids(edges, "src").alias("src"), _ids(edges, "dst").alias("dst"), *([_values(edges, "weight").alias("weight")] if "weight" in edges.columns else []))
        self.is_directed, self._negative = is_directed, edge_has_negative_weights

    @classmethod
    def from_edges(cls, edges: EdgeSet | EdgeMap, nodes: NodeSet | NodeMap | None = None) -> "Graph":
        """All endpoints and the given nodes; values of nodes that aren't given are missing, so then there are none."""
        ends = edges.df.select(F.explode(F.array("src", "dst")).alias("id"))
        if nodes is not None:
            ends = ends.union(nodes.df.select("id"))
        ids = ends.distinct()
        if isinstance(nodes, NodeMap):
            valued = ids.join(nodes.df, "id", "left")
            ids = ids if valued.where("value is null").limit(1).count() else valued
        df = edges.df
        if isinstance(edges, EdgeMap) and df.where("weight is null").limit(1).count():
            df = df.drop("weight")
        return cls(ids, df, edges.is_directed)

    @property
    def node_type(self) -> str:
        return "map" if "value" in self.nodes.columns else "set"

    @property
    def node_dtype(self) -> str | None:
        return dtype_of(self.nodes, "value") if self.node_type == "map" else None

    @property
    def edge_type(self) -> str:
        return "map" if "weight" in self.edges.columns else "set"

    @property
    def edge_dtype(self) -> str | None:
        return dtype_of(self.edges, "weight") if self.edge_type == "map" else None

    @cached_property
    def edge_has_negative_weights(self) -> bool | None:
        if self._negative is not None or self.edge_type == "set":
            return self._negative
        return _negative(self.edges)

    def props(self) -> dict:
        return {k: getattr(self, k) for k in ("is_directed", "node_type", "node_dtype", "edge_type", "edge_dtype", "edge_has_negative_weights")}

    def with_edges(self, edges: DataFrame) -> "Graph":
        return Graph(self.nodes, edges, self.is_directed)

    def node_set(self) -> NodeSet:
        return NodeSet(self.nodes, unique=True)

    def edge_set(self) -> EdgeSet:
        return EdgeSet(self.edges, "src", "dst", self.is_directed, check=False)

    def edge_map(self) -> EdgeMap:
        return EdgeMap(self.edges, "src", "dst", "weight", self.is_directed, check=False)

    def both_ways(self, *columns: str) -> DataFrame:
        """Edges that can be walked: as they are if directed, else each in both directions and loops once."""
        forth = self.edges.select("src", "dst", *columns)
        if self.is_directed:
            return forth
        return forth.unionByName(forth.where("src != dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *columns))

    def simple(self) -> DataFrame:
        """Distinct undirected edges (a, b), a < b, without loops."""
        return self.edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


class BipartiteGraph:
    """Two sets of nodes without a common one and undirected edges from the first (src) to the second (dst)."""

    def __init__(self, edges: EdgeSet | EdgeMap, nodes0: NodeSet | NodeMap | None = None, nodes1: NodeSet | NodeMap | None = None, check: bool = True) -> None:
        if edges.is_directed and check:
            raise TypeError("a bipartite graph is undirected")
        self.edges = edges.df
        self.parts = tuple(n.df if n is not None else edges.df.select(F.col(c).alias("id")).distinct() for n, c in ((nodes0, "src"), (nodes1, "dst")))
        if check:
            if self.parts[0].select("id").join(self.parts[1], "id", "left_semi").limit(1).count():
                raise ValueError("a node is in both parts")
            for part, column in zip(self.parts, ("src", "dst"), strict=True):
                if self.edges.join(part, self.edges[column] == part["id"], "left_anti").limit(1).count():
                    raise ValueError(f"{column} of an edge is not in its part")

    @property
    def edge_type(self) -> str:
        return "map" if "weight" in self.edges.columns else "set"


class NodeLabels:
    """A one-to-one relation of ids and labels: (id, label)."""

    def __init__(self, df: DataFrame, id: str = "id", label: str = "label", check: bool = True) -> None:
        self.df = df.select(_ids(df, id).alias("id"), F.col(label).alias("label"))
        if check:
            for c in ("id", "label"):
                if self.df.groupBy(c).count().where("count > 1").limit(1).count():
                    raise ValueError(f"{c} repeats")

    def _find(self, given: str, wanted: str, keys):
        many = isinstance(keys, (list, tuple))
        asked = list(keys) if many else [keys]
        found = {r[0]: r[1] for r in self.df.where(F.col(given).isin(asked)).select(given, wanted).collect()}
        for k in asked:
            if k not in found:
                raise KeyError(k)
        return [found[k] for k in asked] if many else found[keys]

    def __getitem__(self, ids):
        return self._find("id", "label", ids)

    def ids(self, labels):
        return self._find("label", "id", labels)

    def encode(self, df: DataFrame, *columns: str) -> DataFrame:
        """df with labels in the columns replaced by ids."""
        for c in columns:
            df = df.join(self.df.select(F.col("label").alias(c), F.col("id").alias(f"{c}__id")), c).drop(c).withColumnRenamed(f"{c}__id", c)
        return df
