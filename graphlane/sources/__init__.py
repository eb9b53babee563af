"""Readers and writers of edges, graphs and sparse matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlane.types import EdgeMap, EdgeSet, Graph, NodeMap, NodeSet

FORMATS = ("parquet", "orc", "json", "csv")


def read_edges(spark: SparkSession, path: str, format: str = "parquet", src: str = "source", dst: str = "target", weight: str | None = "weight", is_directed: bool = True, **options) -> EdgeMap | EdgeSet:
    """Edges from files of any of Spark's formats; weight None reads an edge set. Only the needed columns are read."""
    df = spark.read.format(format).options(**options).load(path)
    return EdgeSet(df, src, dst, is_directed) if weight is None else EdgeMap(df, src, dst, weight, is_directed)


def write_edges(edges: EdgeMap | EdgeSet, path: str, format: str = "parquet", mode: str = "errorifexists", **options) -> None:
    edges.df.write.format(format).mode(mode).options(**options).save(path)


def write_graph(graph: Graph, path: str, mode: str = "errorifexists") -> None:
    """Two Parquet tables, nodes and edges, under a folder."""
    graph.nodes.write.mode(mode).parquet(f"{path}/nodes")
    graph.edges.write.mode(mode).parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, is_directed: bool = True) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), is_directed)


def coo_to_csr(coo: DataFrame, shape: tuple[int, int], row: str = "row", col: str = "col", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(entries, pointers) of a sparse matrix: entries (row, col, value, at) in row order, each place once, and
    pointers (row, start) for rows 0 to shape[0]. ValueError if an entry is outside the shape.

    Rows are range-partitioned, so partitions hold disjoint rows; pointers are running sums of row counts."""
    from graphlane.plans.ordering import positions
    from graphlane.plans.tables import written

    entries = coo.select(F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"), F.col(value).alias("value"))
    ends = entries.agg(F.min("row"), F.min("col"), F.max("row"), F.max("col")).first()
    if ends[0] is not None and (min(ends[0], ends[1]) < 0 or ends[2] >= shape[0] or ends[3] >= shape[1]):
        raise ValueError(f"entries outside the shape {shape}")
    placed = written(positions(entries.dropDuplicates(["row", "col"]), F.col("row"), F.col("col"), pos="at"), "csr")
    spark = coo.sparkSession
    first = placed.groupBy("row").agg(F.count("*").alias("n"))
    step = spark.range(shape[0] + 1).select(F.col("id").alias("row")).join(first, "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))
    # running sums by blocks of rows: no window over all rows
    blocked = step.withColumn("block", F.expr("row div 65536"))
    totals = blocked.groupBy("block").agg(F.sum("n").alias("t"))
    ahead = totals.select("block", (F.sum("t").over(Window.orderBy("block")) - F.col("t")).alias("ahead"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("row")) - F.col("n")
    pointers = blocked.withColumn("inside", inside).join(ahead, "block").select("row", (F.col("ahead") + F.col("inside")).cast("long").alias("start"))
    return placed, pointers


def from_pandas_edges(spark: SparkSession, pdf, src: str = "source", dst: str = "target", weight: str | None = "weight", is_directed: bool = True) -> EdgeMap | EdgeSet:
    df = spark.createDataFrame(pdf)
    return EdgeSet(df, src, dst, is_directed) if weight is None else EdgeMap(df, src, dst, weight, is_directed)


def node_map(spark: SparkSession, values: dict) -> NodeMap:
    kind = "boolean" if all(isinstance(v, bool) for v in values.values()) else "double" if any(isinstance(v, float) for v in values.values()) else "long"
    return NodeMap(spark.createDataFrame([(int(k), float(v) if kind == "double" else v) for k, v in values.items()], f"id long, value {kind}"))


def node_set(spark: SparkSession, ids) -> NodeSet:
    if any(isinstance(i, bool) or not isinstance(i, int) for i in ids):
        raise TypeError("node ids must be integers")
    return NodeSet(spark.createDataFrame([(i,) for i in ids], "id long"))
