"""Global positions without a global task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlane.plans.tables import written


def positions(df: DataFrame, *order: Column, pos: str = "pos") -> DataFrame:
    """df with its row's place, from 0, in the given order: a range-partitioned sort and the row counts before each
    partition."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("gl_at", F.monotonically_increasing_id())
    placed = written(placed, "positions").withColumn("gl_part", F.expr("gl_at div 8589934592"))
    counts = placed.groupBy("gl_part").agg(F.count("*").alias("gl_n"))
    before = counts.select("gl_part", (F.sum("gl_n").over(Window.orderBy("gl_part")) - F.col("gl_n")).alias("gl_before"))  # a row a partition
    return placed.join(F.broadcast(before), "gl_part").withColumn(pos, F.col("gl_before") + F.col("gl_at") % 8589934592).drop("gl_at", "gl_part", "gl_before")
