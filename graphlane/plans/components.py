"""Connected components by contraction.

Each round every component that has an edge to a smaller label hooks to the smallest such label, chains of hooks are
shortened by pointer jumping, and edges are rewritten to labels; edges inside a component go. Components with an edge
at least halve in number each round, whatever the diameter. Joins read written tables on both sides, so adaptive
execution can split a label that holds a large share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.plans.tables import dropped, written


def _flat(hooks: DataFrame) -> DataFrame:
    """(r, p) with p a root: pointer jumping until no p is an r."""
    while True:
        up = hooks.select(F.col("r").alias("mid"), F.col("p").alias("top"))
        jumped = written(hooks.join(up, hooks["p"] == up["mid"], "left").select("r", F.coalesce("top", "p").alias("p"), F.col("top").isNotNull().alias("moved")), "hooks")
        dropped(hooks)
        if jumped.where("moved").limit(1).count() == 0:
            return jumped
        hooks = jumped


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(id, label) of every vertex that has an edge to another one; label is the least id of its component. Written;
    of each round's tables only the last ones stay."""
    pairs = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()
    live = written(pairs, "edges")
    vertices = live.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    labels = written(vertices.select("id", F.col("id").alias("label")), "labels")
    while live.limit(1).count():
        hooks = _flat(written(live.groupBy(F.col("y").alias("r")).agg(F.min("x").alias("p")), "hooks"))
        before, labels = labels, written(labels.join(hooks.select("r", "p"), labels["label"] == hooks["r"], "left").select("id", F.coalesce("p", "label").alias("label")), "labels")
        hx, hy = hooks.select(F.col("r").alias("rx"), F.col("p").alias("px")), hooks.select(F.col("r").alias("ry"), F.col("p").alias("py"))
        moved = live.join(hx, live["x"] == hx["rx"], "left").select(F.coalesce("px", "x").alias("x"), "y")
        moved = moved.join(hy, moved["y"] == hy["ry"], "left").select("x", F.coalesce("py", "y").alias("y"))
        last, live = live, written(moved.where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
        dropped(before, hooks, last)
    dropped(live)
    return labels


def relabelled(pairs: DataFrame, labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with columns la and lb, the labels of their ends; an end without a label is its own."""
    la, lb = labels.select(F.col("id").alias(a), F.col("label").alias("la")), labels.select(F.col("id").alias(b), F.col("label").alias("lb"))
    return pairs.join(la, a, "left").join(lb, b, "left").withColumns({"la": F.coalesce("la", a), "lb": F.coalesce("lb", b)})


def extended(labels: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """components of the edges that made labels and of more edges: only the components that these join are worked on."""
    joined = components(relabelled(edges, labels, a, b), "la", "lb")
    known = labels.join(joined.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    whole = written(known.unionByName(joined.join(labels.select("id"), "id", "left_anti")), "labels")
    dropped(joined)
    return whole
