"""Search for a node-induced match of one graph in another: of whole graphs by backtracking in one task, of a small graph
in a large one by joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.plans.local import in_one_task
from graphlane.plans.tables import dropped, written
from graphlane.types import Graph

#: Rows to which a slice of partial matches is extended at once.
SLICE = 1 << 24


def _adjacency(rows: pd.DataFrame, directed: bool) -> tuple[dict[int, set], dict[int, set]]:
    out: dict[int, set] = {int(n): set() for n in rows.loc[rows.dst.isna(), "src"]}
    into: dict[int, set] = {n: set() for n in out}
    for a, b in rows.loc[rows.dst.notna(), ["src", "dst"]].astype("int64").itertuples(index=False):
        for x, y in ((a, b),) if directed else ((a, b), (b, a)):
            out[x].add(y)
            into[y].add(x)
    return out, into


def _by_neighbours(out: dict[int, set], into: dict[int, set]) -> list[int]:
    """The nodes, those with earlier neighbours first."""
    order: list[int] = []
    seen: set[int] = set()
    while len(order) < len(out):
        rest = [n for n in out if n not in seen]
        n = max(rest, key=lambda x: (len((out[x] | into[x]) & seen), len(out[x]) + len(into[x]), -x))
        order.append(n)
        seen.add(n)
    return order


def find_match(small, large, whole: bool) -> bool:
    """Whether small's nodes can be sent to different nodes of large so that two are joined just if their images are."""
    (out_s, in_s), (out_l, in_l) = small, large
    if not out_s:
        return True
    order = _by_neighbours(out_s, in_s)
    fits = {n: [m for m in out_l if (n in out_s[n]) == (m in out_l[m]) and (len(out_s[n]) == len(out_l[m]) and len(in_s[n]) == len(in_l[m]) if whole else len(out_s[n]) <= len(out_l[m]) and len(in_s[n]) <= len(in_l[m]))] for n in order}
    image: dict[int, int] = {}
    used: set[int] = set()
    stack = [iter(fits[order[0]])]
    while stack:
        n = order[len(stack) - 1]
        if n in image:
            used.discard(image.pop(n))
        for m in stack[-1]:
            if m not in used and all((k in out_s[n]) == (image[k] in out_l[m]) and (k in in_s[n]) == (image[k] in in_l[m]) for k in image):
                image[n] = m
                used.add(m)
                break
        if n not in image:
            stack.pop()
        elif len(image) == len(order):
            return True
        else:
            stack.append(iter(fits[order[len(stack)]]))
    return False


def same_structure(small: Graph, large: Graph) -> bool:
    """Whether all of small and all of large match."""
    rows = None
    for which, g in ((0, small), (1, large)):
        own = g.nodes.select(F.lit(which).alias("which"), F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"))
        own = own.union(g.edges.select(F.lit(which), "src", "dst"))
        rows = own if rows is None else rows.union(own)
    directed = small.is_directed

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_adjacency(pdf[pdf.which == k], directed) for k in (0, 1)]
        return pd.DataFrame({"found": [find_match(*parts, True)]})

    found = in_one_task(rows, search, "found boolean", 1_000_000).first()
    return True if found is None else found[0]


def occurs(small: Graph, large: Graph) -> bool:
    """Whether small matches the part of large on some of its nodes. small comes to the driver.

    Partial matches (c0, c1, ...) are extended by a node at a time, over the edges of an earlier one where there is such
    an edge. They are taken by slices that grow to about SLICE rows, each to its end before the next one, so what is held
    at a time is bounded, and the first match ends the search; without one, all slices are gone through."""
    out = {r[0]: set() for r in small.nodes.select("id").collect()}
    into: dict[int, set] = {n: set() for n in out}
    for a, b in small.both_ways().distinct().collect():
        out[a].add(b)
        into[b].add(a)
    order = _by_neighbours(out, into)
    if not order:
        return True
    walk = written(large.both_ways().distinct(), "edges")
    nodes = large.nodes.select("id")
    degree = walk.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(walk.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    degree = written(degree.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")), "degrees")
    ways = (("src", "dst"), ("dst", "src")) if large.is_directed else (("src", "dst"),)

    def edge(own: str, other: str, way: tuple[str, str]) -> DataFrame:
        """Edges with the earlier node as own and the new one as other."""
        return walk.select(F.col(way[0]).alias(own), F.col(way[1]).alias(other))

    def looped(found: DataFrame, k: int) -> DataFrame:
        loops = walk.where("src = dst").select(F.col("src").alias(f"c{k}"))
        return found.join(loops, f"c{k}", "left_semi" if order[k] in out[order[k]] else "left_anti")

    def wanted(k: int) -> list[tuple[int, tuple[str, str], bool]]:
        """Of each earlier node and way whether there must be an edge."""
        return [(j, way, order[k] in (out if way[0] == "src" else into)[order[j]]) for j in range(k) for way in ways]

    def extended(held: DataFrame, k: int) -> DataFrame:
        checks = wanted(k)
        first = next((c for c in checks if c[2]), None)
        if first is None:
            found = held.crossJoin(nodes.withColumnRenamed("id", f"c{k}"))
        else:
            found = held.join(edge(f"c{first[0]}", f"c{k}", first[1]), f"c{first[0]}")
        for j in range(k):
            found = found.where(F.col(f"c{j}") != F.col(f"c{k}"))
        found = looped(found, k)
        for j, way, needed in checks:
            if (j, way, needed) != first:
                found = found.join(edge(f"c{j}", f"c{k}", way), [f"c{j}", f"c{k}"], "left_semi" if needed else "left_anti")
        return found.select(*[f"c{j}" for j in range(k + 1)])

    def growth(held: DataFrame, k: int) -> int:
        """The rows of held after its join with the edges or nodes of the next one."""
        first = next((c for c in wanted(k) if c[2]), None)
        if first is None:
            return held.count() * nodes.count()
        n = degree.select(F.col("id").alias(f"c{first[0]}"), F.col("o" if first[1][0] == "src" else "i").alias("n"))
        return held.join(n, f"c{first[0]}").agg(F.sum("n")).first()[0] or 0

    def search(held: DataFrame, k: int) -> bool:
        n = -(-growth(held, k) // SLICE)
        for at in range(n):
            part = held.where(F.pmod(F.xxhash64(F.lit(k), *held.columns), F.lit(n)) == at) if n > 1 else held
            found = extended(part, k)
            if k + 1 == len(order):
                if found.limit(1).count():
                    return True
                continue
            found = written(found, "matches")
            done = search(found, k + 1)
            dropped(found)
            if done:
                return True
        return False

    held = written(looped(nodes.withColumnRenamed("id", "c0"), 0), "matches")
    done = bool(held.limit(1).count()) if len(order) == 1 else search(held, 1)
    dropped(walk, degree, held)
    return done
