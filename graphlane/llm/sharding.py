"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame and SQL functions only.

Every shard has some virtual nodes on a ring of cells. A row falls on the cell of its id's hash and belongs to the
next virtual node clockwise; a shard takes no more than its load, and what it can't take continues clockwise to the
next other shard that has room. Rows of one arc, the stretch up to a virtual node, meet the same shards in the same
order, so how many rows of each arc end in each shard follows from the arcs' row counts alone: a table of fixed size
that a fold in SQL works out. A row then only needs its rank within its arc, which comes from ranks in small buckets and
the counts before them. A bucket is chosen by the id and by the task that read the row, so that rows without an id, or
with one and the same, are ranked in as many tasks as others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlane.llm.common import text_or_empty, written

CELLS = 4096
VNODES = 64
BUCKET_ROWS = 20_000


def ring(shards: int, vnodes: int) -> tuple[list[int], list[list[int]]]:
    """Of each cell the arc it lies in, and of each arc the shards in clockwise order. Constants of the two numbers."""
    points = sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % CELLS, hashlib.sha256(f"{s}/{v}".encode()).hexdigest(), s) for s in range(shards) for v in range(vnodes))
    arcs, at = [], 0
    for cell in range(CELLS):
        while at < len(points) and points[at][0] < cell:
            at += 1
        arcs.append(at % len(points))
    order = []
    for a in range(len(points)):
        seen: list[int] = []
        for k in range(len(points)):
            s = points[(a + k) % len(points)][2]
            if s not in seen:
                seen.append(s)
                if len(seen) == shards:
                    break
        order.append(seen)
    return arcs, order


def _ints(values: list[int]) -> str:
    return f"cast(split('{','.join(map(str, values))}', ',') as array<int>)"


def consistent_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, vnodes: int = VNODES) -> DataFrame:
    """One row for each row of df: id, size, text_crc32, law, shard, slot, grown_shard.

    The load bound is as tight as it can be (n / shards, one more for the first n mod shards), so the counts of any two
    shards differ by at most one: law 'rows'; grown_shard is null under that law. slot numbers the rows of a shard from
    0. A null text has size 1 and crc32 0; null ids share a place on the ring; of rows that repeat an id and text it
    doesn't show which is which. An empty table gives an empty result; other columns
    are ignored. Adding a shard moves what its own virtual nodes take over and what the lower bounds push on."""
    text = text_or_empty(text_col)
    read = df.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("gl_task"))
    df = written(read, "shard-rows")  # the tasks' numbers must be the same in both readings
    n = df.count()
    buckets = -(-n // BUCKET_ROWS) or 1
    arcs, order = ring(shards, vnodes)
    n_arcs, prefs = len(order), _ints([s for o in order for s in o])
    place = F.xxhash64(F.col(id_col))
    cell = F.pmod(F.shiftrightunsigned(place, 20), F.lit(CELLS))
    arc = F.element_at(F.expr(_ints(arcs)), (cell + 1).cast("int"))
    group = (arc.cast("long") * buckets + F.pmod(F.xxhash64(F.col(id_col), F.col("gl_task")), F.lit(buckets))).alias("grp")

    counts = df.select(group).groupBy("grp").agg(F.count("*").alias("n")).withColumn("arc", F.expr(f"grp div {buckets}").cast("int"))
    before = Window.partitionBy("arc").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("grp", "arc", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    totals = counts.groupBy("arc").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("arc", "n"))).alias("m"))
    state = totals.select(
        F.expr(f"transform(sequence(0, {n_arcs - 1}), a -> coalesce(m[a], 0L))").alias("cnt"),
        F.expr(f"transform(sequence(0, {shards - 1}), s -> cast({n // shards} + if(s < {n % shards}, 1, 0) as bigint))").alias("cap"),
        F.expr(prefs).alias("pref"),
    )
    wanted = f"pref[a * {shards} + r]"
    one_round = f"""aggregate(sequence(0, {n_arcs - 1}), named_struct('cap', st.cap, 'take', cast(array() as array<bigint>)), (x, a) -> named_struct(
        'cap', transform(x.cap, (c, s) -> if(s = {wanted}, c - least(c, st.rem[a]), c)),
        'take', concat(x.take, array(least(x.cap[{wanted}], st.rem[a])))))"""
    rounds = f"""aggregate(sequence(0, {shards - 1}), named_struct('cap', cap, 'rem', cnt, 'out', cast(array() as array<array<bigint>>)), (st, r) ->
        transform(array({one_round}), y -> named_struct('cap', y.cap, 'rem', zip_with(st.rem, y.take, (m, t) -> m - t), 'out', concat(st.out, array(y.take))))[0]).out"""
    taken = state.select(F.expr(rounds).alias("out"), "pref").select("pref", F.posexplode("out").alias("round", "takes")).select("pref", "round", F.posexplode("takes").alias("arc", "take")).where("take > 0")
    taken = taken.select("arc", "round", "take", F.expr(f"pref[arc * {shards} + round]").alias("shard"))
    lo = F.sum("take").over(Window.partitionBy("arc").orderBy("round")) - F.col("take")
    base = F.sum("take").over(Window.partitionBy("shard").orderBy("round", "arc")) - F.col("take")
    spans = taken.select(F.col("arc").alias("of_arc"), "shard", lo.alias("lo"), (lo + F.col("take")).alias("hi"), base.alias("base"))

    rows = df.select(id_col, "size", "text_crc32", group)
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy(id_col, "text_crc32", "size")))
    placed = ranked.join(offsets, "grp").withColumn("rank", F.col("before") + F.col("rn") - 1)
    # the spans have at most shards * arcs rows, whatever the data
    hit = (F.col("arc") == F.col("of_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return placed.join(F.broadcast(spans), hit).select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("rank") - F.col("lo")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
