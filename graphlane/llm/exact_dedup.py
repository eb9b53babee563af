"""Exact deduplication by Grace hashing.

Every map task deals its rows through a Grace hash: an open-addressing table that compares complete contents takes
rows until its budget is full; rows whose content it doesn't hold then go to spill files by the next bits of their
digest, and each file is dealt with in the same way, recursively, until its distinct contents fit. Copies of a text
that the table holds never reach a spill file, so a text that makes up a third of a corpus costs one entry. One row
for each content and task then goes by digest to a second Grace hash, which joins the classes of different tasks.
Nothing in the plan has a key with more rows than one map task read.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphlane.llm.common import text_or_empty, written

BLANKS = r"[\x20\x09-\x0D]+"
BUDGET = 96 << 20
FANOUT_BITS = 4
DIGEST_BITS = 64


class ContentTable:
    """Open addressing with linear probing; an entry is equal only if its complete content is."""

    def __init__(self) -> None:
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.classes: list[int] = []
        self.n_bytes = 0

    def find(self, h: int, content: bytes) -> int:
        """The entry's number, or the complement of the free slot where it belongs."""
        slots, mask, i = self.slots, self.mask, h & self.mask
        while (e := slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e
            i = (i + 1) & mask
        return ~i

    def add(self, slot: int, h: int, content: bytes, cls: int) -> None:
        self.slots[slot] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.classes.append(cls)
        self.n_bytes += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self.mask = 2 * len(self.slots) - 1
            self.slots = [-1] * (self.mask + 1)
            for e, x in enumerate(self.hashes):
                i = x & self.mask
                while self.slots[i] >= 0:
                    i = (i + 1) & self.mask
                self.slots[i] = e


class Spill:
    """Arrow files of a task, one for each value of the next digest bits, in the folder where Spark itself spills."""

    def __init__(self) -> None:
        base = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.dir = tempfile.mkdtemp(prefix="grace-", dir=base if base and os.path.isdir(base) else None)
        self.n = 0

    def open(self, schema: pa.Schema) -> tuple[str, pa.RecordBatchFileWriter]:
        self.n += 1
        path = f"{self.dir}/{self.n}"
        return path, pa.ipc.new_stream(path, schema)

    def close(self) -> None:
        shutil.rmtree(self.dir, ignore_errors=True)


def grace(batches: Iterator[pa.RecordBatch], text: str, digest: str, budget: int, next_class: list[int], spill: list, level: int = 0):
    """Yields (batch, classes, firsts): the class number of each row and whether the row brought its class in.

    The class of a row is that of the earlier row with the same complete content. Digests only choose slots and
    files; when all their bits are used, the table takes what is left."""
    held, files, last = ContentTable(), {}, (level + 1) * FANOUT_BITS > DIGEST_BITS
    for batch in batches:
        texts = batch.column(text).cast(pa.binary()).to_pylist()
        keep, classes, firsts, moved = [], [], [], {}
        for i, (content, d) in enumerate(zip(texts, batch.column(digest).to_pylist(), strict=True)):
            h = int(d[:16], 16)
            e = held.find(h, content)
            if e >= 0:
                keep.append(i), classes.append(held.classes[e]), firsts.append(False)
            elif last or held.n_bytes < budget:
                cls = next_class[0]
                next_class[0] += 1
                held.add(~e, h, content, cls)
                keep.append(i), classes.append(cls), firsts.append(True)
            else:
                moved.setdefault(h >> (DIGEST_BITS - (level + 1) * FANOUT_BITS) & ((1 << FANOUT_BITS) - 1), []).append(i)
        if keep:
            yield (batch if len(keep) == len(texts) else batch.take(pa.array(keep))), classes, firsts
        for part, rows in moved.items():
            if not spill:
                spill.append(Spill())
            if part not in files:
                files[part] = spill[0].open(batch.schema)
            files[part][1].write_batch(batch.take(pa.array(rows)))
    del held
    for path, writer in files.values():
        writer.close()
    for path, _ in files.values():
        with pa.ipc.open_stream(path) as reader:
            yield from grace(iter(reader), text, digest, budget, next_class, spill, level + 1)
        os.remove(path)


def classes_of(batches: Iterator[pa.RecordBatch], drop: list[str], budget: int) -> Iterator[pa.RecordBatch]:
    """Adds gl_task, gl_row, gl_cls and gl_first to a task's rows."""
    from pyspark import TaskContext

    task, row, spill = TaskContext.get().partitionId(), 0, []
    try:
        for batch, classes, firsts in grace(batches, "gl_norm", "gl_sha", budget, [0], spill):
            n = batch.num_rows
            kept = [c for c in batch.schema.names if c not in drop]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([task] * n, pa.int64()), pa.array(range(row, row + n), pa.int64()), pa.array(classes, pa.int64()), pa.array(firsts, pa.bool_())],
                [*kept, "gl_task", "gl_row", "gl_cls", "gl_first"],
            )
            row += n
    finally:
        for s in spill:
            s.close()


KEYS = [T.StructField("gl_task", T.LongType()), T.StructField("gl_row", T.LongType()), T.StructField("gl_cls", T.LongType()), T.StructField("gl_first", T.BooleanType())]


def normalised(text_col: str):
    return F.regexp_replace(text_or_empty(text_col), BLANKS, " ")


def _classified(df: DataFrame, id_col: str, text_col: str, budget: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their local class, as a written table, and (gl_task, gl_cls) with what holds for the whole class."""
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("gl_rec"), F.col(id_col).alias("gl_id"), normalised(text_col).alias("gl_norm"))
    rows = rows.withColumn("gl_sha", F.sha2(F.col("gl_norm").cast("binary"), 256))
    out = T.StructType([rows.schema["gl_rec"], rows.schema["gl_id"], rows.schema["gl_sha"], *KEYS])
    local = written(rows.mapInArrow(lambda it: classes_of(it, ["gl_norm"], budget), out), "exact-local")
    first = local.where("gl_first").select(F.col("gl_task").alias("a_task"), F.col("gl_cls").alias("a_cls"), normalised(f"gl_rec.{text_col}").alias("gl_norm"), "gl_sha")
    first = first.repartition("gl_sha")
    out = T.StructType([first.schema["a_task"], first.schema["a_cls"], *KEYS])
    # class numbers follow the order in which rows arrived, which another run of a lost task would change
    joined = written(first.mapInArrow(lambda it: classes_of(it, ["gl_norm", "gl_sha"], budget), out), "exact-classes").select(F.col("a_task").alias("gl_task"), F.col("a_cls").alias("gl_cls"), F.col("gl_task").alias("g_task"), F.col("gl_cls").alias("g_cls"))
    order = F.struct(F.col("gl_id").isNull().alias("no_id"), F.col("gl_id").alias("id"), F.col("gl_task").alias("task"), F.col("gl_row").alias("row"))
    stats = local.groupBy("gl_task", "gl_cls").agg(F.count("*").alias("n"), F.min(order).alias("best"))
    whole = Window.partitionBy("g_task", "g_cls")
    groups = joined.join(stats, ["gl_task", "gl_cls"]).select("gl_task", "gl_cls", F.sum("n").over(whole).alias("group_size"), F.min("best").over(whole).alias("best"))
    return local, groups


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after each run of blanks is one space; a null text counts as empty, so null and
    empty texts form one group. The row with the smallest id of a group is kept; a null id comes after all others, and
    of rows that tie in the id just one is kept. An empty table gives an empty result. Other columns are ignored.
    budget: bytes of distinct content that a task's table holds before it spills."""
    local, groups = _classified(df.select(F.col(id_col), F.col(text_col)), id_col, text_col, budget)
    kept = (F.col("best.task") == F.col("gl_task")) & (F.col("best.row") == F.col("gl_row"))
    return local.select("gl_id", "gl_sha", "gl_task", "gl_row", "gl_cls").join(groups, ["gl_task", "gl_cls"]).select(F.col("gl_id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("gl_sha").alias("text_sha256"))


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows of df that exact_dedup keeps, with all columns of df."""
    local, groups = _classified(df, id_col, text_col, budget)
    best = groups.select(F.col("best.task").alias("gl_task"), F.col("best.row").alias("gl_row")).distinct()
    return local.join(best, ["gl_task", "gl_row"], "left_semi").select("gl_rec.*")
