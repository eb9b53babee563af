"""Classes of similar things from the sketch values that they share.

Things that share a value are candidates. First everything is compared with the least thing that it shares values with,
the one that it shares most with first; this links a group of any size at a cost in proportion to it. Then all other
candidates that no links connect are met: members of a value with several classes are dealt into blocks, and every pair of
different classes is compared, in one block, unless sizes, folded counts or an alignment of folded words prove it too far
apart. Members of a value that needs several blocks can be met by their rarest elements instead (see crowds and rarest),
which any two similar ones have in common.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.llm.common import dropped, written
from graphlane.llm.packed import met_in, once_each, press, repeated_values, unpress
from graphlane.plans.components import components, extended, relabelled

BLOCK = 256  # members of a value that one block holds
BAG = 1024  # counters that what a thing holds is folded into
HELD = 2048  # most words of a thing that go with it, folded to 16 bits; of longer ones only the counters do
CHUNK_ROWS = 4000
KEY_BITS = 24  # of the table that says which keys may be in a crowd; others than these are read in vain
SLOT_BITS = 18  # of the table of counts that elements are ordered by; elements that share a slot seem more frequent
RUN_BITS = 20  # of the table of counts of runs of two
PART_BITS = 14  # of a part of these tables
FEW = 16  # a run in a slot with no more than that many above twice the mean is rare
Verify = Callable[[DataFrame], DataFrame]
Close = Callable[[list[int], list[int]], bool]
Elements = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def counted(folded: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """What each thing holds (a row each), given by words of 16 bits that follow each other, in counters that stop at 255."""
    slot = np.repeat(np.arange(len(lens)) * BAG, lens) + folded.astype(np.int64) % BAG
    return np.minimum(np.bincount(slot, minlength=len(lens) * BAG), 255).astype(np.uint8).reshape(-1, BAG)


def held(h: np.ndarray) -> bytes:
    """What a thing holds, given by hashes in order: 16 bits of each, or the counters if there are more than HELD."""
    folded = (h >> np.uint64(32)).astype(np.uint16)
    return folded.tobytes() if len(h) <= HELD else counted(folded, np.array([len(h)])).tobytes()


class _Rows:
    """Members of a value that one task compares with others."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.key, self.of, self.other, self.size, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "class", "other", "size", "pos"))
        self.left_over = self.size - pos
        self.held = None if batch.column("held").null_count else batch.column("held").to_pylist()
        values = batch.column("values")
        if not values.null_count:
            self.row, self.value = np.repeat(np.arange(len(self.key)), pc.list_value_length(values).to_numpy(zero_copy_only=False)), values.flatten().to_numpy(zero_copy_only=False)

    @cached_property
    def counts(self) -> np.ndarray:
        out, short = np.empty((len(self.key), BAG), np.uint8), self.size <= HELD
        out[short] = counted(np.frombuffer(b"".join(x for x, ok in zip(self.held, short, strict=True) if ok), np.uint16), self.size[short])
        out[~short] = np.frombuffer(b"".join(x for x, ok in zip(self.held, short, strict=True) if not ok), np.uint8).reshape(-1, BAG)
        return out

    def words(self, row: int) -> list[int] | None:
        return np.frombuffer(self.held[row], np.uint16).tolist() if self.size[row] <= HELD else None

    def met_before(self, more: _Rows) -> np.ndarray:
        """Whether the rows (those of more: columns) share a value that is less than this one."""
        known = np.intersect1d(self.value, more.value)
        sides = []
        for x in (self, more):
            hit = np.isin(x.value, known)
            has = np.zeros((len(x.key), len(known)), np.float32)
            has[x.row[hit], np.searchsorted(known, x.value[hit])] = 1
            sides.append(has)
        return sides[0] @ sides[1].T > 0


def sharing(things: DataFrame) -> DataFrame:
    """(s, key, low) of every value s that at least two of things (key, sketch: 64-bit values as one binary) have; low
    is the least key that has it. Written."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                own = part.column(1).to_pylist()
                n = np.fromiter((len(x) // 8 for x in own), np.int64, len(own))
                values, key = np.frombuffer(b"".join(own), np.uint64), np.repeat(part.column(0).to_numpy(zero_copy_only=False), n)
                first, twice, same = once_each([values], [key])
                blobs = values[first].tobytes(), np.packbits(twice).tobytes(), press(key[first]), press(key), press(same)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs), pa.array([len(first)], pa.int64())], ["chunk", "v0", "twice", "p0", "keys", "same", "n"])
                chunk += 1

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, keys, same, met in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values, key, same = np.frombuffer(v, np.uint64), unpress(keys, np.int64), unpress(same, np.int64)
                at, (least,) = met_in(met, 1)
                low = np.full(len(values), -1, np.int64)
                low[at] = least
                hit = np.flatnonzero(low[same] >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(values[same[hit]].view(np.int64)), pa.array(key[hit]), pa.array(low[same[hit]])], ["s", "key", "low"])

    chunks = written(things.select("key", "sketch").mapInArrow(pack, "chunk long, v0 binary, twice binary, p0 binary, keys binary, same binary, n long"), "sketches")
    met = repeated_values(chunks, chunks.agg(F.sum("n")).first()[0] or 0, 1)
    found = written(chunks.join(met, "chunk").select("v0", "keys", "same", "met").mapInArrow(members, "s long, key long, low long"), "sharing")
    dropped(chunks)
    return found


def mixed(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (s, key and more) with their class, and s, members c and largest class main of values that join things of
    several classes. Written."""
    each = members.drop("low").join(labels.select(F.col("id").alias("key"), "label"), "key", "left").withColumn("class", F.coalesce("label", "key")).drop("label")
    each = written(each, "collision-classes")
    parts = each.groupBy("s", "class").agg(F.count("*").alias("n"))
    met = parts.groupBy("s").agg(F.sum("n").alias("c"), F.count("*").alias("classes"), F.max_by("class", "n").alias("main")).where("classes > 1")
    return each, written(met.select("s", "c", "main"), "collision-values")


def crowds(members: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """What mixed says of the values of several classes that more than block of members (s, key, low) have. Written."""
    large = members.groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") > block).select("s")
    each, met = mixed(members.join(large, "s", "left_semi"), labels)
    dropped(each)
    return met


def rarest(things: DataFrame, keys: DataFrame, bound: float, elements: Elements, runs: Elements | None = None) -> DataFrame:
    """(s, key, low) as sharing gives them, of the things in keys (key): s is one of the rarest elements of a thing.

    things: key and content; elements takes contents and returns the distinct elements of each, which follow each other,
    as 64-bit hashes, and how many each has. Two things of n elements at most, of which no more than bound * n are not
    those of the other, have one of their bound * n + 1 rarest in common, by whatever order all share; theirs goes by
    counts in a table of fixed size. things are read twice and nothing of them is dealt but these elements.

    runs returns the distinct runs of two elements in the same way, if no more than 2 * bound * n of them are not the
    other's (an edit spoils two; bound is 0.5 at most). A thing whose 2 * bound * n + 1 rarest runs are all rare meets by
    these alone. The others meet by their elements, and by those of their rarest runs that are rare, since things of the
    first kind hold no others among theirs."""
    kinds = [(elements, SLOT_BITS, bound), *([(runs, RUN_BITS, 2 * bound)] if runs else [])]
    bit = f"pmod(xxhash64(key), {1 << KEY_BITS})"
    words = keys.select(F.expr(bit).alias("bit")).groupBy(F.expr("shiftright(bit, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(1 << KEY_BITS >> 6, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    own = things.select("key", F.expr(bit).alias("bit"), "content")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        for batch in batches:
            bits = batch.column(1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(table[bits >> 6] >> (bits & 63) & 1)
            for at in range(0, len(hit), BLOCK):
                part = batch.take(pa.array(hit[at : at + BLOCK]))
                yield part.column(0).to_numpy(zero_copy_only=False), [made(part.column(2)) for made, _, _ in kinds]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << slots, np.int64) for _, slots, _ in kinds]
        for _, found in wanted(batches):
            for own, (g, _), (_, slots, _) in zip(counts, found, kinds, strict=True):
                own += np.bincount(_slot(g, slots), minlength=1 << slots)
        parts = np.concatenate(counts).reshape(-1, 1 << PART_BITS)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([press(parts[i]) for i in some], pa.binary())], ["part", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[part] = sums.get(part, 0) + unpress(blob, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([press(x) for x in sums.values()], pa.binary())], ["part", "counts"])

    counts = np.zeros((sum(1 << slots for _, slots, _ in kinds) >> PART_BITS, 1 << PART_BITS), np.int32)
    for row in own.mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(total, "part int, counts binary").collect():
        counts[row["part"]] = np.minimum(unpress(row["counts"], np.int64), 2**31 - 1)
    often = np.split(counts.ravel(), [1 << SLOT_BITS])[: len(kinds)]
    few = FEW + 2 * often[-1].mean(dtype=np.float64)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, found in wanted(batches):
            rows, picked, alone = [], [], np.zeros(len(key), bool)
            for (g, n), seen, (_, slots, share), by_runs in reversed(list(zip(found, often, kinds, (False, True)))):
                least = (share * n + 1e-9).astype(np.int64) + 1 if not by_runs else (share * (n + (n > 0)) + 1e-9).astype(np.int64) + 1  # n + 1 elements have n runs
                of, c = np.repeat(np.arange(len(n)), n), seen[_slot(g, slots)]
                order = np.lexsort((g, c, of))
                order = order[np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(least, n)]
                if by_runs:
                    rare = c[order] <= few
                    alone = (n >= least) & (np.bincount(of[order], ~rare, len(n)) == 0)
                    order = order[rare]
                else:
                    order = order[~alone[of[order]]]
                rows.append(of[order])
                picked.append(g[order])
            of, g = np.concatenate(rows), np.concatenate(picked)
            g = g[np.argsort(of, kind="stable")]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([x.tobytes() for x in np.split(g, np.cumsum(np.bincount(of, minlength=len(key)))[:-1])], pa.binary())], ["key", "sketch"])

    found = sharing(own.mapInArrow(pick, "key long, sketch binary"))
    return found.join(keys, "key", "left_semi").select("s", "key", "low")  # the table lets others than keys pass


def _slot(g: np.ndarray, bits: int) -> np.ndarray:
    return (g >> np.uint64(64 - bits)).astype(np.int64)


def collisions(members: DataFrame, things: DataFrame, labels: DataFrame, bound: float, close: Close | None = None, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b), a < b, of all things that share a value and that labels do not connect; things: key, size and
    held. Left out are only pairs that cannot be similar.

    members: s and key; pairs are left out whose sizes, or folded counts, differ by more than bound of the larger size, or
    whose folded words are not close; folding makes different words equal, never equal ones different. If members have
    pos, they are prefixes of sets, s a set's rarest elements and pos their places, from 0, among its elements by falling
    rarity; then things hold nothing, and pairs are left out that after places so far back have too few elements left for
    a Jaccard similarity of 1 - bound.

    A value's members are dealt into blocks by the hash of the key. Each is at home in one block, and those outside the
    value's largest class visit all its blocks if there are several, so that a large class costs a row a member. Without
    pos each brings its lesser values along, and a pair is met at the least value that it shares and nowhere else."""
    each, met = mixed(members, labels)
    values = met.select("s", F.ceil(F.col("c") / block).cast("int").alias("blocks"), "main")
    by_place = "pos" in members.columns
    most = 2 * (1 - bound) / (2 - bound)  # of the mean size: the least overlap
    if by_place:
        early = each.join(things.select("key", "size"), "key").where(F.col("pos") < F.col("size") - F.ceil(most * F.col("size") - 1e-9) + 1)
        values = values.join(early.select("s").distinct(), "s", "left_semi")  # the smaller one of a pair has it early on
    own = written(each.join(values, "s"), "collision-members")
    if by_place:
        known, pos = things.select("key", "size", F.lit(None).cast("binary").alias("held"), F.lit(None).cast("array<bigint>").alias("values")), "pos"
    else:
        known, pos = things.select("key", "size", "held").join(own.groupBy("key").agg(F.collect_list("s").alias("values")), "key"), F.lit(0).alias("pos")  # no more than a thing's sketches
    whole = written(own.join(known, "key").select("s", "key", "class", "blocks", "main", "size", "held", F.filter("values", lambda v: v < F.col("s")).alias("values"), pos), "collision-held")
    other = F.col("class") != F.col("main")
    homes = whole.select("s", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("visits"), "key", "class", other.alias("other"), "size", "held", "values", "pos", (F.col("blocks") == 1).alias("alone"))
    visitors = whole.where(other & (F.col("blocks") > 1)).select("s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visits"), "key", "class", F.lit(True).alias("other"), "size", "held", "values", "pos", F.lit(False).alias("alone"))
    dealt = homes.unionByName(visitors).repartition("s", "block").sortWithinPartitions("s", "block", "visits")

    def met_by(home: _Rows, rows: _Rows) -> tuple[np.ndarray, np.ndarray]:
        limit = bound * np.maximum(home.size[:, None], rows.size[None]) + 1e-9
        ok = (home.of[:, None] != rows.of[None]) & (~home.other[:, None] | (home.key[:, None] < rows.key[None])) & (np.abs(home.size[:, None] - rows.size[None]) <= limit)
        if by_place:
            ok &= np.minimum(home.left_over[:, None], rows.left_over[None]) >= most / 2 * (home.size[:, None] + rows.size[None]) - 1e-9
        elif ok.any():
            ok &= ~home.met_before(rows)
        x, y = np.nonzero(ok)
        if len(x) and not by_place:
            apart = (home.counts[x[j : j + 4096]].astype(np.int16) - rows.counts[y[j : j + 4096]] for j in range(0, len(x), 4096))
            far = np.concatenate([np.maximum(np.maximum(d, 0).sum(axis=1), np.maximum(-d, 0).sum(axis=1)) for d in apart])
            x, y = x[far <= limit[x, y]], y[far <= limit[x, y]]
        if len(x) and close:
            near = np.array([(a := home.words(i)) is None or (b := rows.words(j)) is None or close(a, b) for i, j in zip(x.tolist(), y.tolist(), strict=True)])
            x, y = x[near], y[near]
        return home.key[x], rows.key[y]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, home, guests = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            s, number, visits, other, alone = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "block", "visits", "other", "alone"))
            new = (s[1:] != s[:-1]) | (number[1:] != number[:-1]) | (visits[1:] != visits[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if at != (s[lo], number[lo]):
                    at, home, guests = (s[lo], number[lo]), [], []
                for i in range(lo, hi, block):
                    part = batch.slice(i, min(block, hi - i))
                    rows = _Rows(part)
                    if visits[lo]:
                        pairs += [met_by(x, rows) for x in home]
                        continue
                    if alone[lo]:  # nobody visits: those outside the largest class meet all at home
                        pairs += [met_by(rows, x) for x in guests]
                        if other[i : i + part.num_rows].any():
                            guests.append(_Rows(part.filter(pa.array(other[i : i + part.num_rows]))))
                            pairs += [met_by(x, guests[-1]) for x in [*home, rows]]
                    home.append(rows)
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    pairs = written(dealt.mapInArrow(meet, "a long, b long").distinct(), "collisions")
    dropped(each, met, own, whole)
    return pairs


def classes(members: DataFrame, verify: Verify, collide: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(id, label) of every thing with a link, label the least key of its class; members: what sharing says of their
    sketches.

    verify takes pairs (a, b) and returns, as a written table, those that are links. collide takes members and labels and
    returns, as a written table, the pairs that may be links beside those that labels connect (see collisions)."""
    stars = written(members.where("key != low").groupBy(F.col("low").alias("a"), F.col("key").alias("b")).agg(F.count("*").alias("n")), "stars")
    first = written(stars.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"), "stars-first")
    links = verify(first)
    first_label = components(links, "a", "b")
    rest = written(relabelled(stars.select("a", "b").join(first, ["a", "b"], "left_anti"), first_label).where("la != lb").select("a", "b"), "stars-rest")
    more = verify(rest)
    label = extended(first_label, more)
    left = collide(members, label)
    last = verify(left)
    whole = extended(label, last)
    dropped(first_label, label, stars, first, rest, left, links, more, last)
    return whole
