"""Exact substring deduplication with a hash-compared suffix sort.

A window is a string of LENGTH bytes at some place; it goes if it also starts elsewhere. Windows are compared only
where they can be equal. Each window contains GRAM-byte strings at LENGTH - GRAM + 1 places, and the one with the least
hash is its anchor; equal windows have equal anchors at equal offsets. Successive windows with the same anchor form a
segment, so a text is a chain of segments, a few for each LENGTH bytes, and these are what is shuffled:

1. Segments whose anchor occurs once hold no repeated window.
2. Segments whose whole bytes occur twice (by a 128-bit BLAKE2 digest) are repeated from end to end.
3. What remains lies at the ends of repeats: different segments with one anchor. One segment of each content goes to
   its anchor's task, where the suffixes at all window starts are sorted: mergesort, comparing by the longest common
   extension, which binary search finds on prefix polynomial hashes. Neighbours that agree in LENGTH bytes are repeats,
   after their bytes have been compared. Suffixes with other anchors or offsets can't agree, so runs start from there.
4. An anchor with more than GROUP contents (a passage that very many texts embed) would make one task grow with the
   input. Its windows are counted by their own 128-bit digests, on packed arrays (graphlane.llm.packed): of each chunk of
   them a digest travels once.

Texts travel as compressed blobs, only those with repeats more than once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.llm.common import dropped, pieces_of, text_or_empty, type_of, written
from graphlane.llm.hashing import BASE, CODES, INVERSE, mix, powers
from graphlane.llm.packed import met_in, once_each, repeated_values, unpress
from graphlane.llm.packed import press as pack

LENGTH = 400
GRAM = 100
GROUP = 200
BLOCK = 1 << 20
CHUNK_WINDOWS = 1 << 17
PIECE = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)


class _Powers:
    """Powers of the base and of its inverse, as far as needed so far."""

    up, down = powers(1 << 16), powers(1 << 16, INVERSE)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            cls.up, cls.down = powers(2 * n), powers(2 * n, INVERSE)
        return cls.up, cls.down


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = the polynomial hash of raw[i:j] times base**i."""
    up, _ = _Powers.upto(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(CODES[raw] * up[: len(raw)], dtype=np.uint64, out=out[1:])
    return out


def segments(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each segment: the first window's start, the number of windows, the anchor's place and hash, and a hash of all
    bytes of the segment."""
    parts = []
    for at in range(0, max(len(raw) - length + 1, 0), PIECE):
        part = raw[at : at + PIECE + length - 1]
        h, w = prefix_hashes(part), length - gram + 1
        _, down = _Powers.upto(len(part) + 1)
        g = mix((h[gram:] - h[:-gram]) * down[: len(part) - gram + 1])
        key = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
        padded = np.full(-(-len(key) // w) * w, 2**64 - 1, np.uint64)
        padded[: len(key)] = key
        grid = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - length + 1
        least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
        start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        place = (least[start] & _PLACE).astype(np.int64)
        count = np.diff(np.append(start, n))
        parts.append((start + at, count, place + at, g[place], mix((h[start + count + length - 1] - h[start]) * down[start] + count.astype(np.uint64))))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Sorted distinct integers as runs (first, last)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True))


class SuffixSort:
    """Suffixes of a block of text, compared by hashes of their common extensions."""

    def __init__(self, raw: np.ndarray, length: int) -> None:
        self.raw, self.h, self.length = raw, prefix_hashes(raw), length
        self.up, _ = _Powers.upto(len(raw) + 1)

    def equal(self, x: np.ndarray, y: np.ndarray, n) -> np.ndarray:
        """Whether the n bytes at x and at y have the same hash."""
        return (self.h[x + n] - self.h[x]) * self.up[y] == (self.h[y + n] - self.h[y]) * self.up[x]

    def less(self, x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        """Whether the suffix at x sorts before that at y by their first length bytes; ties: or equals it."""
        out = np.full(len(x), ties)
        differ = np.flatnonzero(~self.equal(x, y, self.length))
        if not len(differ):
            return out
        a, b = x[differ], y[differ]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length - 1, np.int64)
        while (open_ := low < high).any():  # the longest common extension
            mid = (low + high + 1) >> 1
            same = self.equal(a, b, mid) & open_
            low = np.where(same, mid, low)
            high = np.where(same | ~open_, high, mid - 1)
        out[differ] = self.raw[a + low] < self.raw[b + low]
        return out

    def sort(self, at: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mergesort of the suffixes at the places at, inside each bucket; all merges of a level at once."""
        by = np.argsort(bucket, kind="stable")
        at, bucket = at[by], bucket[by]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        size = np.diff(np.append(first, len(bucket)))
        base, count = np.repeat(first, size), np.repeat(size, size)
        run, most = 1, int(size.max(initial=1))
        while run < most:
            place = np.arange(len(at)) - base
            left = (place // run) % 2 == 0
            other = np.where(left, place // run * run + run, place // run * run - run)
            n_other = np.clip(count - other, 0, run)
            low, high = np.zeros(len(at), np.int64), n_other.copy()
            while len(act := np.flatnonzero(low < high)):
                mid = (low[act] + high[act]) >> 1
                theirs, own = at[base[act] + other[act] + mid], at[act]
                # an element of the left run goes before equal ones of the right run
                smaller = np.where(left[act], self.less(theirs, own, False), self.less(theirs, own, True))
                low[act] = np.where(smaller, mid + 1, low[act])
                high[act] = np.where(smaller, high[act], mid)
            to = base + np.where(left, place // run * run, other) + place % run + low
            merged = np.empty_like(at)
            merged[to] = at
            at, run = merged, 2 * run
        return at, bucket

    def repeated(self, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The places whose length bytes also start at another place of the same bucket; bytes decide, not hashes."""
        ordered, bucket = self.sort(at, bucket)
        same = np.flatnonzero((bucket[1:] == bucket[:-1]) & self.equal(ordered[:-1], ordered[1:], self.length))
        x, y = ordered[same], ordered[same + 1]
        by = np.argsort(x, kind="stable")
        x, y = x[by], y[by]
        cut = np.flatnonzero((np.diff(x) != 1) | (np.diff(y) != 1))
        raw = self.raw.tobytes()
        for i, j in zip(np.append(0, cut + 1).tolist(), np.append(cut, len(x) - 1).tolist(), strict=True) if len(x) else ():
            if raw[x[i] : x[j] + self.length] != raw[y[i] : y[j] + self.length]:  # hashes collided: compare strings
                seen: dict[bytes, list[int]] = {}
                for p in at.tolist():
                    seen.setdefault(raw[p : p + self.length], []).append(p)
                return np.array(sorted(p for own in seen.values() if len(own) > 1 for p in own), np.int64)
        return np.unique(np.concatenate([x, y]))


def _outline(batches: Iterator[pa.RecordBatch], length: int, gram: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each text: key, id, n_bytes, digest, blob, runs repeated inside it, and its distinct segments."""
    from pyspark import TaskContext

    press, key = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
    for batch in batches:
        rows: list[tuple] = []
        for i, text in zip(batch.column(0).to_pylist(), (t.encode() for _, part in pieces_of(batch.column(1)) for t in part), strict=True):
            start, n, place, anchor, whole = segments(np.frombuffer(text, np.uint8), length, gram)
            _, first, same = np.unique(whole, return_index=True, return_inverse=True)
            rep = first[same]  # of each segment the first one with that hash
            for j in np.flatnonzero(rep != np.arange(len(rep))).tolist():
                k = int(rep[j])
                if n[j] != n[k] or text[start[j] : start[j] + n[j] + length - 1] != text[start[k] : start[k] + n[k] + length - 1]:
                    rep[j] = j  # hashes collided; digests will tell
            keep = np.unique(rep)
            count = np.bincount(rep, minlength=len(rep))[keep].astype(np.int32)
            twice = np.isin(rep, keep[count > 1])
            local = _merged(start[twice], start[twice] + n[twice] - 1)
            start, n, place, anchor = start[keep], n[keep], place[keep], anchor[keep]
            digests = [hashlib.blake2b(text[a : a + k + length - 1], digest_size=16).digest() for a, k in zip(start.tolist(), n.tolist(), strict=True)]
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            rows.append((key, i, len(text), hashlib.sha256(text).hexdigest(), press.compress(text), local, anchor.view(np.int64), d[:, 0], d[:, 1], start.astype(np.int32), n.astype(np.int32), (place - start).astype(np.int32), count))
            key += 1
            if len(rows) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)


def _merged(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Runs of windows, sorted by their first ones: first, last, first, last .. of what they make where overlapping or
    adjacent ones are joined."""
    until = np.maximum.accumulate(last)
    cut = np.flatnonzero(first[1:] > until[:-1] + 1)
    return np.stack([first[np.append(0, cut + 1)], until[np.append(cut, len(last) - 1)]], axis=1).ravel().astype(np.int32) if len(first) else np.zeros(0, np.int32)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of windows (first, last), overlapping or adjacent ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _ends(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of each text's unsettled segments: anchor, key, start, n, offset, hot, bytes."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for key, blob, marks in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if not marks:
                continue
            text, cols = press.decompress(blob), [m for m in marks if m["anchor"] is not None]
            if cols:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m["anchor"] for m in cols], pa.int64()), pa.array([key] * len(cols), pa.int64()), *(pa.array([m[c] for m in cols], pa.int32()) for c in ("start", "n", "off")), pa.array([m["hot"] for m in cols], pa.bool_()), pa.array([text[m["start"] : m["start"] + m["n"] + length - 1] for m in cols], pa.binary())],
                    ["anchor", "key", "start", "n", "off", "hot", "bytes"],
                )


def _sorted_block(block: list[tuple], length: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(key, runs of repeated windows) for segments (anchor, key, start, n, off, bytes)."""
    raw = np.frombuffer(b"".join(x[5] for x in block), np.uint8)
    lens = np.array([len(x[5]) for x in block], np.int64)
    base = np.cumsum(lens) - lens
    n, off = np.array([x[3] for x in block], np.int64), np.array([x[4] for x in block], np.int64)
    _, anchor = np.unique(np.array([x[0] for x in block], np.int64), return_inverse=True)
    seg = np.repeat(np.arange(len(block)), n)
    step = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    # windows can only be equal if their anchor is the same and equally far from their start
    bucket = anchor[seg] * np.int64(2 * length) + (off[seg] - step)
    hit = SuffixSort(raw, length).repeated(base[seg] + step, bucket)
    own = np.searchsorted(base, hit, "right") - 1
    for k in np.unique(own).tolist():
        yield block[k][1], [(a - int(base[k]) + block[k][2], b - int(base[k]) + block[k][2]) for a, b in runs(hit[own == k])]


def _by_anchor(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, settled in blocks of whole groups."""

    def settled(block: list[tuple]) -> pa.RecordBatch:
        found = list(_sorted_block(block, length))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([[x for ab in r for x in ab] for _, r in found], pa.list_(pa.int32()))], ["key", "spans"])

    block: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if held >= BLOCK and row[0] != block[-1][0]:
                yield settled(block)
                block, held = [], 0
            block.append(row)
            held += len(row[5])
    if block:
        yield settled(block)


def _packed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The windows of hot segments in chunks: their distinct digests, and of each window text and place."""
    from pyspark import TaskContext

    chunk, names = TaskContext.get().partitionId() << 32, ["chunk", "v0", "v1", "twice", "keys", "places", "same", "n"]

    def flush() -> pa.RecordBatch:
        d = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        first, twice, same = once_each([d[:, 0], d[:, 1]], [])
        blobs = d[first, 0].tobytes(), d[first, 1].tobytes(), np.packbits(twice).tobytes(), pack(np.concatenate(keys)), pack(np.concatenate(places)), pack(same)
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs), pa.array([len(first)], pa.int64())], names)

    digests, keys, places = [], [], []
    for batch in batches:
        for key, start, n, raw in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 5)), strict=True):
            for a in range(0, n, CHUNK_WINDOWS):
                m = min(n - a, CHUNK_WINDOWS)
                digests += [hashlib.blake2b(raw[j : j + length], digest_size=16).digest() for j in range(a, a + m)]
                keys.append(np.full(m, key, np.int64))
                places.append(np.arange(start + a, start + a + m))
                if len(digests) >= CHUNK_WINDOWS:
                    yield flush()
                    chunk, digests, keys, places = chunk + 1, [], [], []
    if digests:
        yield flush()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with what repeats to (key, runs of repeated windows)."""
    for batch in batches:
        for keys, places, same, met in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key, place, same = (unpress(x, np.int64) for x in (keys, places, same))
            hit = np.zeros(int(same.max()) + 1, bool)
            hit[met_in(met)[0]] = True
            key, place = key[hit[same]], place[hit[same]]
            cut = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
            spans = [[x for ab in runs(np.unique(p)) for x in ab] for p in np.split(place, cut[1:])] if len(key) else []
            yield pa.RecordBatch.from_arrays([pa.array(key[cut], pa.int64()), pa.array(spans, pa.list_(pa.int32()))], ["key", "spans"])


def _cut(batches: Iterator[pa.RecordBatch], length: int, keep_text: bool, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Texts without what repeats."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for key, i, n_bytes, blob, local, marks, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spans = list(zip(local[::2], local[1::2], strict=True)) + [(m["start"], m["start"] + m["n"] - 1) for m in marks or () if m["whole"]]
            for own in more or ():
                spans += zip(own[::2], own[1::2], strict=True)
            gone: list[list[int]] = []
            for a, b in _merge(spans):
                if gone and a <= gone[-1][1]:
                    gone[-1][1] = b + length
                else:
                    gone.append([a, b + length])
            text, kept, at = press.decompress(blob), [], 0
            for a, b in gone:
                kept.append(text[at:a])
                at = b
            left = b"".join([*kept, text[at:]])
            rows.append((key, i, n_bytes, sum(b - a for a, b in gone), len(gone), left if keep_text else hashlib.sha256(left).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, keep_bytes: bool = False) -> DataFrame:
    """One row for each row of df: id, n_bytes, n_removed, n_spans, and kept_sha256 (or kept, the bytes themselves).

    Every byte covered by a string of length bytes (UTF-8) that also starts at another place, in the same text or
    another, is removed, from all places. A null text counts as empty; texts shorter than length stay; rows that repeat
    lose everything if they are that long, whatever their ids. An empty table gives an empty result; other columns are
    ignored."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = type_of(df, id_col)
    head = f"key long, id {kind}, n_bytes long, sha string, blob binary, local array<int>, anchor array<long>, d1 array<long>, d2 array<long>, start array<int>, n array<int>, off array<int>, cnt array<int>"
    schema = to_arrow_schema(StructType.fromDDL(head))
    texts = written(df.select(F.col(id_col), text_or_empty(text_col).alias("t")).mapInArrow(lambda it: _outline(it, length, gram, schema), head), "suffix-outline")
    parts = texts.select("key", F.explode(F.arrays_zip("anchor", "d1", "d2", "start", "n", "off", "cnt")).alias("s")).select("key", "s.*")
    shared = written(parts.groupBy("anchor").agg(F.sum("cnt").alias("c")).where("c > 1").select("anchor"), "suffix-anchors")
    likely = written(parts.join(shared, "anchor", "left_semi"), "suffix-segments")
    whole = written(likely.groupBy("anchor", "d1", "d2").agg(F.sum("cnt").alias("times"), F.min(F.struct("key", "start", "n", "off")).alias("rep")), "suffix-contents")
    mixed = written(whole.groupBy("anchor").agg(F.count("*").alias("contents"), F.min("times").alias("least")).where("contents > 1 and least = 1").select("anchor", "contents"), "suffix-mixed")
    repeated = likely.join(whole.where("times > 1").select("anchor", "d1", "d2"), ["anchor", "d1", "d2"], "left_semi").select("key", F.struct("start", "n", F.lit(0).alias("off"), F.lit(True).alias("whole"), F.lit(None).cast("long").alias("anchor"), F.lit(False).alias("hot")).alias("m"))
    unsettled = whole.join(mixed, "anchor").select(F.col("rep.key").alias("key"), F.struct("rep.start", "rep.n", "rep.off", F.lit(False).alias("whole"), "anchor", (F.col("contents") > group).alias("hot")).alias("m"))
    marks = repeated.unionByName(unsettled).groupBy("key").agg(F.collect_list("m").alias("marks"))  # as many as the text has segments
    touched = written(texts.select("key", "id", "n_bytes", "blob", "local").join(marks, "key", "left").where("marks is not null or size(local) > 0"), "suffix-touched")
    dropped(shared, likely, whole, mixed)
    ends = touched.select("key", "blob", "marks").where("exists(marks, m -> m.anchor is not null)").mapInArrow(lambda it: _ends(it, length), "anchor long, key long, start int, n int, off int, hot boolean, bytes binary")
    ends = written(ends, "suffix-ends")
    found = "key long, spans array<int>"
    cold = ends.where("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda it: _by_anchor(it, length), found)
    hot = written(ends.where("hot").drop("hot").mapInArrow(lambda it: _packed(it, length), "chunk long, v0 binary, v1 binary, twice binary, keys binary, places binary, same binary, n long"), "suffix-hot")
    met = repeated_values(hot, hot.agg(F.sum("n")).first()[0] or 0, halves=2)
    hot = hot.select("chunk", "keys", "places", "same").join(met, "chunk").drop("chunk").mapInArrow(_repeated, found)
    spans = cold.unionByName(hot).groupBy("key").agg(F.collect_list("spans").alias("more"))
    last = "kept binary" if keep_bytes else "kept_sha256 string"
    body = f"key long, `{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, {last}"
    final = to_arrow_schema(StructType.fromDDL(body))
    cut = touched.join(spans, "key", "left").select("key", "id", "n_bytes", "blob", "local", "marks", "more").mapInArrow(lambda it: _cut(it, length, keep_bytes, final), body)
    other = texts.select("key", "id", "n_bytes", "sha", *(["blob"] if keep_bytes else [])).join(touched.select("key"), "key", "left_anti")
    if keep_bytes:
        untouched = other.select("key", "id", "n_bytes", "blob", F.array().cast("array<int>").alias("local"), F.expr("cast(null as array<struct<start:int,n:int,off:int,whole:boolean,anchor:bigint,hot:boolean>>)").alias("marks"), F.expr("cast(null as array<array<int>>)").alias("more")).mapInArrow(lambda it: _cut(it, length, True, final), body)
    else:
        untouched = other.select("key", F.col("id").alias(id_col), "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return cut.unionByName(untouched).drop("key")
