"""Which of very many hash values occur more than once, found on packed arrays.

A table of chunks holds the values of many rows as one binary each. A chunk sends every distinct value of its own once,
packed by hash bucket, with the least payload that it has there; in the bucket's task the chunks' values meet and are
sorted, and what occurs twice goes back to the chunks that sent it, with the least payload of all. A value that a third of
all rows hold is thus one entry a chunk, and values that occur once cost 8 bytes in one shuffle and nothing after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_VALUES = 1 << 20


def press(a: np.ndarray) -> bytes:
    """Integers as differences in byte planes, compressed: small for those that rise slowly."""
    a = np.ascontiguousarray(a)
    d = np.diff(a, prepend=np.zeros(1, a.dtype))
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())


def unpress(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel(), dtype=kind)


Halves = list[np.ndarray]  # a value's 64-bit integers: one or two


def first_of_each(values: Halves, payload: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by value and payload, and where each value begins among them."""
    by = np.lexsort((*payload[::-1], *values))
    new = np.zeros(len(by), bool)
    new[:1] = True
    for v in values:
        own = v[by]
        new[1:] |= own[1:] != own[:-1]
    return by, np.flatnonzero(new)


def once_each(values: Halves, payload: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, twice, same): the places, rising, of the row with the least payload of each distinct value, whether the
    value has more rows, and for each row which of those places is its value's."""
    by, start = first_of_each(values, payload)
    size = np.diff(np.append(start, len(by)))
    order = np.argsort(by[start], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    same = np.empty(len(by), np.int64)
    same[by] = np.repeat(rank, size)
    return by[start][order], size[order] > 1, same


def _deal(batches: Iterator[pa.RecordBatch], halves: int, width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    names = ["bucket", "chunk", "at", "twice", *(f"v{k}" for k in range(halves)), *(f"p{k}" for k in range(width))]
    for batch in batches:
        for chunk, bits, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            values = [np.frombuffer(v, np.uint64) for v in blobs[:halves]]
            twice = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(values[0]))
            payload = [unpress(p, np.int64) for p in blobs[halves:]]
            bucket = (values[0] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")  # inside a bucket in the chunk's order, so that payloads rise
            cut = np.flatnonzero(np.diff(bucket[by], prepend=-1))
            rows: list[list] = [[] for _ in names]
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(by)], strict=True):
                own = by[a:b]
                for column, x in zip(rows, (int(bucket[own[0]]), chunk, press(own), np.packbits(twice[own]).tobytes(), *(v[own].tobytes() for v in values), *(press(p[own]) for p in payload)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.binary()) for k, c in enumerate(rows)], names)


def _meet(batches: Iterator[pa.RecordBatch], halves: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket."""

    def settled(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        values = [np.concatenate([np.frombuffer(r[4 + k], np.uint64) for r in rows]) for k in range(halves)]
        lens = [len(r[4]) // 8 for r in rows]
        twice = np.concatenate([np.unpackbits(np.frombuffer(r[3], np.uint8), count=n).view(bool) for r, n in zip(rows, lens, strict=True)])
        payload = [np.concatenate([unpress(r[4 + halves + k], np.int64) for r in rows]) for k in range(width)]
        by, start = first_of_each(values, payload)
        size = np.diff(np.append(start, len(by)))
        met = (size > 1) | np.logical_or.reduceat(twice[by], start)
        hit, least = np.zeros(len(by), bool), np.empty(len(by), np.int64)
        hit[by], least[by] = np.repeat(met, size), np.repeat(by[start], size)
        end, out = np.cumsum(lens), []
        for r, a, b in zip(rows, (end - lens).tolist(), end.tolist(), strict=True):
            own = np.flatnonzero(hit[a:b])
            if len(own):
                out.append((r[1], press(unpress(r[2], np.int64)[own]), *(press(p[least[own + a]]) for p in payload)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], ["chunk", "at", *(f"p{k}" for k in range(width))])

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[0] != rows[-1][0]:
                yield from settled(rows)
                rows = []
            rows.append(row)
    if rows:
        yield from settled(rows)


def repeated_values(chunks: DataFrame, total: int, width: int = 0, halves: int = 1) -> DataFrame:
    """(chunk, met): for each chunk with values that occur more than once, here or in other chunks, those values.

    chunks: chunk (a unique long), v0 and for values of 128 bits v1 (distinct values as one binary of unsigned 64-bit
    integers each), twice (a bit for each of them: whether the chunk has it more than once) and p0 .. p<width - 1> (for
    each value a 64-bit integer, pressed); it is read once. total: the number of values, which sets the number of
    buckets. met is an array of structs at, p0 .. with the places of the values and the least payload that each has
    anywhere; read it with met_in."""
    buckets = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_VALUES))
    values, names = [f"v{k}" for k in range(halves)], [f"p{k}" for k in range(width)]
    more = "".join(f", {p} binary" for p in names)
    dealt = chunks.select("chunk", "twice", *values, *names).mapInArrow(lambda it: _deal(it, halves, width, buckets), f"bucket long, chunk long, at binary, twice binary{''.join(f', {v} binary' for v in values)}{more}")
    found = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _meet(it, halves, width), f"chunk long, at binary{more}")
    return found.groupBy("chunk").agg(F.collect_list(F.struct("at", *names)).alias("met"))  # no more than the chunk's own values


def met_in(met: list[dict], width: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """The places of a chunk's values that are repeated, rising, and the least payload of each."""
    at, *payload = (np.concatenate([np.zeros(0, np.int64), *(unpress(m[c], np.int64) for m in met)]) for c in ("at", *(f"p{k}" for k in range(width))))
    by = np.argsort(at)
    return at[by], [p[by] for p in payload]
