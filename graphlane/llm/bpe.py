"""Byte-level BPE through a table of distinct words.

Texts are split into words chunk by chunk. A chunk keeps, for each of its documents, the numbers of its words in text
order (packed) and sends each distinct word once, packed by hash bucket, to the bucket's task; there equal words of
all chunks meet and each is encoded once. The ids go back to their chunks by bucket and position, where documents are
put together. To decode, a chunk's distinct ids are joined with the table of ids and pieces (an Arrow hash join; the
table is the vocabulary, whose size is fixed), each distinct word becomes its pieces, and documents are strung from these.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.llm.common import pieces_of, type_of, written

CHUNK_BYTES = 32 << 20
GPT2_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as byte planes, compressed."""
    a = np.ascontiguousarray(values, dtype="<u4")
    return zstandard.ZstdCompressor(level=3).compress(a.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Ranks by falling frequency: a byte for the first 255, an escape and a packed rest for others."""
    small = zstandard.ZstdCompressor(level=3).compress(np.minimum(ranks, 255).astype(np.uint8).tobytes())
    return small, pack(ranks[ranks >= 255] - 255)


def unpack_ranks(small: bytes, large: bytes) -> np.ndarray:
    ranks = np.frombuffer(zstandard.ZstdDecompressor().decompress(small), np.uint8).astype(np.uint32)
    ranks[ranks == 255] = unpack(large) + 255
    return ranks


class Vocabulary:
    """A tokenizer file of the byte-level kind: splitting, encoding of words, pieces by id."""

    cached: dict[str, "Vocabulary"] = {}

    def __init__(self, source: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.pre = self.tokenizer.pre_tokenizer
        self.words = regex.compile(GPT2_SPLIT).findall
        # newer letters than the tokenizer's tables know split differently, so such texts go to its own splitter
        self.rare = re.compile("[^\x00-՗]").search
        added = [t["content"] for t in json.loads(source).get("added_tokens", [])]
        # where several begin at one place the longest counts
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        byte_of = {c: b for b, c in _byte_letters().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        pieces = [t.encode() if t in added else bytes(byte_of[c] for c in t) for t in vocabulary]
        self.pieces = pa.table({"id": pa.array(vocabulary.values(), pa.uint32()), "piece": pa.array(pieces, pa.binary())})

    @classmethod
    def of(cls, source: str) -> "Vocabulary":
        if source not in cls.cached:
            cls.cached = {source: cls(source)}
        return cls.cached[source]

    def split(self, text: str) -> list[str]:
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if self.rare(text):
            return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]
        return self.words(text)

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _chunk(task: int, number: int, ids: list, docs: list[np.ndarray], words: dict[str, int], buckets: int) -> dict:
    """One row: the documents as word numbers by falling frequency, and the words packed by bucket in that order."""
    flat = np.concatenate([np.zeros(0, np.uint32), *docs])
    names = list(words)
    order = np.argsort(-np.bincount(flat, minlength=len(names)), kind="stable")
    rank = np.zeros(max(len(names), 1), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    coded = [names[i].encode() for i in order.tolist()]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in coded), np.uint32, len(coded))
    by = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.diff(bucket[by], append=buckets)) + 1
    small, large = pack_ranks(rank[flat])
    packed, start, press = [], 0, zstandard.ZstdCompressor(level=3)
    for end in ends.tolist():
        own = [coded[i] for i in by[start:end].tolist()]
        packed.append({"bucket": int(bucket[by[start]]), "lens": pack(np.fromiter(map(len, own), np.uint32, len(own))), "words": press.compress(b"".join(own))})
        start = end
    return {"chunk": task << 32 | number, "ids": ids, "n_words": [len(d) for d in docs], "idx": small, "rare": large, "buckets": pack(bucket), "packed": packed}


def _split(batches: Iterator[pa.RecordBatch], source: str, schema: pa.Schema, buckets: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    vocabulary, task, number = Vocabulary.of(source), TaskContext.get().partitionId(), 0
    ids, docs, words, size = [], [], {}, 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([_chunk(task, number, ids, docs, words, buckets)], schema)

    for batch in batches:
        lens = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        for i, n_bytes, text in zip(batch.column(0).to_pylist(), lens, (t for _, part in pieces_of(batch.column(1)) for t in part), strict=True):
            add = words.setdefault
            found = vocabulary.split(text) if text else []
            docs.append(np.fromiter([add(w, len(words)) for w in found], np.uint32, len(found)))
            ids.append(i)
            size += n_bytes + 64
            if size >= chunk_bytes:
                yield flush()
                number, ids, docs, words, size = number + 1, [], [], {}, 0
    if ids:
        yield flush()


def _encode(batches: Iterator[pa.RecordBatch], source: str) -> Iterator[pa.RecordBatch]:
    """Rows of packed words, sorted by bucket, to rows of packed ids; each distinct word of a bucket is encoded once."""
    vocabulary, known, last = Vocabulary.of(source), {}, None
    for batch in batches:
        for k in range(batch.num_rows):
            chunk, bucket, lens, packed = (c[k].as_py() for c in batch.columns)
            if bucket != last:
                known, last = {}, bucket
            ends = np.cumsum(unpack(lens)).tolist()
            raw = zstandard.ZstdDecompressor().decompress(packed)
            own = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            new = [w for w in own if w not in known]
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                known.update((w, np.array(x, np.uint32).tobytes()) for w, x in zip(part, vocabulary.encode([w.decode() for w in part]), strict=True))
            coded = [known[w] for w in own]
            n_ids = pack(np.fromiter(map(len, coded), np.uint32, len(coded)) // 4)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "bucket": pa.array([bucket], pa.int32()), "n_ids": pa.array([n_ids], pa.binary()), "word_ids": pa.array([pack(np.frombuffer(b"".join(coded), "<u4"))], pa.binary())})


def decoded_words(ids: np.ndarray, n: np.ndarray, pieces: pa.Table) -> list[bytes]:
    """Of each word, n ids of ids, the bytes that its pieces make: the distinct ids are joined with the table of pieces."""
    distinct, place = np.unique(ids, return_inverse=True)
    joined = pa.table({"id": pa.array(distinct, pa.uint32())}).join(pieces, "id", join_type="left outer").sort_by("id")
    own = joined.column("piece").to_pylist()
    piece = [own[i] for i in place.tolist()]
    ends = np.cumsum(n).tolist()
    return [piece[b - 1] if b - a == 1 else b"".join(piece[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def _assemble(batches: Iterator[pa.RecordBatch], source: str, digests: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    pieces = Vocabulary.of(source).pieces
    for batch in batches:
        for row in range(batch.num_rows):
            x = batch.slice(row, 1).to_pylist()[0]
            bucket, idx = unpack(x["buckets"]), unpack_ranks(x["idx"], x["rare"])
            parts = sorted(x["parts"] or [], key=lambda p: p["bucket"])
            lens = np.concatenate([np.zeros(0, np.uint32), *(unpack(p["n_ids"]) for p in parts)]).astype(np.int64)
            flat = np.concatenate([np.zeros(0, np.uint32), *(unpack(p["word_ids"]) for p in parts)])
            words = decoded_words(flat, lens, pieces)
            by = np.argsort(bucket, kind="stable")
            n_of, at_of, place = np.empty(len(by), np.int64), np.empty(len(by), np.int64), np.empty(len(by), np.int64)
            n_of[by], at_of[by], place[by] = lens, np.cumsum(lens) - lens, np.arange(len(by))
            start, out, held = 0, [], 0
            for i, n in zip(x["ids"], x["n_words"], strict=True):
                own = idx[start : start + n]
                start += n
                count = n_of[own]
                total = int(count.sum())
                ids = flat[np.repeat(at_of[own] - (np.cumsum(count) - count), count) + np.arange(total)]
                text = b"".join([words[w] for w in place[own].tolist()]).decode("utf-8", "replace")
                if digests:
                    out.append((i, total, hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                else:
                    out.append((i, total, ids.tolist(), text))
                    held += total
                if len(out) == 2000 or held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def encode_and_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, digests: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each row of df: id, n_tokens, then ids (array) and decoded (text), or their SHA-256 with digests.

    vocabulary: the path of a byte-level BPE file of the tokenizers library on the driver, which sends it to executors
    (its size is fixed). Special tokens in a text become their ids and no others are added. A null text counts as
    empty and has no tokens; rows that repeat an id are encoded each; an empty table gives an empty result; other
    columns are ignored. A chunk ends with the text that brings it
    to chunk_bytes, so a longer text closes its chunk."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = df.sparkSession
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    buckets, kind = int(spark.conf.get("spark.sql.shuffle.partitions")), type_of(df, id_col)
    head = f"chunk long, ids array<{kind}>, n_words array<int>, idx binary, rare binary, buckets binary, packed array<struct<bucket: int, lens: binary, words: binary>>"
    schema = to_arrow_schema(StructType.fromDDL(head))
    chunks = written(df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(lambda it: _split(it, source.value, schema, buckets, chunk_bytes), head), "bpe-chunks", **{"parquet.block.size": str(32 << 20)})
    words = chunks.select("chunk", F.explode("packed").alias("p")).select("chunk", "p.*").repartition("bucket").sortWithinPartitions("bucket")
    coded = words.mapInArrow(lambda it: _encode(it, source.value), "chunk long, bucket int, n_ids binary, word_ids binary")
    parts = coded.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n_ids", "word_ids")).alias("parts"))
    out = f"`{id_col}` {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    result = to_arrow_schema(StructType.fromDDL(out))
    joined = chunks.select("chunk", "ids", "n_words", "idx", "rare", "buckets").join(parts, "chunk", "left")
    return joined.mapInArrow(lambda it: _assemble(it, source.value, digests, result), out)
