"""Repeated paragraphs and passages by MinHash banding.

A paragraph is a line of MIN_WORDS words or more, or a block of successive shorter lines up to a blank or long one, so
that hard-wrapped text counts too. Its MinHash over runs of five words is cut into bands, as many and as long as the wanted
recall at the threshold asks for; paragraphs that collide in a band are joined and verified by the exact Jaccard
similarity of their runs (graphlane.llm.linking), and the components of verified links are the clusters. Where paragraphs
that no link connects crowd a band (all that embed one passage), they are joined once more by their rarest runs, of
which similar ones have one in common. The first occurrence of a cluster stays, the others go. Equal paragraphs are one
from the start.

Passages also repeat inside longer paragraphs and across them. There the words choose where paragraphs begin: a word pair
with the least hash of PICK successive ones begins a window of WINDOW words. Any run of WINDOW + PICK - 1 = 51 words
holds such a window, wherever it stands, so equal runs of that length meet in equal windows (graphlane.llm.packed).
What two texts seem to share is verified by a 128-bit digest of its complete words, and windows that fail are matched anew
by such digests alone. Overlapping repeated windows of a text are one passage; passages that share a window are a cluster.

Texts are cut into words once. The words stay in compressed chunks of some megabytes; these are what is shuffled when
candidates are to be compared, just once for all of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphlane.llm.common import dropped, pieces_of, text_or_empty, type_of, written
from graphlane.llm.hashing import BASE, INVERSE, grams, mix, powers, word_hashes
from graphlane.llm.linking import classes, collisions, mixed, sharing
from graphlane.llm.packed import met_in, once_each, press, repeated_values, unpress
from graphlane.plans.components import components

K = 5
SIMILARITY = 0.8
MIN_WORDS = 40
RECALL = 0.9995
MOST_HASHES = 80
WINDOW = 36
PICK = 16
CHUNK_BYTES = 8 << 20
_INDEX_BITS = 20  # of a text's number in its chunk
_LAST = 2**63 - 1
tokens_of = re.compile(r"[^\W_]+|\n").findall
words_of = re.compile(r"[^\W_]+").findall


def tuned_bands(similarity: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows a band): the longest bands that find a pair at the threshold with the wanted probability."""
    for rows in range(most, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    return most, 1


def shingles(h: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of K words of paragraphs that follow each other in h (word hashes), and how many each has; one
    of fewer words is a single run."""
    k = np.minimum(lens, K)
    n = lens - k + 1
    begin = np.cumsum(lens) - lens
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    short = np.repeat(K - k, n)
    g = np.zeros(len(at), np.uint64)
    for j in range(K):
        word = h[np.minimum(at + j, len(h) - 1)]
        g = g * np.uint64(BASE) + np.where(j < K - short, word, np.uint64(0))
    g = mix(g)
    owner = np.repeat(np.arange(len(lens)), n)
    own = g ^ mix(owner.astype(np.uint64) + np.uint64(1))
    by = np.argsort(own, kind="stable")
    keep = np.ones(len(g), bool)
    keep[by[1:][own[by[1:]] == own[by[:-1]]]] = False
    return g[keep], np.bincount(owner[keep], minlength=len(lens))


def band_values(g: np.ndarray, n: np.ndarray, bands: int, rows: int, seeds: np.ndarray) -> np.ndarray:
    """The band values (columns) of each paragraph (rows), given the shingles."""
    start = np.cumsum(n) - n
    low = (g & np.uint64(2**32 - 1)).astype(np.uint32)
    out = np.zeros((len(n), bands), np.uint64)
    for b in range(bands):
        for r in range(rows):
            x = low * seeds[b * rows + r]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            out[:, b] = out[:, b] * np.uint64(BASE) + np.minimum.reduceat(x, start)
        out[:, b] = mix(out[:, b] * np.uint64(BASE) + np.uint64(b))
    return out


def jaccard(a: list[str], b: list[str]) -> float:
    """Of the sets of runs of five words; of the words themselves if a text has fewer."""
    x, y = ({tuple(w[i : i + K]) for i in range(max(len(w) - K + 1, 1))} for w in (a, b))
    return len(x & y) / len(x | y)


def windows(h: np.ndarray, lens: np.ndarray, window: int = WINDOW, pick: int = PICK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that follow each other in h (word hashes): the text and the place in it of each chosen window, and a hash
    of the window's words."""
    begin = np.cumsum(lens) - lens
    pair = grams(h, 2)
    place = np.uint64(2 ** max(24, len(pair).bit_length()) - 1)
    low = (pair & ~place) | np.arange(len(pair), dtype=np.uint64)
    width = 1
    while width < pick:
        step = min(width, pick - width)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        width += step
    n = np.maximum(lens - pick, 0)  # places where pick pairs begin inside the text
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    owner = np.repeat(np.arange(len(lens)), n)
    least = (low[at] & place).astype(np.int64)
    keep = np.concatenate([np.ones(min(len(at), 1), bool), (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])
    least, owner = least[keep], owner[keep]
    fits = least - begin[owner] + window <= lens[owner]
    least, owner = least[fits], owner[fits]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(len(h)), dtype=np.uint64)])
    return owner, least - begin[owner], mix((sums[least + window] - sums[least]) * powers(len(h) + 1, INVERSE)[least])


class _Chunk:
    """Texts of a task that are written as one row: their words, and the windows in them."""

    def __init__(self) -> None:
        self.keys, self.ranks, self.ids, self.words, self.n_bytes = [], [], [], [], 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def row(self, chunk: int, mask: int) -> tuple:
        owner, at, value = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        value = value & np.uint64(mask)
        payload = [np.array(self.ranks, np.int64)[owner], np.array(self.keys, np.int64)[owner], at]
        first, twice, same = once_each([value], payload)
        blob = zstandard.ZstdCompressor(level=6).compress("\n".join(self.words).encode())
        return chunk, blob, self.keys, self.ids, value[first].tobytes(), np.packbits(twice).tobytes(), *(press(p[first]) for p in payload), press(owner), press(at), press(same), len(first)


def _split(df: DataFrame, id_col: str, text_col: str, similarity: float, min_words: int, mask: int) -> DataFrame:
    """Written: rows of chunks (chunk, blob, keys, ids, v0, twice, p0, p1, p2, owner, at, same, n) and rows of paragraphs
    (key, doc, id, line, start, n_words, digest, sketch, size)."""
    bands, rows = tuned_bands(similarity, RECALL)
    seeds = np.random.Generator(np.random.PCG64(11)).integers(1, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    kind = type_of(df, id_col)
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    rank = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)) if whole else F.when(F.col(id_col).isNull(), 1).otherwise(0).cast("long")
    head = f"chunk long, blob binary, keys array<long>, ids array<{kind}>, v0 binary, twice binary, p0 binary, p1 binary, p2 binary, owner binary, at binary, same binary, n long"
    body = f"key long, doc long, id {kind}, line int, start int, n_words int, digest binary, sketch binary, size int"
    n_head, n_body = head.count(",") + 1, body.count(",") + 1
    schema = to_arrow_schema(T.StructType.fromDDL(f"{head}, {body}"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        number, key, chunk = task << _INDEX_BITS, task << 40, _Chunk()

        def table(found: list[tuple], first: int, n: int) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[]] * n
            return pa.RecordBatch.from_arrays([pa.array(columns[k - first], f.type) if first <= k < first + n else pa.nulls(len(found), f.type) for k, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for begin, texts in pieces_of(batch.column(1)):
                ids, ranks = batch.column(0).slice(begin, len(texts)).to_pylist(), batch.column(2).slice(begin, len(texts)).to_pylist()
                known: dict[str, int] = {"\n": 0}
                add = known.setdefault
                tokens = [tokens_of(t.lower()) for t in texts]
                n_tokens = np.fromiter(map(len, tokens), np.int64, len(tokens))
                code = np.fromiter((add(w, len(known)) for own in tokens for w in own), np.int64, int(n_tokens.sum()))
                text = np.repeat(np.arange(len(texts)), n_tokens)
                line = np.cumsum(code == 0)
                line -= np.repeat(np.concatenate([[0], line])[np.cumsum(n_tokens) - n_tokens], n_tokens) if len(line) else 0
                is_word = code > 0
                text, line = text[is_word], line[is_word]
                flat = [w for own in tokens for w in own if w != "\n"]
                del tokens
                h = word_hashes([w.encode() for w in known])[code[is_word]]
                lens = np.bincount(text, minlength=len(texts))
                ends = np.cumsum(lens)

                first_doc = number << _INDEX_BITS | len(chunk.keys)
                # runs of words of one line, then of one paragraph
                new = np.concatenate([np.ones(min(len(text), 1), bool), (text[1:] != text[:-1]) | (line[1:] != line[:-1])])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(text)))
                long = n >= min_words
                alone = np.concatenate([np.ones(min(len(at), 1), bool), (text[at][1:] != text[at][:-1]) | (line[at][1:] != line[at][:-1] + 1) | long[1:] | long[:-1]])
                of = np.flatnonzero(alone)
                n_words = np.add.reduceat(n, of) if len(of) else n
                of = of[n_words >= min_words]
                n_words, at = n_words[n_words >= min_words], at[of]
                if len(at):
                    words = [" ".join(flat[a : a + m]).encode() for a, m in zip(at.tolist(), n_words.tolist(), strict=True)]
                    digests = [hashlib.blake2b(w, digest_size=16).digest() for w in words]
                    place: dict[bytes, int] = {}
                    for i, d in enumerate(digests):
                        place.setdefault(d, i)
                    reps = np.fromiter(place.values(), np.int64, len(place))
                    m = n_words[reps]
                    g, size = shingles(h[np.repeat(at[reps] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))], m)
                    sketch = band_values(g, size, bands, rows, seeds)
                    sketches, sizes = dict(zip(place, (x.tobytes() for x in sketch), strict=True)), dict(zip(place, size.tolist(), strict=True))
                    start = at - (ends - lens)[text[at]]
                    yield table([(key + i, first_doc + t, ids[t], x, s, w, d, sketches[d], sizes[d]) for i, (t, x, s, w, d) in enumerate(zip(text[at].tolist(), line[at].tolist(), start.tolist(), n_words.tolist(), digests, strict=True))], n_head, n_body)
                    key += len(at)

                owner, place_, value = windows(h, lens)
                chunk.parts.append((owner + len(chunk.keys), place_, value))
                chunk.keys += range(first_doc, first_doc + len(texts))
                chunk.ids += ids
                chunk.ranks += ranks
                for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True):
                    chunk.words.append(" ".join(flat[a:b]))
                    chunk.n_bytes += len(chunk.words[-1]) + 16
                if chunk.n_bytes >= CHUNK_BYTES:
                    yield table([chunk.row(number, mask)], 0, n_head)
                    number, chunk = number + 1, _Chunk()
        if chunk.keys:
            yield table([chunk.row(number, mask)], 0, n_head)

    return written(df.select(F.col(id_col), text_or_empty(text_col), rank).mapInArrow(split, f"{head}, {body}"), "paragraphs")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the stretches of windows that also occur elsewhere: (doc, id, at, n, from_doc, from_at, places).

    A stretch is a chain of overlapping windows, at the places, whose first occurrences overlap in the same way; n counts
    its words."""
    for batch in batches:
        for keys, ids, owner, at, same, met in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 5)), strict=True):
            owner, at, same = unpress(owner, np.int64), unpress(at, np.int64), unpress(same, np.int64)
            hit, payload = met_in(met, 3)
            found = np.full(int(same.max(initial=-1)) + 1, -1, np.int64)
            found[hit] = np.arange(len(hit))
            rows = np.flatnonzero(found[same] >= 0)
            if not len(rows):
                continue
            owner, at, same = owner[rows], at[rows], found[same[rows]]
            from_doc, from_at = payload[1][same], payload[2][same]
            doc = np.array(keys, np.int64)[owner]
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (from_doc[1:] != from_doc[:-1]) | (at[1:] - from_at[1:] != at[:-1] - from_at[:-1]) | (at[1:] > at[:-1] + WINDOW)])
            start = np.flatnonzero(new)
            end = np.append(start[1:], len(at)) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[start]), pa.array([ids[i] for i in owner[start].tolist()], batch.schema.field(1).type.value_type), pa.array(at[start].astype(np.int32)), pa.array((at[end] - at[start] + WINDOW).astype(np.int32)), pa.array(from_doc[start]), pa.array(from_at[start].astype(np.int32)), pa.array([at[a : b + 1].astype(np.int32) for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.list_(pa.int32()))],
                ["doc", "id", "at", "n", "from_doc", "from_at", "places"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each wanted stretch (doc, start, n, whole) the words if it is wanted whole, else their digest."""
    for batch in batches:
        for blob, keys, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            texts, first, last, words = zstandard.ZstdDecompressor().decompress(blob).decode().split("\n"), keys[0], -1, []
            wanted.sort(key=lambda w: w["doc"])
            for at in range(0, len(wanted), 5000):
                part = wanted[at : at + 5000]
                text, digest = [], []
                for w in part:
                    if w["doc"] != last:
                        last = w["doc"]
                        words = texts[last - first].split(" ")
                    own = " ".join(words[w["start"] : w["start"] + w["n"]])
                    text.append(own if w["whole"] else None)
                    digest.append(None if w["whole"] else hashlib.blake2b(own.encode(), digest_size=16).digest())
                yield pa.RecordBatch.from_arrays([pa.array([w["doc"] for w in part], pa.int64()), pa.array([w["start"] for w in part], pa.int32()), pa.array([w["n"] for w in part], pa.int32()), pa.array(text, pa.string()), pa.array(digest, pa.binary())], ["doc", "start", "n", "words", "digest"])


def cuts(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Written: (doc, start, n, words, digest) of the wanted stretches (doc, start, n, whole), distinct ones."""
    by_chunk = wanted.groupBy(F.expr(f"shiftright(doc, {_INDEX_BITS})").alias("chunk")).agg(F.collect_set(F.struct("doc", "start", "n", "whole")).alias("wanted"))
    return written(chunks.select("chunk", "blob", "keys").join(by_chunk.hint("merge"), "chunk").select("blob", "keys", "wanted").mapInArrow(_cut, "doc long, start int, n int, words string, digest binary"), "paragraph-cuts")


def _paragraphs(found: DataFrame, members: DataFrame, reps: DataFrame, cut: DataFrame, similarity: float) -> DataFrame:
    """Paragraphs that are similar: (id, kind, start, n_words, cluster_id, keep_id, cluster_size, kept)."""
    own = reps.select("key", F.col("best.doc").alias("doc"), F.col("best.start").alias("start"), F.col("best.n_words").alias("n"))
    words = written(own.join(members.select("key").distinct(), "key", "left_semi").join(cut.where("words is not null").select("doc", "start", "n", "words"), ["doc", "start", "n"]).select("key", "words"), "paragraph-words")

    def verify(pairs: DataFrame) -> DataFrame:
        # what repeats grows with the input, so words are joined in the same way at every size
        a, b = words.select(F.col("key").alias("a"), F.col("words").alias("wa")), words.select(F.col("key").alias("b"), F.col("words").alias("wb"))
        both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "wa", "wb")
        return written(both.mapInArrow(check, "a long, b long"), "paragraph-links")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([jaccard(x.split(), y.split()) >= similarity for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    def crowded(members: DataFrame, label: DataFrame) -> DataFrame:
        """Pairs among paragraphs in bands of several classes that have one of their rarest runs in common: of n runs the
        n - similarity * n + 1 rarest, which any two similar ones do."""
        each, met = mixed(members, label)
        keys = each.join(met.select("s"), "s", "left_semi").select("key").distinct()
        own = written(words.join(keys.hint("merge"), "key", "left_semi").mapInArrow(runs_of, "key long, h array<long>"), "paragraph-runs")
        one = own.select("key", F.explode("h").alias("h"))
        often = one.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
        # a paragraph has as many runs as words
        ordered = one.join(often, "h", "left").groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "h"))).alias("o"))
        sized = written(ordered.withColumn("size", F.size("o")), "paragraph-order")
        prefix = F.slice("o", 1, (F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1).cast("int"))
        rare = sized.select("key", F.posexplode(prefix).alias("pos", "x")).where("x.c > 1").select(F.col("x.h").alias("s"), "key", "pos")
        pairs = collisions(rare, sized.select("key", "size"), label, 1 - similarity)
        dropped(each, met, own, sized)
        return pairs

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [t.split() for t in batch.column(1).to_pylist()]
            lens = np.fromiter(map(len, own), np.int64, len(own))
            g, n = shingles(word_hashes([w.encode() for t in own for w in t]), lens) if len(own) else (np.zeros(0, np.uint64), lens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(g.view(np.int64)))], ["key", "h"])

    label = classes(members, verify, crowded)
    labelled = written(reps.join(label, reps["key"] == label["id"], "left").select("digest", "best", "times", F.coalesce("label", "key").alias("cluster")), "paragraph-labels")
    sizes = labelled.groupBy("cluster").agg(F.min("best").alias("first"), F.sum("times").alias("size")).where("size > 1")
    whole = written(labelled.join(sizes, "cluster").select("digest", "cluster", F.col("first.id").alias("keep_id"), F.col("first.key").alias("keep"), "size"), "paragraph-clusters")
    dropped(words, label, labelled)
    return found.select("key", "id", "line", "n_words", "digest").join(whole, "digest").select("id", F.lit("paragraph").alias("kind"), F.col("line").alias("start"), "n_words", F.col("cluster").alias("cluster_id"), "keep_id", F.col("size").alias("cluster_size"), (F.col("keep") == F.col("key")).alias("kept"))


def _settled(chunks: DataFrame, runs: DataFrame, cut: DataFrame) -> DataFrame:
    """Written: (doc, id, at, n, from_doc, from_at, kept) of stretches that really occur elsewhere: those that go with
    their first occurrences, and these, kept.

    Stretches whose words have another digest than those of their first occurrence are false: their windows and those
    that they were taken for are matched anew, by the digests of their words."""
    digests = cut.where("digest is not null").select("doc", "start", "n", "digest")
    own = digests.select("doc", F.col("start").alias("at"), "n", F.col("digest").alias("own"))
    first = digests.select(F.col("doc").alias("from_doc"), F.col("start").alias("from_at"), "n", F.col("digest").alias("theirs"))
    moved = runs.where("doc != from_doc or at != from_at")
    judged = written(moved.join(own, ["doc", "at", "n"]).join(first, ["from_doc", "from_at", "n"]).withColumn("equal", F.col("own") == F.col("theirs")).drop("own", "theirs"), "passage-judged")
    columns = ["doc", "id", "at", "n", "from_doc", "from_at"]
    others = judged.where("equal").select(*columns)
    ids = chunks.select(F.explode(F.arrays_zip("keys", "ids")).alias("k")).select(F.col("k.keys").alias("doc"), F.col("k.ids").alias("id"))
    wrong = judged.where("not equal").select("doc", F.explode("places").alias("w"), "at", "from_doc", "from_at")
    if wrong.limit(1).count():
        taken_for = wrong.select(F.col("from_doc").alias("doc"), (F.col("from_at") + F.col("w") - F.col("at")).alias("at"))
        places = written(wrong.select("doc", F.col("w").alias("at")).unionByName(taken_for).distinct(), "passage-wrong")
        again = cuts(chunks, places.select("doc", F.col("at").alias("start"), F.lit(WINDOW).alias("n"), F.lit(False).alias("whole")))
        told = places.join(ids, "doc").join(again.select("doc", F.col("start").alias("at"), "n", "digest"), ["doc", "at"])
        place = F.struct(F.col("id").isNull().alias("no_id"), "id", "doc", "at")
        first_of = written(told.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1"), "passage-again")
        anew = told.join(first_of, "digest").withColumns({"from_doc": F.col("first.doc"), "from_at": F.col("first.at")}).select(*columns)
        others = others.unionByName(anew.where("doc != from_doc or at != from_at"))
    named = others.select(F.col("from_doc").alias("doc"), F.col("from_at").alias("at"), "n").distinct()
    firsts = named.join(ids, "doc").withColumns({"from_doc": F.col("doc"), "from_at": F.col("at")}).select(*columns)
    found = written(others.withColumn("kept", F.lit(False)).unionByName(firsts.withColumn("kept", F.lit(True))), "passage-stretches")
    dropped(judged)
    return found


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, id, stretches sorted by kept, at) to (doc, id, kept, start, n_words, needs): overlapping stretches of a
    kind are one passage; needs are the places of the first occurrences of a passage that goes."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for row, (doc, parts) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            last = None
            for p in parts:
                if last is None or out[2][-1] != p["kept"] or p["at"] > last:
                    for column, x in zip(out, (doc, row, p["kept"], p["at"], 0, []), strict=True):
                        column.append(x)
                    last = p["at"]
                last = max(last, p["at"] + p["n"])
                out[4][-1] = last - out[3][-1]
                if not p["kept"]:
                    out[5][-1].append({"from_doc": p["from_doc"], "from_at": p["from_at"]})
        need = pa.list_(pa.struct([("from_doc", pa.int64()), ("from_at", pa.int32())]))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), batch.column(1).take(pa.array(out[1], pa.int64())), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32()), pa.array(out[5], need)], ["doc", "id", "kept", "start", "n_words", "needs"])


def _passages(stretches: DataFrame, kind: str) -> DataFrame:
    """The same columns for passages that repeat anywhere."""
    by_text = stretches.groupBy("doc").agg(F.first("id", ignorenulls=True).alias("id"), F.sort_array(F.collect_list(F.struct("kept", "at", "n", "from_doc", "from_at"))).alias("s"))  # no more than a text's windows
    each = by_text.mapInArrow(_joined, f"doc long, id {kind}, kept boolean, start int, n_words int, needs array<struct<from_doc: bigint, from_at: int>>")
    each = written(each.withColumn("key", F.monotonically_increasing_id()), "passages")
    needs = each.where("not kept").select("key", F.explode("needs").alias("x")).select("key", "x.from_doc", "x.from_at").distinct()
    # a stretch's first occurrence lies in one kept passage of its text
    origin = each.where("kept").groupBy(F.col("doc").alias("from_doc")).agg(F.collect_list(F.struct("start", "n_words", "key")).alias("own"))
    origin = written(origin, "passage-origins")
    inside = F.expr("filter(own, s -> s.start <= from_at and from_at < s.start + s.n_words)[0].key")
    edges = written(written(needs, "passage-needs").join(origin.hint("merge"), "from_doc").select("key", inside.alias("to")).distinct(), "passage-edges")
    label = components(edges, "key", "to")
    whole = written(each.join(label, each["key"] == label["id"], "left").select("key", each["id"], "start", "n_words", "kept", F.coalesce("label", "key").alias("cluster")), "passage-labels")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    sizes = written(whole.groupBy("cluster").agg(F.min(order).alias("best"), F.count("*").alias("size")), "passage-sizes")
    dropped(each, origin, edges, label)
    return whole.join(sizes, "cluster").select("id", F.lit("passage").alias("kind"), "start", "n_words", F.col("cluster").alias("cluster_id"), F.col("best.id").alias("keep_id"), F.col("size").alias("cluster_size"), "kept")


def repeated_paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS, hash_bits: int = 64) -> DataFrame:
    """One row for each occurrence of a paragraph or passage that repeats: id, kind, start, n_words, cluster_id,
    keep_id, cluster_size, kept.

    Words are runs of letters and digits in lower case. kind 'paragraph': a line of min_words words or more, or a block of
    successive shorter lines with as many, that is similar to another one; start is the number of its first line, from
    0, and the occurrence with the least id (null last), then line, is kept. kind 'passage': a stretch of words, start
    its first one, made of windows of 36 words that also occur elsewhere; all repeats of 51 words or more have one, none
    is shorter than 36. Of each window the occurrence with the least id is kept (ids that aren't integers: the first
    row), and a passage holds windows that are all kept or all not, so the kept ones lose no content. Repeats within a
    text count too. cluster_id numbers the clusters of a kind, without gaps or order. Null and empty texts have no
    paragraphs; rows that repeat an id are told apart by their place in the input; an empty table gives an empty
    result; other columns are ignored. hash_bits: how many bits of a window's hash are used (tests use few)."""
    kind = type_of(df, id_col)
    found = _split(df, id_col, text_col, similarity, min_words, 2**hash_bits - 1)
    chunks, paragraphs = found.where("chunk is not null"), found.where("chunk is null")

    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "line", "key", "doc", "start", "n_words")
    reps = paragraphs.groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("times"))
    reps = written(reps.withColumn("key", F.col("best.key")), "paragraph-texts")
    members = sharing(paragraphs.select("key", "sketch").join(reps.select("key").hint("merge"), "key", "left_semi"))

    met = repeated_values(chunks, chunks.agg(F.sum("n")).first()[0] or 0, 3)
    runs = written(chunks.select("chunk", "keys", "ids", "owner", "at", "same").join(met, "chunk").drop("chunk").mapInArrow(_runs, f"doc long, id {kind}, at int, n int, from_doc long, from_at int, places array<int>"), "passage-runs")
    moved = runs.where("doc != from_doc or at != from_at")

    similar = reps.join(members.select("key").distinct(), "key", "left_semi").select(F.col("best.doc").alias("doc"), F.col("best.start").alias("start"), F.col("best.n_words").alias("n"), F.lit(True).alias("whole"))
    ends = moved.select("doc", F.col("at").alias("start"), "n").unionByName(moved.select(F.col("from_doc").alias("doc"), F.col("from_at").alias("start"), "n")).withColumn("whole", F.lit(False))
    cut = cuts(chunks, similar.unionByName(ends))

    lines = _paragraphs(paragraphs, members, reps, cut, similarity)
    stretches = _settled(chunks, runs, cut)
    passages = _passages(stretches, kind)
    dropped(cut, members, reps, runs, stretches)
    return lines.unionByName(passages).withColumnRenamed("id", id_col)
