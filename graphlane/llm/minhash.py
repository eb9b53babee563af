"""Near-duplicate detection with Order MinHash and banded alignment.

A document's k-mers are its runs of five words, each labelled with its occurrence number. For each of M hash functions
the ELL labelled k-mers with the least hashes are kept in text order; together they are a sketch (Order MinHash). Texts
that agree in one sketch are candidates. A changed word spoils five runs, which leaves short texts too few, so texts below
50 words are sketched by runs of two words and texts below 12 by single words, with more of them in a sketch; texts
whose partners may be on the other side of such a bound are sketched both ways. A pair is a link if the word edit distance,
found by banded bit-parallel alignment, is at most 20 % of the longer text. Classes are the components of all links;
graphlane.llm.linking says in which order candidates are aligned and how crowded sketches are met.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlane.llm.common import dropped, pieces_of, text_or_empty, written
from graphlane.llm.hashing import BASE, grams, mix, word_hashes
from graphlane.llm.linking import HELD, classes, collisions, crowds, held, rarest, sharing

M = 64
SIMILARITY = 0.8
#: (words of a k-mer, k-mers of a sketch, least and most words of the texts that are sketched so)
SCHEMES = [(1, 4, 4, 11), (2, 3, 9, 49), (5, 2, 40, 1 << 62)]
BLOCK_WORDS = 1 << 16
words_of = re.compile(r"[^\W_]+").findall
_SEEDS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**31, M, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def labelled_grams(h: np.ndarray, lens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The occurrence-labelled k-mers of texts that follow each other in h (word hashes), and where each text's begin;
    all texts have k words or more. A k-mer that repeats in its text gets another hash each time."""
    ends = np.cumsum(lens)
    inside = np.ones(len(h) - k + 1, bool)
    for j in range(1, k):
        inside[ends[:-1] - j] = False
    g = grams(h, k)[inside]
    n = lens - k + 1
    start = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(lens)), n)
    own = g ^ mix(owner.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(own)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(again):
        at = np.flatnonzero(np.isin(own, again))
        by = at[np.argsort(own[at], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], own[by][1:] != own[by][:-1]]))
        label = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        g[by] = np.where(label == 0, g[by], mix(g[by] + label.astype(np.uint64) * np.uint64(BASE)))
    return g, start


def order_minhash(h: np.ndarray, lens: np.ndarray, k: int, ell: int, m: int = M) -> np.ndarray:
    """The m sketches (columns) of each text (rows); texts follow each other in h and have k + ell - 1 words or more."""
    g, start = labelled_grams(h, lens, k)
    n = np.diff(np.append(start, len(g)))
    low = (g & np.uint64(2**32 - 1)).astype(np.uint32)
    out = np.empty((len(lens), m), np.uint64)
    for s in range(m):
        x = low * _SEEDS[s]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        picked = np.empty((ell, len(lens)), np.int64)
        for e in range(ell):
            least = np.minimum.reduceat(x, start)
            at = np.flatnonzero(x == np.repeat(least, n))
            if len(at) > len(lens):  # equal hashes in a text: the first one
                of = np.searchsorted(start, at, "right")
                at = at[np.concatenate([[True], of[1:] != of[:-1]])]
            picked[e] = at
            x[at] = np.uint32(2**32 - 1)
        picked.sort(axis=0)
        value = np.full(len(lens), k * 1000 + s, np.uint64)
        for e in range(ell):
            value = value * np.uint64(BASE) + g[picked[e]]
        out[:, s] = mix(value)
    return out


def sketches(texts: list[np.ndarray]) -> list[bytes]:
    """Of each text, given as word hashes, the sketches of all schemes that take its length."""
    found: list[list[bytes]] = [[] for _ in texts]
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    for k, ell, least, most in SCHEMES:
        rows = np.flatnonzero((lens >= least) & (lens <= most))
        size = np.cumsum(lens[rows])
        start = 0
        while start < len(rows):
            stop = max(int(np.searchsorted(size, (size[start - 1] if start else 0) + BLOCK_WORDS, "right")), start + 1)
            own = rows[start:stop]
            for i, x in zip(own.tolist(), order_minhash(np.concatenate([texts[i] for i in own]), lens[own], k, ell), strict=True):
                found[i].append(x.tobytes())
            start = stop
    return [b"".join(x) for x in found]


def _banded(a: list[int], b: list[int], limit: int) -> bool:
    """Whether the edit distance is at most limit: bit-parallel alignment inside the band of limit diagonals either
    side (Hyyroe 2003), the band's column held in one integer."""
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return False
    width = 2 * limit + 2
    ones = (1 << width) - 1
    places: dict[int, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    vp, vn, distance = ones >> (width - limit - 1) << (width - limit - 1), 0, limit
    diagonal, horizontal = 1 << (width - 1), 1 << (width - 2)
    start, most = limit + 1 - width, limit + m - (n - limit)
    for i, c in enumerate(b):
        p = places.get(c, 0)
        if p:
            p = (p >> start if start >= 0 else p << -start) & ones
        d0 = ((((p & vp) + vp) ^ vp) | p | vn) & ones
        hp = vn | (~(d0 | vp) & ones)
        hn = d0 & vp
        if i < n - limit:
            if not d0 & diagonal:
                distance += 1
        else:
            if hp & horizontal:
                distance += 1
            elif hn & horizontal:
                distance -= 1
            horizontal >>= 1
        if distance > most:
            return False
        d0 >>= 1
        vp = hn | (~(d0 | hp) & ones)
        vn = d0 & hp
        start += 1
    return distance <= limit


def similar(a: list, b: list, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - (word edit distance) / (words of the longer text) is at least similarity."""
    limit = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    known: dict = {}
    add = known.setdefault
    x, y = [add(w, len(known)) for w in a], [add(w, len(known)) for w in b]
    end, n = min(len(x), len(y)), 0
    while n < end and x[n] == y[n]:
        n += 1
    x, y = x[n:], y[n:]
    end, n = min(len(x), len(y)), 0
    while n < end and x[-1 - n] == y[-1 - n]:
        n += 1
    x, y = x[: len(x) - n], y[: len(y) - n]
    if not x or not y:
        return True
    if len(x) < len(y):
        x, y = y, x
    if len(x) <= limit:
        return True
    more = np.bincount(x, minlength=len(known)) - np.bincount(y, minlength=len(known))
    if max(more.clip(0).sum(), (-more).clip(0).sum()) > limit:  # words that one of them lacks
        return False
    return limit > 64 and _banded(x, y, 32) or _banded(x, y, limit)


def _labelled_words(texts: pa.Array, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The occurrence-labelled runs of k words of texts, and how many each has; texts of more than HELD words count as empty."""
    found, lens = [np.zeros(0, np.uint64)], []
    for _, part in pieces_of(texts):
        words: dict[str, int] = {}
        add = words.setdefault
        numbers = [[add(w, len(words)) for w in own] if k <= len(own) <= HELD else [] for own in (words_of(t.lower()) for t in part)]
        lens += [max(len(x) - k + 1, 0) for x in numbers]
        n = np.array([len(x) for x in numbers if x], np.int64)
        if len(n):
            found.append(labelled_grams(word_hashes([w.encode() for w in words])[[i for x in numbers for i in x]], n, k)[0])
    return np.concatenate(found), np.array(lens, np.int64)


def _labelled_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Those of two words. An edit changes two of them at most, an inserted word one of the shorter text."""
    return _labelled_words(texts, 2)


def _sketched(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written: gl_rec, gl_id, gl_key (unique), gl_digest (null without words), gl_sketch, gl_size (words), gl_held."""
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("gl_rec"), F.col(id_col).alias("gl_id"))
    at = df.columns.index(text_col)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 32
        for whole in batches:
            for start, part in pieces_of(whole.column(0).flatten()[at].cast(pa.string())):
                texts = [words_of(t.lower()) for t in part]
                words: dict[str, int] = {}
                add = words.setdefault
                numbers = [np.fromiter([add(w, len(words)) for w in own], np.int64, len(own)) for own in texts]
                h = word_hashes([w.encode() for w in words])
                digests = [hashlib.blake2b(" ".join(own).encode(), digest_size=16).digest() if own else None for own in texts]
                hashed = [h[x] for x in numbers]
                lens = np.fromiter(map(len, hashed), np.int64, len(hashed))
                yield pa.RecordBatch.from_arrays([*whole.slice(start, len(part)).columns, pa.array(range(row, row + len(part)), pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches(hashed), pa.binary()), pa.array(lens, pa.int32()), pa.array([held(x) for x in hashed], pa.binary())], ["gl_rec", "gl_id", "gl_key", "gl_digest", "gl_sketch", "gl_size", "gl_held"])
                row += len(part)

    out = T.StructType([*rows.schema.fields, T.StructField("gl_key", T.LongType()), T.StructField("gl_digest", T.BinaryType()), T.StructField("gl_sketch", T.BinaryType()), T.StructField("gl_size", T.IntegerType()), T.StructField("gl_held", T.BinaryType())])
    return written(rows.mapInArrow(sketch, out), "omh-sketch")


def _classes(df: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and (gl_digest, class_best, class_size) of texts that have words."""
    rows = _sketched(df, id_col, text_col)
    order = F.struct(F.col("gl_id").isNull().alias("no_id"), F.col("gl_id").alias("id"), F.col("gl_key").alias("key"))
    reps = rows.where("gl_digest is not null").groupBy("gl_digest").agg(F.min(order).alias("best"), F.count("*").alias("n"))
    reps = written(reps.select("gl_digest", "best", "n", F.col("best.key").alias("key")), "omh-texts")
    own = rows.select(F.col("gl_key").alias("key"), F.col("gl_sketch").alias("sketch"), F.col("gl_size").alias("size"), F.col("gl_held").alias("held"))
    things = own.join(reps.select("key").hint("merge"), "key", "left_semi")

    def verify(pairs: DataFrame) -> DataFrame:
        keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        texts = written(rows.select(F.col("gl_key").alias("key"), text_or_empty(f"gl_rec.{text_col}").alias("text")).join(keys.hint("merge"), "key", "left_semi"), "omh-candidates")
        left, right = texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
        # the candidates grow with the input, so texts are joined in the same way at every size
        both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb")
        links = written(both.mapInArrow(lambda it: _aligned(it, similarity), "a long, b long"), "omh-links")
        dropped(texts)
        return links

    def collide(members: DataFrame, known: DataFrame) -> DataFrame:
        """Members of crowds meet by their rarest runs of two words, or words. Texts of more than HELD words, which have too many of these, meet
        each other and what is nearly as long in blocks."""
        bound, crowd = 1 - similarity, crowds(members, known)
        scattered, sized = members, None
        if crowd.head(1):
            crowded = members.join(crowd, "s", "left_semi")
            sized = written(crowded.select("key").distinct().join(own.select("key", "size"), "key"), "omh-crowded")  # of no others
            keys = sized.where(F.col("size") <= HELD).select("key")
            long = crowded.join(sized.where(F.col("size") > int(similarity * HELD)), "key", "left_semi")
            rest = members.join(crowd, "s", "left_anti").unionByName(long.select(*members.columns))
            contents = rows.select(F.col("gl_key").alias("key"), text_or_empty(f"gl_rec.{text_col}").alias("content"))
            scattered = rest.unionByName(rarest(contents, keys, bound, _labelled_words, _labelled_runs if bound <= 0.5 else None))
        pairs = collisions(scattered, own, known, bound, lambda a, b: similar(a, b, similarity))
        dropped(crowd, sized)
        return pairs

    members = sharing(things)
    label = classes(members, verify, collide)
    joined = written(reps.join(label, reps["key"] == label["id"], "left").select("gl_digest", "best", "n", F.coalesce("label", "key").alias("label")), "omh-classes")
    whole = joined.groupBy("label").agg(F.min("best").alias("class_best"), F.sum("n").alias("class_size"))
    whole = written(joined.join(whole, "label").select("gl_digest", "class_best", "class_size"), "omh-members")
    dropped(reps, members, joined, label)
    return rows, whole


def _aligned(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose texts are similar."""
    for batch in batches:
        last: tuple = (None, None)
        ok = []
        for start, texts in pieces_of(batch.column(2)):
            for k, ta in enumerate(texts, start):
                b = batch.column(1)[k]
                if last[0] != b:
                    last = b, words_of(batch.column(3)[k].as_py().lower())
                ok.append(similar(words_of(ta.lower()), last[1], similarity))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_())), batch.column(1).filter(pa.array(ok, pa.bool_()))], ["a", "b"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of df: id, class_id, class_size, kept.

    Words are runs of letters and digits in lower case; texts with the same words are in one class, and so are texts
    that verified links connect. class_id is the least id of the class and that row is kept (null ids come last; of
    rows that tie, one is kept). Null texts and texts without words are classes of their own. Rows that repeat share a
    class. An empty table gives an empty result; other columns are ignored. Candidates are texts that agree in a
    sketch, all of them; similar texts that agree in none of their M sketches (README: how many) stay unlinked, and none
    is linked unverified."""
    rows, members = _classes(df.select(F.col(id_col), F.col(text_col)), id_col, text_col, similarity)
    joined = rows.select("gl_id", "gl_key", "gl_digest").join(members, "gl_digest", "left")
    alone = F.col("class_best").isNull()
    return joined.select(F.col("gl_id").alias(id_col), F.when(alone, F.col("gl_id")).otherwise(F.col("class_best.id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), (alone | (F.col("class_best.key") == F.col("gl_key"))).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df that near_duplicates keeps, with all columns of df."""
    rows, members = _classes(df, id_col, text_col, similarity)
    best = members.select(F.col("class_best.key").alias("gl_key")).distinct()
    empty = rows.where("gl_digest is null").select("gl_rec.*")
    return rows.where("gl_digest is not null").join(best, "gl_key", "left_semi").select("gl_rec.*").unionByName(empty)
