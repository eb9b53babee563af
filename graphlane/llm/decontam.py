"""Benchmark decontamination by greedy string tiling.

Runs of K words of a document that may be seeds pass a bit table of the benchmark's runs; what passes is joined with the
benchmark's runs on the words themselves, so no hash decides. An item needs not all of its runs for that: while those that
most documents hold cover less than the wanted share of its words, a document cannot reach the share by them alone, so
they are left out of the join and come back when a pair is tiled. For each pair greedy string tiling then searches the
longest match of unmarked words by running Karp-Rabin hashes of falling length, verifies it, marks it, and so on; what
share of the item's words is marked says whether the document holds it, in whatever order its parts come.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.llm.common import dropped, pieces_of, type_of, written
from graphlane.llm.hashing import INVERSE, grams, powers, word_hashes

K = 5
COVERAGE = 0.5
LEAST_BITS, MOST_BITS = 20, 27  # of the bit table's places
PIECE_BYTES = 2 << 20
words_of = re.compile(r"[^\W_]+").findall


def _numbers(batch: list[list[str]]) -> list[np.ndarray]:
    """Word hashes of each text; a distinct word of the batch is hashed once."""
    words: dict[str, int] = {}
    add = words.setdefault
    numbers = [np.fromiter([add(w, len(words)) for w in own], np.int64, len(own)) for own in batch]
    h = word_hashes([w.encode() for w in words])
    return [h[x] for x in numbers]


def _running(h: np.ndarray, open_: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of all runs of length unmarked words, and where these begin. open_: which words are unmarked."""
    if len(h) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(len(h)), dtype=np.uint64)])
    free = np.concatenate([[0], np.cumsum(open_)])
    at = np.flatnonzero(free[length:] - free[:-length] == length)
    return (sums[at + length] - sums[at]) * powers(len(h) + 1, INVERSE)[at], at


def _matches(text: list[str], item: list[str], ht: np.ndarray, hi: np.ndarray, open_t: np.ndarray, open_i: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(place in the item, place in the text) of verified common runs of length unmarked words, in that order; of each
    place in the item the first one in the text."""
    (a, at_a), (b, at_b) = _running(hi, open_i, length), _running(ht, open_t, length)
    order = np.argsort(b, kind="stable")
    b, at_b = b[order], at_b[order]
    low, high = np.searchsorted(b, a), np.searchsorted(b, a, "right")
    out = []
    for k in np.flatnonzero(low < high).tolist():
        i = int(at_a[k])
        for t in at_b[low[k] : high[k]].tolist():
            if text[t : t + length] == item[i : i + length]:
                out.append((i, t))
                break
    return out


def tiles(text: list[str], item: list[str], k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two lists of words by running Karp-Rabin: tiles (place in text, place in item, words).

    The longest common run of unmarked words is marked first; of equal ones that earliest in the item, then in the text.
    The search length falls by halves until something matches, then the longest length that still does is found by
    bisection, as a longer common run holds the shorter ones."""
    known: dict[str, int] = {}
    add = known.setdefault
    numbers = [np.array([add(w, len(known)) for w in own], np.int64) for own in (text, item)]
    h = word_hashes([w.encode() for w in known])
    ht, hi = (h[x] if len(x) else np.zeros(0, np.uint64) for x in numbers)
    open_t, open_i = np.ones(len(text), bool), np.ones(len(item), bool)
    found, most = [], min(len(text), len(item))
    while most >= k:
        length = most
        while not (hits := _matches(text, item, ht, hi, open_t, open_i, length)):
            if length == k:
                return found
            length = max(k, length // 2)
        low, high = length, most
        while low < high:
            mid = (low + high + 1) // 2
            if more := _matches(text, item, ht, hi, open_t, open_i, mid):
                low, hits = mid, more
            else:
                high = mid - 1
        most = low
        i, t = hits[0]
        found.append((t, i, most))
        open_i[i : i + most] = False
        open_t[t : t + most] = False
    return found


def _needed(runs: list[dict], n_words: int, k: int, coverage: float) -> list[str]:
    """The runs of an item that a document must hold one of, to hold the item: the rarest ones, such that the others
    cover less than the share; none if all that documents hold do. runs: at, run and n, in how many places of documents
    the run is."""
    places: dict[str, list[int]] = {}
    count: dict[str, int] = {}
    for r in runs:
        places.setdefault(r["run"], []).append(r["at"])
        count[r["run"]] = r["n"]
    covered = np.zeros(n_words, bool)
    order = sorted(places, key=lambda r: (-count[r], r))
    for j, run in enumerate(order):
        more = covered.copy()
        for at in places[run]:
            more[at : at + k] = True
        if more.sum() >= coverage * n_words - 1e-9:
            return order[j:]
        covered = more
    return []


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = K, coverage: float = COVERAGE) -> DataFrame:
    """One row for each contaminated pair of a row and an item: id, item, coverage, n_tiles, longest_tile.

    Words are runs of letters and digits in lower case. A row holds an item if tiles of k words or more cover at least
    the share coverage of the item's words; an item of fewer than k words must occur whole. Items without words match
    nothing, nor do null and empty texts. Items and rows that repeat are judged each (a repeated id then shows
    repeated rows); very long texts are searched whole; empty tables give an empty result; other columns are ignored. The
    bit table has 16 places for each of the benchmark's runs, 2**27 (16 MB) at most, beyond which more is let through to
    the join; the benchmark's runs themselves are joined, never broadcast by hint."""
    spark = df.sparkSession
    doc_kind, item_kind = type_of(df, id_col), type_of(benchmark, item_col)

    def item_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, texts in pieces_of(batch.column(1)):
                out, block = [], [words_of(t.lower()) for t in texts]
                for i, (own, h) in enumerate(zip(block, _numbers(block), strict=True)):
                    n, number = min(k, len(own)), number + 1
                    if own:
                        runs = [{"at": a, "run": " ".join(own[a : a + n])} for a in range(len(own) - n + 1)]
                        out.append((batch.column(0)[start + i].as_py(), number, n, " ".join(own), runs, grams(h, n).view(np.int64)))
                kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("at", pa.int32()), ("run", pa.string())])), pa.list_(pa.int64())]
                columns = list(zip(*out, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item", "item_key", "n", "words", "runs", "h"])

    items = written(benchmark.select(F.col(item_col), F.col(item_text).cast("string")).mapInArrow(item_runs, f"item {item_kind}, item_key long, n int, words string, runs array<struct<at: int, run: string>>, h array<long>"), "benchmark-runs")
    slots = items.select("n", F.explode("h").alias("h"))
    bits = min(max(LEAST_BITS, (16 * slots.count()).bit_length()), MOST_BITS)
    place = F.shiftrightunsigned("h", 64 - bits)
    pages = slots.select("n", place.alias("slot")).groupBy("n", F.expr("slot div 32768").alias("page")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("bits"))
    tables: dict[int, np.ndarray] = {}
    for n, page, own in pages.toLocalIterator():  # 4 KB each, 2**bits places for each of at most k lengths
        table = tables.setdefault(n, np.zeros(1 << (bits - 3), np.uint8))
        table[page * 4096 : page * 4096 + len(own)] = np.frombuffer(own, np.uint8)
    known = spark.sparkContext.broadcast(tables)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, texts in pieces_of(batch.column(1), PIECE_BYTES):
                at, of, found = [], [], []
                block = [words_of(t.lower()) for t in texts]
                for i, (own, h) in enumerate(zip(block, _numbers(block), strict=True)):
                    for n, table in known.value.items():
                        slot = (grams(h, n) >> np.uint64(64 - bits)).astype(np.int64)
                        hits = np.flatnonzero(table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).tolist()
                        at += hits
                        of += [start + i] * len(hits)
                        found += [" ".join(own[a : a + n]) for a in hits]
                if at:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array([row + x for x in of], pa.int64()), pa.array(found, pa.string()), pa.array(at, pa.int32())], ["doc", "doc_key", "run", "doc_at"])
            row += batch.num_rows

    found = written(df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(seeds, f"doc {doc_kind}, doc_key long, run string, doc_at int"), "benchmark-seeds")
    counts = found.groupBy("run").agg(F.count("*").alias("c"))
    each = items.select("item_key", "n", F.size(F.split("words", " ")).alias("n_words"), F.explode("runs").alias("r")).select("item_key", "n", "n_words", "r.at", "r.run")
    # an item has as many runs as it has words
    counted = each.join(counts, "run").groupBy("item_key", "n", "n_words").agg(F.collect_list(F.struct("at", "run", F.col("c").alias("n"))).alias("runs"))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for key, n, n_words, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _needed(runs, n_words, n, coverage if n == k else 1.0)
                keys += [key] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], ["item_key", "run"])

    keys = written(counted.mapInArrow(needed, "item_key long, run string"), "benchmark-keys")
    pairs = written(found.select("doc_key", "run").join(keys, "run").select("doc_key", "item_key").distinct(), "benchmark-pairs")
    # of a text the seeds of all items: no more than its words
    texts = found.join(pairs.select("doc_key").distinct(), "doc_key", "left_semi").groupBy("doc_key").agg(F.first("doc", ignorenulls=True).alias("doc"), F.collect_set(F.struct("doc_at", "run")).alias("seeds"))
    texts = written(texts, "benchmark-texts")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, covered, numbers, longest = [], [], [], []
            for row in range(batch.num_rows):
                n, item, spots = batch.column(2)[row].as_py(), batch.column(3)[row].as_py().split(" "), batch.column(4)[row].as_py()
                text: list[str] = []
                end = -1
                own = {" ".join(item[a : a + n]) for a in range(len(item) - n + 1)}
                for s in sorted((s["doc_at"], s["run"]) for s in spots if s["run"] in own):
                    words = s[1].split(" ")
                    if s[0] > end:  # between stretches stands a word that no item has
                        text.append("")
                        end = s[0]
                    text += words[end - s[0] :]
                    end = s[0] + len(words)
                tiling = tiles(text, item, n)
                share = sum(x[2] for x in tiling) / len(item)
                if share >= (coverage if n == k else 1.0) - 1e-9:
                    docs.append(row), covered.append(share), numbers.append(len(tiling)), longest.append(max(x[2] for x in tiling))
            taken = pa.array(docs, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(covered, pa.float64()), pa.array(numbers, pa.int32()), pa.array(longest, pa.int32())], [id_col, item_col, "coverage", "n_tiles", "longest_tile"])

    both = pairs.join(texts.hint("merge"), "doc_key").join(items.select("item_key", "item", "n", "words"), "item_key").select("doc", "item", "n", "words", "seeds")
    result = written(both.mapInArrow(tiled, f"`{id_col}` {doc_kind}, `{item_col}` {item_kind}, coverage double, n_tiles int, longest_tile int"), "benchmark-tiled")
    dropped(items, found, keys, pairs, texts)
    return result


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df whose id has no contaminated pair, with all columns of df."""
    found = contamination(df, benchmark, id_col, text_col, **options).select(F.col(id_col).alias("gl_hit")).distinct()
    return df.join(found, df[id_col].eqNullSafe(found["gl_hit"]), "left_anti")
