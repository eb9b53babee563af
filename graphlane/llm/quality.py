"""Quality classifier on supervised subword embeddings.

A document is the mean of the learned vectors of its features: words, character n-grams of words, pairs of successive
words, all hashed into a table of fixed size, and a mark for a word that repeats the one before. A softmax layer reads
that mean. One task trains both by stochastic gradient descent in numpy on a bounded sample of labelled rows. As the output
is linear in the mean, scoring needs one number for each feature: the executors get a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.llm.common import pieces_of, text_or_empty, type_of
from graphlane.llm.hashing import BASE, CODES, mix, word_hashes

BUCKETS = 1 << 18
DIM = 8
SAMPLE_ROWS = 6000
EPOCHS = 6
PIECE_BYTES = 4 << 20
REPEAT = BUCKETS  # the row of the mark


def _char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the character 3- and 4-grams of <word>, and the word each belongs to."""
    marked = [b"<" + w + b">" for w in words]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    code = CODES[np.frombuffer(b"".join(marked), np.uint8)]
    owner = np.repeat(np.arange(len(words)), lens)
    ids, of = [], []
    for n in (3, 4):
        if len(code) < n:
            continue
        m = len(code) - n + 1
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(BASE) + code[j : j + m]
        inside = owner[:m] == owner[n - 1 :]
        ids.append((mix(h[inside]) % np.uint64(BUCKETS)).astype(np.int64))
        of.append(owner[:m][inside])
    return np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, np.int64), *of])


def _pairs(h: np.ndarray) -> np.ndarray:
    """Feature numbers of successive words."""
    a, b = h[:-1], h[1:]
    ids = (mix(a * np.uint64(BASE) + b) % np.uint64(BUCKETS)).astype(np.int64)
    return np.where(a == b, REPEAT, ids)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of a text and how often each occurs."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    h = word_hashes(words)
    return np.unique(np.concatenate([(h % np.uint64(BUCKETS)).astype(np.int64), _char_grams(words)[0], _pairs(h)]), return_counts=True)


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """The number of each feature, and the output for no feature, from (text, 0 or 1). One class only: a constant."""
    rng = np.random.default_rng(seed)
    labels = [y for _, y in rows]
    share = (sum(labels) + 1) / (len(labels) + 2)
    bias = np.log([1 - share, share])
    table, out = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM)).astype(np.float32), np.zeros((2, DIM))
    if 0 < sum(labels) < len(labels):
        data = [(ids, (c / c.sum()).astype(np.float32), y) for (ids, c), y in ((features(t), y) for t, y in rows) if len(ids)]
        steps, step = epochs * len(data), 0
        for _ in range(epochs):
            for k in rng.permutation(len(data)):
                ids, w, y = data[k]
                rate, step = 0.5 * (1 - step / steps), step + 1
                own = table[ids]
                mean = w @ own
                z = out @ mean + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                g = -p
                g[y] += 1
                back = (g @ out).astype(np.float32)
                out += rate * np.outer(g, mean)
                bias = bias + rate * 0.1 * g
                table[ids] = own + (40 * rate) * w[:, None] * back
    return (table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def score_texts(texts: list[str], weight: np.ndarray, bias: float) -> list[float]:
    """Of each text the probability of label 1."""
    words: dict[bytes, int] = {}
    add = words.setdefault
    numbers = [np.array([add(w, len(words)) for w in t.encode().split()], np.int64) for t in texts]
    names = list(words)
    h = word_hashes(names)
    ids, of = _char_grams(names)
    total = np.bincount(of, weight[ids], len(names)) + weight[(h % np.uint64(BUCKETS)).astype(np.int64)]
    count = np.bincount(of, minlength=len(names)) + 1
    scores = []
    for own in numbers:
        z = bias
        if len(own):
            z += (total[own].sum() + weight[_pairs(h[own])].sum()) / (count[own].sum() + len(own) - 1)
        scores.append(float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0)))))
    return scores


def sample(df: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: int) -> DataFrame:
    """t and y (0 or 1) of at most rows labelled texts, in one partition and in the order of their ids: those whose ids
    have the least hashes; rows bounds what its task reads."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    texts = df.select(F.col(id_col), text_or_empty(text_col).alias("t")).join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.min("t").alias("t"), F.max("y").alias("y"))
    return texts.repartition(1).sortWithinPartitions(id_col).select("t", F.col("y").cast("int").alias("y"))


def trained(rows: DataFrame) -> tuple[np.ndarray, float]:
    """What train makes of rows (t, y), which are in one partition: the driver holds neither texts nor features."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = train([(t, y) for batch in batches for t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weight", "bias"])

    found = rows.mapInArrow(learn, "weight binary, bias double").collect()
    return (np.frombuffer(found[0]["weight"], np.float32), found[0]["bias"]) if found else train([])


def quality_scores(df: DataFrame, labels: DataFrame, learn_from, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The columns of df and score (0 to 1, higher: label 1 likelier), from the texts alone.

    labels: id and label (0 or 1); other values, null ids and ids without a text teach nothing, and an id that is
    labelled twice counts as 1. learn_from: a condition on the id that marks the labels to learn from. The model learns
    from at most sample_rows of them, chosen by a hash of the id, so training and what is sent to executors don't grow
    with the input. Null and empty texts get the score of no words; without labels every score is 0.5. A column score
    of df is replaced."""
    weight, bias = trained(sample(df, labels.where(learn_from), label, id_col, text_col, sample_rows))
    model = df.sparkSession.sparkContext.broadcast((weight, bias))
    kept = [c for c in df.columns if c.lower() != "score"]
    rows = df.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [x for _, part in pieces_of(batch.column(at), PIECE_BYTES) for x in score_texts(part, *model.value)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return rows.mapInArrow(score, ", ".join([f"`{c}` {type_of(df, c)}" for c in kept] + ["score double"]))
