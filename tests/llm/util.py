"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

from graphlane.llm.minhash import words_of

SCHEMA = "doc_id long, text string, lang string, score double, gl_id long, key long, id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.5, 1, 2, "x") for i, t in rows], SCHEMA)


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def edge_rows():
    rng = random.Random(3)
    long = prose(rng, 20_000)
    text = prose(rng, 120)
    return [(1, text), (2, None), (3, ""), (4, text), (4, text), (None, "no id at all"), (5, "  \t\n "), (6, long), (7, text.replace(" ", "\n")), (8, "ünï çødé 漢字 \U0001f600"), (9, "short"), (10, "!!! ..."), (None, None)]


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def components_of(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def words(text):
    return words_of((text or "").lower())
