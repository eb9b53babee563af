"""Licence scan: TF-IDF cosine to templates, then inheritance from the nearest licensed directory.

Templates are short notices and the whole texts of licences (folder licence_texts). Template words get their document
frequencies from the whole corpus. A template slides over a text as a window of its own number of words, whatever the
line breaks, so what stands before or after a notice doesn't matter; the text's similarity is that of its best window,
and the whole text is compared too. A text is only looked at closely for templates that it can reach: the squared weights
of the template's words that it holds bound the cosine of any window, so nothing within the threshold is passed over.
Files without a licence of their own take that of the nearest directory above them that has a licence file: directories
are joined with their ancestors, then files with directories.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.llm.common import pieces_of, text_or_empty, type_of, written

THRESHOLD = 0.6
WHOLE = 0.9
SPDX = "spdx license identifier"
FILE_NAMES = r"(?i)^(un)?licen[cs]e(\.\w+)?$|^copying(\.\w+)?$|^notice(\.\w+)?$"
#: Short notices, as they stand in headers and tags.
NOTICES = {
    "Apache-2.0": [
        "licensed under the apache license version 2.0",
        "apache license version 2.0 january 2004",
        "apache 2.0",
    ],
    "MIT": [
        "released under the mit license",
        "licensed under the mit license",
        "mit license permission is hereby granted free of charge to any person obtaining a copy of this software",
        "mit",
    ],
    "GPL-3.0": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the gnu general public license version 3",
        "gpl 3.0",
    ],
    "GPL-2.0": [
        "this work is licensed under the gnu general public license version 2",
        "this program is free software you can redistribute it and or modify it under the gnu general public license version 2",
        "gpl 2.0",
    ],
    "LGPL-3.0": [
        "licensed under the gnu lesser general public license version 3",
        "lgpl 3.0",
    ],
    "AGPL-3.0": [
        "licensed under the gnu affero general public license version 3",
        "agpl 3.0",
    ],
    "BSD-3-Clause": [
        "licensed under the bsd 3 clause license",
        "released under the new bsd license",
        "bsd 3 clause",
    ],
    "BSD-2-Clause": [
        "licensed under the bsd 2 clause license",
        "released under the simplified bsd license",
        "bsd 2 clause",
    ],
    "MPL-2.0": [
        "subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
        "mpl 2.0",
    ],
    "CC-BY-4.0": [
        "licensed under cc by 4.0",
        "licensed under a creative commons attribution 4.0 international license",
    ],
    "CC-BY-SA-4.0": [
        "licensed under cc by sa 4.0",
        "licensed under a creative commons attribution sharealike 4.0 international license",
    ],
    "CC-BY-NC-4.0": [
        "licensed under cc by nc 4.0",
        "licensed under a creative commons attribution noncommercial 4.0 international license",
    ],
    "CC0-1.0": [
        "cc0 1.0 universal public domain dedication",
        "released under cc0 1.0",
    ],
    "Unlicense": [
        "this is free and unencumbered software released into the public domain",
        "released under the unlicense",
    ],
}
words_of = re.compile(r"[^\W_]+(?:\.\d+)*").findall


def licence_texts() -> dict[str, str]:
    """The whole texts of licences, by name."""
    folder = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licence_texts")
    found = {}
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            found[name.removesuffix(".txt")] = f.read()
    return found


def all_templates(notices: dict[str, list[str]], bodies: dict[str, str]) -> list[tuple[str, list[str]]]:
    """(licence, words) of each template; a notice of three words or fewer counts with an SPDX tag before it only."""
    found = [(name, words_of(t.lower())) for name, own in notices.items() for t in own]
    found = [(name, w if len(w) > 3 else [*words_of(SPDX), *w]) for name, w in found]
    return found + [(name, words_of(t.lower())) for name, t in bodies.items()]


def _grown(n: int) -> float:
    return 1 + math.log(n) if n else 0.0


class Templates:
    """TF-IDF vectors with logarithmic term frequencies. A word of no template weighs as one that all texts hold."""

    def __init__(self, templates: list[tuple[str, list[str]]], n_docs: int, df: dict[str, int], threshold: float) -> None:
        self.names, self.sizes, self.threshold = [t[0] for t in templates], [len(t[1]) for t in templates], threshold
        self.tags = [t[1][:3] == words_of(SPDX) for t in templates]
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1 for _, words in templates for w in words}
        self.number = {w: k for k, w in enumerate(self.idf)}
        self.vectors = [self.vector(words) for _, words in templates]
        self.squares = np.zeros((len(self.idf), len(templates)), np.float32)
        for k, v in enumerate(self.vectors):
            for w, x in v.items():
                self.squares[self.number[w], k] = x * x

    def vector(self, words: list[str]) -> dict[str, float]:
        v = {w: _grown(c) * self.idf.get(w, 1.0) for w, c in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    def cosine(self, k: int, words: list[str]) -> float:
        """Of template k and the best window of its length in the words."""
        template, size, idf = self.vectors[k], self.sizes[k], self.idf
        count: dict[str, int] = {}
        dot = norm = best = 0.0
        for at, w in enumerate(words):
            for x, step in ((w, 1), (words[at - size], -1)) if at >= size else ((w, 1),):
                c = count.get(x, 0)
                count[x] = c + step
                before, after, weight = _grown(c), _grown(c + step), idf.get(x, 1.0)
                dot += (after - before) * weight * template.get(x, 0.0)
                norm += (after * after - before * before) * weight * weight
            if (at >= size - 1 or at == len(words) - 1) and norm > 1e-9 and dot > best * math.sqrt(norm):
                best = dot / math.sqrt(norm)
        return best

    def judge(self, text: str) -> tuple[float, str, float]:
        """(similarity, licence) of the best template, and the similarity of the text as a whole to its best one that is no
        tag (a tag speaks of the file that it stands in); of equal ones that whose name sorts last."""
        words = words_of(text.lower())
        held = [self.number[w] for w in self.number.keys() & set(words)]
        near = np.flatnonzero(self.squares[held].sum(axis=0) >= self.threshold**2 - 1e-5).tolist() if held else []
        if not near:
            return 0.0, "", 0.0
        v = self.vector(words)
        whole = {k: sum(x * v.get(w, 0.0) for w, x in self.vectors[k].items()) for k in near}
        best, name = max(((max(whole[k], self.cosine(k, words)), self.names[k]) for k in near), key=lambda p: (round(p[0], 9), p[1]))
        return best, name, max((x for k, x in whole.items() if not self.tags[k]), default=0.0)


def license_scan(df: DataFrame, path_col: str, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, list[str]] = NOTICES, bodies: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of df: id, path, license, score, how, from_dir.

    score is the cosine of the best template (of those that can reach the threshold at all, else 0). how: 'header' (a
    notice or licence text somewhere in the text), 'file' (the whole text has a cosine of 0.9 to one that is no SPDX tag,
    or it is named like a licence file), 'inherited' from from_dir, or 'none' (license null). Of equal scores that of the name that sorts last
    counts. A directory with several licence files has that with the least path, then name. Null paths belong to no
    directory and inherit nothing; null and empty texts have no notice; texts of any length are searched whole; rows that
    repeat are judged each; an empty table gives an empty result; other columns are ignored."""
    spark, kind = df.sparkSession, type_of(df, id_col)
    templates = all_templates(notices, licence_texts() if bodies is None else bodies)
    vocabulary = frozenset(w for _, words in templates for w in words)
    texts = df.select(F.col(id_col), F.col(path_col).cast("string").alias("path"), text_or_empty(text_col).alias("t"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in batches:
            for _, part in pieces_of(batch.column(0)):
                for text in part:
                    seen.update(vocabulary.intersection(words_of(text.lower())))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(["", *seen], pa.string()), pa.array([n, *seen.values()], pa.int64())], ["word", "n"])

    counts = {r[0]: r[1] for r in texts.select("t").mapInArrow(frequencies, "word string, n long").groupBy("word").agg(F.sum("n")).collect()}  # a row for each template word
    known = spark.sparkContext.broadcast(Templates(templates, counts.get("", 0), counts, threshold))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = re.compile(FILE_NAMES).search
        for batch in batches:
            out = []
            for start, part in pieces_of(batch.column(2)):
                for path, text in zip(batch.column(1).slice(start, len(part)).to_pylist(), part, strict=True):
                    best, name, whole = known.value.judge(text)
                    is_file = whole >= WHOLE or bool(path and named(path.rsplit("/", 1)[-1]))
                    out.append((name, best, "file" if is_file else "header") if best >= threshold else (None, best, "none"))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.string()), strict=True))], ["id", "path", "own", "score", "how"])

    judged = written(texts.mapInArrow(judge, f"id {kind}, path string, own string, score double, how string").withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "licenses")
    granted = written(judged.where("how = 'file' and dir is not null").groupBy("dir").agg(F.min_by("own", F.struct("path", "own")).alias("given")), "license-dirs")
    folders = judged.where("how = 'none' and dir is not null").select("dir").distinct()
    above = folders.select("dir", F.explode(F.expr("transform(sequence(0, size(split(dir, '/'))), n -> struct(n as depth, concat_ws('/', slice(split(dir, '/'), 1, n)) as up))")).alias("a")).select("dir", "a.*")
    nearest = above.join(granted.select(F.col("dir").alias("up"), "given"), "up").groupBy("dir").agg(F.max_by(F.struct("up", "given"), "depth").alias("n"))
    nearest = written(nearest.select("dir", F.col("n.up").alias("from_dir"), "n.given"), "license-nearest")
    joined = judged.join(nearest, "dir", "left")
    inherits = (F.col("how") == "none") & F.col("given").isNotNull()
    return joined.select(F.col("id").alias(id_col), "path", F.coalesce("own", F.when(inherits, F.col("given"))).alias("license"), F.round("score", 6).alias("score"), F.when(inherits, F.lit("inherited")).otherwise(F.col("how")).alias("how"), F.when(inherits, F.col("from_dir")).alias("from_dir"))
