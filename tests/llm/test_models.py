import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphlane.llm import quality
from graphlane.llm.bpe import encode_and_decode
from graphlane.llm.common import bucket_of
from graphlane.llm.decontam import contamination, drop_contaminated, tiles
from graphlane.llm.langid import Parser, identify, letters
from graphlane.llm.licenses import NOTICES, Templates, all_templates, license_scan, licence_texts, words_of
from graphlane.llm.quality import quality_scores
from graphlane.llm.sharding import consistent_shards
from tests.llm.util import SCHEMA, docs, edge_rows, prose

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held_out = bucket_of("doc_id", 3) == 1
    scored = quality_scores(table, labels, ~held_out)
    assert scored.columns == [*table.columns, "score"] and scored.count() == table.count()
    both = scored.join(labels, "doc_id").where(held_out).select("score", "quality").collect()
    assert len(both) > 50 and sum((r.score >= 0.5) == (r.quality == 1) for r in both) / len(both) > 0.95


def test_quality_is_trained_in_a_task_and_not_on_the_driver(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, prose(rng, 30, 50 if i % 2 else 400)) for i in range(60)]
    want = quality.train([(t, i % 2) for i, t in sorted(rows)[:40]])
    table, labels = docs(spark, rows[::-1]), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "features", None)  # of the driver's module
    got = {r.doc_id: r.score for r in quality_scores(table, labels, F.lit(True)).collect()}
    assert [got[i] for i, _ in rows] == pytest.approx(quality.score_texts([t for _, t in rows], *want))


def test_quality_bears_edge_cases(spark):
    table = docs(spark, edge_rows())
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 1), (3, 7), (77, 0)], "doc_id long, quality int")
    got = quality_scores(table, labels, F.lit(True))
    assert got.count() == table.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert {r[0] for r in quality_scores(table, labels.limit(0), F.lit(True)).select("score").collect()} == {0.5}
    assert quality_scores(docs(spark, []), labels, F.lit(True)).count() == 0


def longest_matches(reference, text):
    n = at = 0
    while at < len(text):
        k = at
        while k < len(text) and text[at : k + 1] in reference:
            k += 1
        n, at = n + 1, max(k, at + 1)
    return n


def test_texts_are_parsed_into_longest_matches():
    """Exactly as a naive parse does, however texts are cut into segments."""
    import numpy as np

    rng = random.Random(1)
    for _ in range(150):
        references = {k: "".join(rng.choice("abcdé "[: rng.randrange(2, 7)]) for _ in range(rng.randrange(0, 60))) for k in "xyz"[: rng.randrange(1, 4)]}
        texts = ["".join(rng.choice("abcdX ") for _ in range(rng.randrange(0, 45))) for _ in range(15)]
        got = Parser(references).phrases([np.array([ord(c) for c in t], np.uint32) for t in texts], rng.randrange(1, 12))
        assert got.tolist() == [[longest_matches(references[k], t) for k in sorted(references)] for t in texts]


def test_letters_are_those_of_unicode():
    found = ["".join(map(chr, x)) for x in letters(["½ ² Ⅷ", "हिन्दी a1b", "", "  x. y", "\u0301a", "Straße", "42", "漢字"])]
    assert found == ["", " हिन्दी a b ", "", " x y ", " a ", " straße ", "", " 漢字 "]


def test_languages_of_held_out_rows(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    held_out = bucket_of("doc_id", 4) == 2
    got = identify(table, ~held_out).join(table.select("doc_id", "lang"), "doc_id").where(held_out).where("lang is not null").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_languages_bear_edge_cases(spark):
    table = docs(spark, edge_rows())
    got = identify(table, F.lit(True)).collect()
    assert len(got) == table.count()
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (2, 3, 5, 10)) and all(r.lang_pred == "en" for r in got if r.doc_id in (1, 9))
    assert {r.lang_pred for r in identify(table, F.lit(False)).collect()} == {"und"}
    odd = docs(spark, [(1, "½ ² Ⅷ"), (2, "plain words"), (3, "x" * 300_000)])
    assert [(r.doc_id, r.lang_pred) for r in identify(odd, F.col("doc_id") == 2).orderBy("doc_id").collect()] == [(1, "und"), (2, "en"), (3, "en")]
    assert {r.lang_pred for r in identify(docs(spark, [(3, "word " * 30_000)]), F.lit(True)).collect()} == {"en"}  # only a long text to learn from
    assert identify(docs(spark, []), F.lit(True)).count() == 0


def brute_tiles(text, item, k):
    open_t, open_i, out = [True] * len(text), [True] * len(item), []
    while True:
        best = None
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and open_i[i + n] and open_t[t + n]:
                    n += 1
                if n >= k and (best is None or n > best[0]):
                    best = n, i, t
        if best is None:
            return out
        n, i, t = best
        out.append((t, i, n))
        for j in range(n):
            open_i[i + j] = open_t[t + j] = False


def test_tiles_are_those_of_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        k = rng.randrange(1, 5)
        text, item = ([rng.choice("abc") for _ in range(rng.randrange(0, n))] for n in (40, 25))
        assert tiles(text, item, k) == brute_tiles(text, item, k)


def test_contamination_is_that_of_brute_force(spark):
    """Items with runs that most documents hold, documents with parts of items in any order, one of them very long."""
    rng = random.Random(4)
    hot = prose(rng, 9, 5000).split()
    items = [[*hot, *prose(rng, rng.randrange(8, 25), 5000).split()] for _ in range(12)]
    rows = []
    for i in range(80):
        parts = [prose(rng, 12, 5000).split(), list(hot)]
        for item in rng.sample(items, 2):
            a = rng.randrange(len(item))
            parts += [item[a:], item[: rng.randrange(len(item))]]
        rng.shuffle(parts)
        rows.append((i, " ".join(w for p in parts for w in p)))
    rows.append((100, prose(rng, 20_000) + " " + " ".join(items[0])))
    bench = spark.createDataFrame([(k, " ".join(own)) for k, own in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.coverage, 9), r.n_tiles) for r in contamination(docs(spark, rows), bench).collect()}
    want = {}
    for i, t in rows[:-1]:
        for k, item in enumerate(items):
            own = brute_tiles(t.split(), item, 5)
            if sum(n for _, _, n in own) >= 0.5 * len(item):
                want[i, k] = round(sum(n for _, _, n in own) / len(item), 9), len(own)
    assert {k: v for k, v in got.items() if k[0] < 100} == want and len(want) > 20
    assert got[100, 0] == (1.0, 1)


def test_contamination(spark):
    rng = random.Random(2)
    item = prose(rng, 40, 5000).split()
    mixed = " ".join(item[20:40]) + " between " + " ".join(item[:20])  # reordered halves
    few = " ".join(item[:15])
    rows = [(1, f"before {' '.join(item)} after"), (2, mixed), (3, few), (4, None), (5, ""), (6, prose(rng, 300, 5000)), (7, "Tiny item"), (7, "Tiny item"), (None, " ".join(item)), (8, "tiny other")]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "tiny ITEM"), (2, None), (3, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contamination(docs(spark, rows), bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (None, 0), (7, 1)}
    assert got[1, 0].coverage == 1.0 == got[2, 0].coverage and got[2, 0].n_tiles == 2 and got[1, 0].n_tiles == 1
    left = drop_contaminated(docs(spark, rows), bench)
    assert left.columns == docs(spark, []).columns and {r.doc_id for r in left.collect()} == {3, 4, 5, 6, 8}
    assert contamination(docs(spark, []), bench).count() == 0 == contamination(docs(spark, rows), bench.limit(0)).count()


def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/c.py", "code"), ("a/x.py", "# SPDX-License-Identifier: Apache-2.0\ncode"), ("z/c.py", "nothing"), (None, "Released under the MIT License."), ("d/e.py", None), ("", ""), ("q/t.txt", "words\nThis work is licensed under the GNU General Public License, version 3.\nmore")]
    table = spark.createDataFrame([(i, p, t, "x", 1.0) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, dir string, score double")
    got = {r.doc_id: (r.license, r.how, r.from_dir) for r in license_scan(table, "path").collect()}
    assert got[0][:2] == ("MIT", "file") and got[1] == ("MIT", "inherited", "a") and got[2][:2] == ("Apache-2.0", "header")
    assert got[3][0] is None and got[4][:2] == ("MIT", "file") and got[5][0] is None and got[6][0] is None and got[7][0] == "GPL-3.0"
    assert license_scan(table.limit(0), "path").count() == 0


def test_a_tag_is_no_licence_of_its_directory(spark):
    tag = "# SPDX-License-Identifier: Apache-2.0"
    rows = [(0, "a/x.py", f"{tag}\ncode"), (1, "a/y.py", "nothing"), (2, "b/x.py", tag), (3, "b/y.py", "nothing"), (4, "c/LICENSE", tag), (5, "c/y.py", "nothing")]
    got = {r.doc_id: (r.license, r.how) for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), "path").collect()}
    assert got[0] == got[2] == ("Apache-2.0", "header") and got[1] == got[3] == (None, "none")
    assert got[4] == ("Apache-2.0", "file") and got[5] == ("Apache-2.0", "inherited")


def test_windows_have_the_cosines_of_brute_force():
    import math

    rng = random.Random(5)
    templates = all_templates(NOTICES, licence_texts())
    known = Templates(templates, 1000, {w: rng.randrange(1000) for _, words in templates for w in words}, 0.6)

    def cosine(a, b):
        x, y = ({w: (1 + math.log(c)) * known.idf.get(w, 1.0) for w, c in Counter(own).items()} for own in (a, b))
        return sum(v * y.get(w, 0.0) for w, v in x.items()) / (math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values())))

    for _ in range(60):
        k = rng.randrange(len(templates))
        part = templates[k][1][: rng.randrange(1, 60)]
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 30))] + part + [rng.choice(part) for _ in range(rng.randrange(0, 30))]
        size = known.sizes[k]
        want = max(cosine(words[a : a + size], templates[k][1]) for a in range(max(len(words) - size, 0) + 1))
        assert abs(known.cosine(k, words) - want) < 1e-9
        best = max(max(cosine(words[a : a + known.sizes[j]], templates[j][1]) for a in range(max(len(words) - known.sizes[j], 0) + 1)) for j in range(len(templates)))
        got = known.judge(" ".join(words))[0]
        assert abs(got - best) < 1e-9 or max(got, best) < 0.6


def test_licence_texts_are_found_whole_and_inside(spark):
    rng = random.Random(6)
    bodies = licence_texts()
    rows = [(k, f"d{k}/{'LICENSE.txt' if k % 2 else 'x.c'}", f"Copyright 2024 Acme Corp\n{t}") for k, t in enumerate(bodies.values())]
    rows += [(100, "e/a.c", f"{prose(rng, 300)} {bodies['MIT']} {prose(rng, 20_000)}"), (101, "e/b.c", "/* Copyright 2024 Acme Corp. All rights reserved. Licensed under the Apache License, Version 2.0. See there. */"), (102, "e/b.c", prose(rng, 20_000)), (102, "e/b.c", prose(rng, 20))]
    got = {r.doc_id: (r.license, r.how) for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), "path").collect()}
    assert all(got[k] == (name, "file") for k, name in enumerate(bodies))
    assert got[100] == ("MIT", "header") and got[101] == ("Apache-2.0", "header") and got[102] == (None, "none")


def test_sharding(spark):
    rows = edge_rows() + [(1000 + i, f"text {i % 7}") for i in range(997)]
    got = consistent_shards(docs(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    again = consistent_shards(docs(spark, rows).repartition(2)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got if r.doc_id and r.doc_id >= 1000} == {(r.doc_id, r.shard, r.slot) for r in again if r.doc_id and r.doc_id >= 1000}
    assert consistent_shards(docs(spark, [])).count() == 0


def test_shards_are_those_of_a_simulated_ring(spark):
    """Rows of an arc go to its first shard until that is full, what is left to the next one clockwise, and so on."""
    from graphlane.llm.sharding import CELLS, ring

    rows = docs(spark, [(i, "t") for i in range(3000)])
    cell = F.pmod(F.shiftrightunsigned(F.xxhash64("doc_id"), 20), F.lit(CELLS))
    arcs, order = ring(16, 64)
    left = Counter(arcs[r.c] for r in rows.select(cell.alias("c")).collect())
    room = {s: 3000 // 16 + (s < 3000 % 16) for s in range(16)}
    want: Counter = Counter()
    for turn in range(16):
        for a in range(len(order)):
            n = min(left[a], room[order[a][turn]])
            left[a] -= n
            room[order[a][turn]] -= n
            want[a, order[a][turn]] += n
    got = consistent_shards(rows).join(rows.select("doc_id", cell.alias("c")), "doc_id").collect()
    assert Counter((arcs[r.c], r.shard) for r in got) == +want


def test_rows_with_one_id_or_none_are_ranked_like_others(spark):
    for id_ in ("null", "7"):
        got = consistent_shards(spark.range(30_000).selectExpr(f"cast({id_} as long) doc_id", "'same' text").repartition(6)).select("shard", "slot").collect()
        assert len(set(got)) == 30_000 and set(Counter(r.shard for r in got).values()) == {1875}


def test_a_further_shard_moves_a_small_part(spark):
    rows = docs(spark, [(i, "t") for i in range(4000)])
    old, new = ({r.doc_id: r.shard for r in consistent_shards(rows, shards=n).collect()} for n in (16, 17))
    assert sum(old[i] != new[i] for i in old) < 0.15 * len(old)  # 1 / 17 is the least; by modulo 94 % would move


def test_bpe_gives_what_the_library_gives(spark):
    import sys

    sys.path.insert(0, "/opt/tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_padding(), tokenizer.no_truncation()
    rows = edge_rows() + [(50, "it's  <|endoftext|> done\r\n\n  x"), (51, "12,345 can't!!  "), (52, "\U0001faea͸ new letters")]
    for chunk in (1 << 20, 100):
        got = {r.doc_id: r for r in encode_and_decode(docs(spark, rows), chunk_bytes=chunk).collect()}
        for i, t in rows:
            if i is not None:
                ids = tokenizer.encode(t or "", add_special_tokens=False).ids
                assert (got[i].n_tokens, got[i].ids, got[i].decoded) == (len(ids), ids, tokenizer.decode(ids, skip_special_tokens=False)), i
    assert encode_and_decode(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as p
    from graphlane.llm.common import table
    from graphlane.llm.minhash import near_duplicates

    sf = "/root/testdata/sf0.001"
    held, docs_now = [], table(spark, sf, "documents")
    columns = docs_now.columns
    for name, stage in p.STAGES[:-1]:
        held.append({r[0] for r in docs_now.select("doc_id").collect()})
        docs_now = p.written(stage(spark, docs_now, sf), f"test-{name.replace(' ', '-')}")
        assert docs_now.columns == columns
    last = {r[0] for r in docs_now.select("doc_id").collect()}
    assert all(a >= b for a, b in zip(held, [*held[1:], last], strict=True))
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    assert len({" ".join((texts[i] or "").split()) for i in held[2]}) == len(held[2])
    assert near_duplicates(docs_now).where("class_size > 1").count() == 0
    out = p.run(spark, sf).collect()
    assert {r.doc_id for r in out} == last and set(out[0].asDict()) >= {"n_tokens", "ids_sha256", "decoded_sha256"}


def test_pipeline_bears_edge_rows_and_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(8)
    item = prose(rng, 40, 5000)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [*edge_rows(), (20, f"before {item} after")]]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for k, (own, labels) in enumerate([(rows, [(1, 1), (9, 0), (None, 1)]), ([], [])]):
        sf = f"{tmp_path}/{k}"
        spark.createDataFrame(own, kinds).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        out = p.run(spark, sf).collect()
        ids = [r.doc_id for r in out]
        assert 20 not in ids and ids.count(4) == 0 and len(ids) <= len(own)
        assert all(len(r.ids_sha256) == 64 for r in out)
