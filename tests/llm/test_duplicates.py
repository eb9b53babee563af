import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlane.llm import linking, minhash
from graphlane.llm.exact_dedup import drop_exact_copies, exact_dedup
from graphlane.llm.linking import BLOCK, HELD, collisions, held, rarest
from graphlane.llm.minhash import _banded, drop_near_duplicates, near_duplicates, similar
from graphlane.llm.packed import met_in, once_each, press, repeated_values, unpress
from graphlane.llm.paragraphs import WINDOW, jaccard, repeated_paragraphs, tuned_bands, windows
from graphlane.llm.suffix_dedup import substring_dedup
from graphlane.plans import tables
from tests.llm.util import SCHEMA, components_of, docs, edge_rows, prose, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_alignment_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 30))]
        b = [x for x in a if rng.random() > 0.2] + [rng.randrange(6) for _ in range(rng.randrange(3))]
        if not b:
            continue
        x, y = (a, b) if len(a) >= len(b) else (b, a)
        for limit in range(1, len(x)):
            if len(x) - len(y) <= limit < len(x):
                assert _banded(x, y, limit) == (distance(a, b) <= limit), (a, b, limit)


def test_near_duplicates_are_those_of_brute_force(spark):
    rng = random.Random(2)
    rows, n = [], 0
    for _ in range(12):
        base = prose(rng, rng.randrange(60, 200)).split()
        for _ in range(rng.randrange(1, 6)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = f"new{n}"
            rows.append((n, " ".join(own)))
            n += 1
    pairs = [(a, b) for a, x in rows for b, y in rows if a < b and similar(words(x), words(y))]
    want = components_of(pairs, [i for i, _ in rows])
    got = near_duplicates(docs(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.class_id) and r.class_size == sum(v == r.class_id for v in want.values()) for r in got)


def test_short_texts_meet_whatever_their_length(spark):
    """Pairs with as many changed words as the threshold allows, of 5 to 60 words, are those of brute force."""
    rng = random.Random(12)
    rows = []
    for i, n in enumerate(k for k in (5, 6, 8, 9, 10, 11, 12, 14, 20, 30, 41, 48, 49, 60) for _ in range(4)):
        base = prose(rng, n, 100_000).split()
        other = list(base)
        most = int(0.2 * n + 1e-9) if n < 40 else int(0.1 * n)
        for at in rng.sample(range(n), most):
            other[at] = f"new{i}x{at}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other[: -1 if most > 1 and i % 2 and other[-1] == base[-1] and n > 10 and most * 10 <= n else n]))]
    pairs = [(a, b) for a, x in rows for b, y in rows if a < b and similar(words(x), words(y))]
    assert len(pairs) >= len(rows) // 2
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows)).collect()}
    want = components_of(pairs, [i for i, _ in rows])
    assert sum(got[i] == want[i] for i in got) >= len(got) - 2  # sketches are drawn at random
    assert all(got[i] in (want[i], i) for i in got)


def test_near_duplicates_in_a_crowd_of_one_template(spark):
    """All texts share sketches with all others by their template, but each is similar to its partner only."""
    rng = random.Random(8)
    form = prose(rng, 79, 10_000)
    rows = []
    for i in range(60):
        shared = " ".join(f"own{i}x{j}" for j in range(10))
        rows += [(copy * 1000 + i, " ".join([form, shared, *(f"c{copy}d{i}x{j}" for j in range(11))])) for copy in range(2)]
    pairs = [(i, 1000 + i) for i in range(60)]
    texts = {i: words(t) for i, t in rows}
    assert all(similar(texts[a], texts[b]) for a, b in pairs) and not similar(texts[0], texts[1]) and not similar(texts[0], texts[1001])
    got = near_duplicates(docs(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == components_of(pairs, texts)


def test_a_crowd_makes_no_more_candidates_than_links(spark, monkeypatch):
    """Texts of the same words in other orders share sketches by their opening; counts of words cannot tell them apart."""
    rng = random.Random(9)
    opening, rest = prose(rng, 60, 10_000).split(), prose(rng, 90, 10_000).split()
    rows = [(i, " ".join(opening + rng.sample(rest, len(rest)))) for i in range(50)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(5)]
    pairs = [(a, b) for a, x in rows for b, y in rows if a < b and similar(words(x), words(y))]
    assert pairs == [(i, 1000 + i) for i in range(5)]
    made = []

    def counted_collisions(*args):
        made.append(found := collisions(*args))
        made[-1] = found.count()
        return found

    monkeypatch.setattr(minhash, "collisions", counted_collisions)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows)).collect()}
    assert got == components_of(pairs, got)
    assert made[0] <= len(pairs)


def test_a_crowd_is_met_by_its_rarest_words(spark, monkeypatch):
    """No value that many texts of several classes have is dealt into blocks, which each of them would visit."""
    rng = random.Random(13)
    form, n = prose(rng, 79, 10_000), 280
    rows = []
    for i in range(n):
        shared = " ".join(f"own{i}x{j}" for j in range(10))
        rows += [(copy * 1000 + i, " ".join([form, shared, *(f"c{copy}d{i}x{j}" for j in range(11))])) for copy in range(2)]
    pairs, texts = [(i, 1000 + i) for i in range(n)], {i: words(t) for i, t in rows}
    assert all(similar(texts[a], texts[b]) for a, b in pairs) and not similar(texts[0], texts[1]) and not similar(texts[0], texts[1001])
    most = []

    def watched(members, things, labels, *args):
        each = members.join(labels.select(F.col("id").alias("key"), "label"), "key", "left")
        met = each.groupBy("s").agg(F.count("*").alias("c"), F.countDistinct(F.coalesce("label", "key")).alias("classes"))
        most.append(met.where("classes > 1").agg(F.max("c")).first()[0])
        return collisions(members, things, labels, *args)

    monkeypatch.setattr(minhash, "collisions", watched)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows)).collect()}
    assert got == components_of(pairs, got)
    assert most[0] <= BLOCK


def test_a_crowd_costs_nothing_to_the_texts_outside(spark, monkeypatch):
    """What is prepared for crowds has a row for each text in one, not for each sketch that any two texts share."""
    rng = random.Random(15)
    form, crowd = prose(rng, 80, 10_000), BLOCK + 20
    rows = [(i, f"{form} {prose(rng, 30, 10_000)}") for i in range(crowd)]
    for i in range(40):
        rows += [(1000 + 2 * i, base := prose(rng, 60, 10_000)), (1001 + 2 * i, f"{base} end")]
    sizes = {}

    def counted_table(df, name, **options):
        table = tables.written(df, name, **options)
        if name.startswith("omh-crowd"):
            sizes[name] = table.count()
        return table

    monkeypatch.setattr(minhash, "written", counted_table)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: i - i % 2 if i >= 1000 else i for i in got}
    assert sizes and max(sizes.values()) <= crowd


def test_similar_texts_share_one_of_their_rarest_words(spark):
    rng = random.Random(14)
    texts = {}
    for i in range(0, 240, 4):
        base = prose(rng, rng.randrange(1, 80), rng.choice([3, 30, 300])).split()
        for k in range(4):
            own = list(base)
            for _ in range(rng.randrange(0, len(own) // 4 + 2)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], [f"new{rng.randrange(9)}"], [own[at], own[rng.randrange(len(own))]]])
                own = own or base
            texts[i + k] = " ".join(own)
    keys = spark.createDataFrame([(k,) for k in texts if k % 9], "key long")
    found = rarest(spark.createDataFrame([*texts.items(), (999, None), (1000, "w1 " * (HELD + 1))], "key long, content string"), keys, 1 - minhash.SIMILARITY, minhash._labelled_words)
    has = {}
    for r in found.collect():
        has.setdefault(r.key, set()).add(r.s)
    assert has.keys() <= {k for k in texts if k % 9} and all(len(has[k]) <= 0.2 * len(words(texts[k])) + 1 + 1e-9 for k in has)
    pairs = [(a, b) for a in texts for b in texts if a < b and a % 9 and b % 9 and similar(words(texts[a]), words(texts[b]))]
    assert len(pairs) > 50 and all(has.get(a, set()) & has.get(b, set()) for a, b in pairs)


def test_similar_texts_of_a_crowd_meet_by_rare_runs_or_words(spark, monkeypatch):
    """The pairs of brute force all meet, whichever of the two each text goes by."""
    rng = random.Random(16)
    opening, texts = prose(rng, 50, 10_000), {}
    for i in range(0, 400, 4):
        base = f"{opening} {prose(rng, n, 60)}".split()[50 - n // 3 if i % 8 else 0 :] if (n := rng.randrange(4, 120)) else []
        for k in range(4):
            own = list(base)
            for _ in range(rng.randrange(0, len(own) // 4 + 1)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], [f"new{rng.randrange(900)}"], [own[at], own[rng.randrange(len(own))]]])
            texts[i + k] = " ".join(own)
    monkeypatch.setattr(linking, "FEW", 6)
    table, keys = spark.createDataFrame([*texts.items()], "key long, content string"), spark.createDataFrame([(k,) for k in texts], "key long")
    bound = 1 - minhash.SIMILARITY
    has = {}
    for r in rarest(table, keys, bound, minhash._labelled_words, minhash._labelled_runs).collect():
        has.setdefault(r.key, set()).add(r.s)
    pairs = [(a, b) for a in texts for b in texts if a < b and similar(words(texts[a]), words(texts[b]))]
    assert len(pairs) > 100 and all(has.get(a, set()) & has.get(b, set()) for a, b in pairs)


def test_strange_texts_of_a_crowd_seldom_meet(spark):
    """Texts that share an opening and a small vocabulary have rare words in common, but few rare runs of two."""
    rng = random.Random(17)
    opening = prose(rng, 40, 10_000)
    table = spark.createDataFrame([(i, f"{opening} {prose(rng, 100, 300)}") for i in range(150)], "key long, content string")
    by_words, by_runs = (rarest(table, table.select("key"), 1 - minhash.SIMILARITY, minhash._labelled_words, *more).count() for more in ((), (minhash._labelled_runs,)))
    assert by_runs < by_words / 2


@pytest.mark.parametrize("longer", [0, HELD])
def test_collisions_compare_each_pair_once(spark, tmp_path, longer):
    """Whatever the number of values that a pair shares and of blocks that these are dealt into."""
    rng = np.random.default_rng(4)
    n = 30
    shared = [{int(v) for v in rng.integers(0, 12, 6)} - {k % 5} for k in range(n)]
    h = [rng.integers(0, 2**63, 40 + longer, dtype=np.uint64) for _ in range(3)]
    things = spark.createDataFrame([(k, 40 + longer, held(h[k % 3])) for k in range(n)], "key long, size int, held binary")
    members = spark.createDataFrame([(v, k, 0) for k in range(n) for v in shared[k]], "s long, key long, low long")
    labels = spark.createDataFrame([(k, k % 7) for k in range(14)], "id long, label long")
    log = str(tmp_path / "log")

    def close(a, b):
        with open(log, "ab") as f:
            f.write(b"x")
        return True

    got = [tuple(r) for r in collisions(members, things, labels, 0.2, close, 4).collect()]
    label = {k: k % 7 if k < 14 else k for k in range(n)}
    want = [(a, b) for a in range(n) for b in range(a + 1, n) if shared[a] & shared[b] and label[a] != label[b] and a % 3 == b % 3]
    assert sorted(got) == want
    assert longer or os.path.getsize(log) == len(want)


def test_near_duplicates_bear_edge_cases(spark):
    table = docs(spark, edge_rows())
    got = near_duplicates(table).collect()
    assert len(got) == table.count()
    classes = {(r.doc_id, r.class_id, r.class_size, r.kept) for r in got}
    assert (1, 1, 4, True) in classes and (4, 1, 4, False) in classes and (7, 1, 4, False) in classes
    assert {(2, 2, 1, True), (3, 3, 1, True), (5, 5, 1, True), (10, 10, 1, True), (9, 9, 1, True)} <= classes
    left = drop_near_duplicates(table)
    assert left.columns == table.columns and left.count() == table.count() - 3
    empty = docs(spark, [])
    assert near_duplicates(empty).count() == 0 == drop_near_duplicates(empty).count()


@pytest.mark.parametrize("budget", [1 << 20, 300])
def test_exact_dedup(spark, budget):
    """A budget of 300 bytes sends nearly all rows through spill files, several levels deep."""
    rng = random.Random(4)
    rows = edge_rows() + [(100 + i, f"copy  {rng.randrange(30)}\t{'x' * 50}") for i in range(300)]
    want: dict[str, list] = {}
    for i, t in rows:
        want.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    table = docs(spark, rows).repartition(3)
    got = exact_dedup(table, budget=budget).collect()
    groups = {hashlib.sha256(t.encode()).hexdigest(): own for t, own in want.items()}
    assert len(got) == len(rows)
    for r in got:
        own = groups[r.text_sha256]
        known = [i for i in own if i is not None]
        assert r.group_size == len(own) and r.keep_id == (min(known) if known else None)
    assert sum(r.kept for r in got) == len(want)
    left = drop_exact_copies(table, budget=budget)
    assert left.columns == table.columns and left.count() == len(want)
    assert exact_dedup(docs(spark, [])).count() == 0


def brute_spans(texts, length):
    count: dict[bytes, int] = {}
    for t in texts:
        for j in range(len(t) - length + 1):
            count[t[j : j + length]] = count.get(t[j : j + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for j in range(len(t) - length + 1):
            if count[t[j : j + length]] > 1:
                gone[j : j + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("group", [2, 1000])
def test_substring_dedup_is_exact(spark, group):
    """group 2 sends anchors with three contents or more the way of very frequent passages."""
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcd") for _ in range(n)) for n in (40, 55, 90)]
    rows = [(i, "".join(rng.choice(["".join(rng.choice("abcdefgh") for _ in range(30)), rng.choice(passages), "zz" * 12]) for _ in range(rng.randrange(1, 8)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, rows[0][1]), (103, "é" * 50), (None, "q" * 200)]
    got = {r.doc_id: r for r in substring_dedup(docs(spark, rows), length=32, gram=8, group=group, keep_bytes=True).collect()}
    assert len(got) == len(rows)
    for (i, t), (n, spans, kept) in zip(rows, brute_spans([(t or "").encode() for _, t in rows], 32), strict=True):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len((t or "").encode()), n, spans, kept), i
    assert substring_dedup(docs(spark, [])).count() == 0


def test_bands_are_tuned_for_recall():
    bands, rows = tuned_bands(0.8, 0.9995)
    assert bands * rows <= 80 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_windows_meet_in_every_run_of_51_words():
    import numpy as np

    rng = np.random.default_rng(6)
    shared = rng.integers(1, 2**63, 51, dtype=np.uint64)
    texts = [np.concatenate([rng.integers(1, 2**63, rng.integers(0, 90), dtype=np.uint64), shared, rng.integers(1, 2**63, rng.integers(0, 90), dtype=np.uint64)]) for _ in range(100)]
    lens = np.array([len(t) for t in texts])
    owner, at, value = windows(np.concatenate(texts), lens)
    own = [set(value[owner == k].tolist()) for k in range(100)]
    assert all(a & b for a, b in zip(own[::2], own[1::2], strict=True))
    for k in range(100):  # as if each text stood alone
        _, alone, values = windows(texts[k], lens[k : k + 1])
        assert alone.tolist() == at[owner == k].tolist() and values.tolist() == value[owner == k].tolist()
        assert all(i + WINDOW <= lens[k] for i in alone.tolist())


def test_repeated_values_are_those_of_a_count(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = [rng.integers(0, 3000, 200).astype(np.uint64) * np.uint64(2**50 + 1) for _ in range(12)]
    rows, held = [], []
    for c, v in enumerate(values):
        key = np.arange(len(v)) + 1000 * c
        first, twice, same = once_each([v, v + np.uint64(1)], [key])
        assert (v[first][same] == v).all() and unpress(press(key), np.int64).tolist() == key.tolist()
        rows.append((c, bytearray(v[first].tobytes()), bytearray((v[first] + np.uint64(1)).tobytes()), bytearray(np.packbits(twice).tobytes()), bytearray(press(key[first]))))
        held.append((v, first, same))
    table = spark.createDataFrame(rows, "chunk long, v0 binary, v1 binary, twice binary, p0 binary")
    count = {x: 0 for v in values for x in v.tolist()}
    least = {}
    for c, v in enumerate(values):
        for k, x in enumerate(v.tolist()):
            count[x] += 1
            least[x] = min(least.get(x, 10**9), 1000 * c + k)
    met = {r.chunk: met_in(r.met, 1) for r in repeated_values(table, 2400, 1, 2).collect()}
    for c, (v, first, _) in enumerate(held):
        at, (p,) = met.get(c, (np.zeros(0, int), [np.zeros(0, int)]))
        got = dict(zip(v[first][at].tolist(), p.tolist(), strict=True))
        assert got == {x: least[x] for x in v.tolist() if count[x] > 1}


def passage_rows(rng):
    line, passage, other = prose(rng, 60, 10_000), prose(rng, 55, 10_000), prose(rng, 30, 10_000)
    near = line.split()
    near[30] = "changed"
    rows = [(i, prose(rng, 150, 10_000)) for i in range(10)]
    rows += [(20, f"{prose(rng, 20, 10_000)}\n\n{line}\n\nend"), (21, f"{' '.join(near)}\nother words"), (22, f"{prose(rng, 70, 10_000)} {passage} {prose(rng, 40, 10_000)}"), (23, f"{prose(rng, 30, 10_000)} {passage}"), (24, other), (25, f"{other} {prose(rng, 80, 10_000)}"), (26, None), (27, ""), (None, passage), (22, "x")]
    wrapped = line.split()
    wrapped[10] = "altered"
    return rows + [(30, "\n".join(" ".join(wrapped[k : k + 8]) for k in range(0, 60, 8)))]


@pytest.mark.parametrize("bits", [64, 6])
def test_repeated_paragraphs(spark, bits):
    """6 bits: nearly all windows that meet are false, and are told apart by their words."""
    table = docs(spark, passage_rows(random.Random(7)))
    got = repeated_paragraphs(table, hash_bits=bits).collect()
    lines = {(r.doc_id, r.kept) for r in got if r.kind == "paragraph"}
    assert lines == {(20, True), (21, False), (30, False)}  # one word changed, and another one across short lines
    passages = {(r.doc_id, r.kept) for r in got if r.kind == "passage" and r.doc_id not in (20, 21, 30)}
    assert passages == {(22, True), (23, False), (None, False)}  # 30 common words are too few
    assert len({r.cluster_id for r in got if r.kind == "passage" and r.doc_id in (22, 23, None)}) == 1
    assert all(r.n_words >= WINDOW for r in got)
    assert repeated_paragraphs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_passages_are_those_of_brute_force(spark):
    """Each run of 51 words that occurs twice is found, each passage that goes occurs elsewhere, and content is kept once."""
    rng = random.Random(9)
    shared = [prose(rng, rng.randrange(51, 120), 10_000) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(shared) if rng.random() < 0.3 else prose(rng, 40, 10_000) for _ in range(rng.randrange(1, 7)))) for i in range(60)]
    rows = [(1000 + i, t) for i, t in rows] + edge_rows()[:-1] + [(6, edge_rows()[7][1])]
    texts: dict = {}
    for k, (_, t) in enumerate(rows):
        texts[k] = words(t)
    runs: dict = {}
    for k, w in texts.items():
        for a in range(len(w) - 50):
            runs.setdefault(tuple(w[a : a + 51]), set()).add((k, a))
    want = {rows[k][0] for own in runs.values() if len(own) > 1 for k, _ in own}
    got = [r for r in repeated_paragraphs(docs(spark, rows)).collect() if r.kind == "passage"]
    assert {r.doc_id for r in got} >= want
    small: dict = {}
    for k, w in texts.items():
        for a in range(len(w) - WINDOW + 1):
            small.setdefault(tuple(w[a : a + WINDOW]), set()).add((rows[k][0], a))
    by_id: dict = {}
    for k, w in texts.items():
        by_id.setdefault(rows[k][0], []).append(w)
    for r in got:
        if r.doc_id is not None and len(by_id[r.doc_id]) == 1:
            own = by_id[r.doc_id][0]
            assert len(small[tuple(own[r.start : r.start + WINDOW])]) > 1
    for own in by_id[6]:  # 20,000 words, twice
        assert len(own) == 20_000
    assert sorted(r.kept for r in got if r.doc_id == 6) == [False, True]


def test_similar_paragraphs_are_those_of_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(25):
        base = prose(rng, rng.randrange(45, 160), 10_000).split()
        for c in range(rng.randrange(1, 4)):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = f"new{i}x{c}"
            rows.append((10 * i + c, f"{prose(rng, 5)}\n\n{' '.join(own)}\n\n{prose(rng, 7)}"))
    texts = {i: words(t.split("\n\n")[1]) for i, t in rows}
    pairs = [(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8]
    want = components_of(pairs, texts)
    got = {r.doc_id: r.keep_id for r in repeated_paragraphs(docs(spark, rows)).collect() if r.kind == "paragraph"}
    assert got == {i: want[i] for i in texts if sum(v == want[i] for v in want.values()) > 1}


def test_substring_dedup_of_crowds_and_periods(spark):
    """A passage that 600 texts embed, and long periodic texts."""
    rng = random.Random(13)
    passage = "".join(rng.choice("abcdefgh") for _ in range(60))
    rows = [(i, "".join(rng.choice("ijklmnop") for _ in range(rng.randrange(0, 40))) + passage + "".join(rng.choice("ijklmnop") for _ in range(20))) for i in range(600)]
    rows += [(1000, "z" * 200_000), (1001, "xyz" * 20_000), (None, None), (1002, "z" * 31)]
    got = {r.doc_id: r for r in substring_dedup(docs(spark, rows), length=32, gram=8, group=5, keep_bytes=True).collect()}
    for (i, t), want in zip(rows, brute_spans([(t or "").encode() for _, t in rows], 32), strict=True):
        assert (got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == want, i
    assert all(got[i].n_removed >= 60 for i, _ in rows[:600])
    assert [(got[i].n_removed, got[i].n_spans) for i in (1000, 1001, 1002, None)] == [(200_000, 1), (60_000, 1), (0, 0), (0, 0)]
