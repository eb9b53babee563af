"""Language identification by cross-parsing.

The texts of a bounded labelled sample give each language a reference and its suffix automaton. A text is parsed greedily
from end to end into the longest phrases that occur in the reference; few phrases mean low cross-entropy. The language with
the fewest phrases for the text's length wins. Letters are what Unicode puts in category L; the marks that go with them
are kept, everything else counts as a blank, and phrases run on across blanks.

A worker steps through many texts and all languages at once, a character at a time; the automata's transitions lie in
one pair of arrays, rows of transitions fitted into each other's gaps.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlane.llm.common import pieces_of, type_of

SAMPLE_ROWS = 200
SAMPLE_CHARS = 20_000
PIECE_BYTES = 1 << 20
SEGMENT = 512
SIDE = 2048
BLANK = ord(" ")


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point 2 for a letter, 1 for a mark, else 0."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)


def letters(texts: list[str]) -> list[np.ndarray]:
    """Of each text the code points of its words in lower case, one blank before each and after the last; empty without a
    letter. A word is a letter and the letters and marks that follow."""
    lower = [t.lower() for t in texts]
    lens = np.fromiter((len(t) + 1 for t in lower), np.int64, len(lower))
    code = np.frombuffer("".join(t + "\n" for t in lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[code]
    word = kind == 2
    if (kind == 1).any():  # marks belong to the letter before them
        before = np.maximum.accumulate(np.where(kind != 1, np.arange(len(kind)), 0))
        word |= (kind == 1) & word[before]
    # of other characters the last one before a word
    blank = np.zeros(len(code), bool)
    blank[:-1] = ~word[:-1] & word[1:]
    ends = np.cumsum(lens)
    out = []
    for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True):
        b -= 1  # the separator
        own = np.where(word[a:b], code[a:b], BLANK)[word[a:b] | blank[a:b]]
        out.append(np.concatenate([np.full(int(word[a]), BLANK, np.uint32), own, np.full(1, BLANK, np.uint32)]) if len(own) else own)
    return out


def automaton(text: str) -> list[dict[str, int]]:
    """The transitions of each state of the text's suffix automaton, the first one the start; built online."""
    following: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = cur
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return following


class Parser:
    """The automata of some references in one array of cells: that at base[state] + character holds the state, if it has
    such a transition, and the state that this leads to. Rows of transitions lie in each other's gaps, at random bases
    where they fit."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.langs = sorted(texts)
        known = sorted(set("".join(texts.values())))
        code = {c: k + 1 for k, c in enumerate(known)}  # 0: in no reference
        self.points, self.size = np.array([ord(c) for c in known], np.int64), len(known) + 1
        rows: list[dict[str, int]] = []
        starts = []
        for lang in self.langs:
            starts.append(len(rows))
            rows += [{c: t + starts[-1] for c, t in own.items()} for own in automaton(texts[lang])]
        self.start = np.array(starts, np.int64)
        self.first = np.tile(self.start[:, None], (1, self.size))
        for k, at in enumerate(starts):
            for c, t in rows[at].items():
                self.first[k, code[c]] = t
        n = 2 * sum(map(len, rows)) + 1
        owner, to, base = [-1] * (n + self.size), [0] * (n + self.size), [0] * len(rows)
        tries = iter(())
        rng = np.random.Generator(np.random.PCG64(3))
        for state in sorted(range(len(rows)), key=lambda x: -len(rows[x])):
            own = [code[c] for c in rows[state]]
            while own:
                at = next(tries, None)
                if at is None:
                    tries = iter(rng.integers(0, n, 1 << 16).tolist())
                elif all(owner[at + c] < 0 for c in own):
                    base[state] = at
                    for c, t in zip(own, rows[state].values(), strict=True):
                        owner[at + c], to[at + c] = state, t
                    break
        self.base = np.array(base, np.int64)
        self.cells = np.array(owner, np.int64) << 32 | np.array(to, np.int64)

    @functools.cached_property
    def codes(self) -> np.ndarray:
        out = np.zeros(sys.maxunicode + 1, np.int64)
        out[self.points] = np.arange(1, self.size)
        return out

    def _step(self, state: np.ndarray, start: np.ndarray, row: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after characters c, and whether these begin a phrase; start and row: what belongs to the languages
        of the states."""
        found = self.cells.take(self.base.take(state) + c)
        found ^= state << 32
        missed = found.view(np.uint64) >= np.uint64(2**32)
        return np.where(missed, self.first.take(row + c), found), missed | (state == start)

    def phrases(self, texts: list[np.ndarray], segment: int = SEGMENT) -> np.ndarray:
        """Into how many longest matches each text (rows), given by code points, is parsed by each language (columns); a
        character that a reference lacks is a phrase.

        Texts are cut into segments that are parsed side by side, each as if a phrase began with it. Then the phrase
        that runs on from the segment before is parsed on, until a phrase begins where the segment's own parse has one
        begin too, from where on they are the same. Where they never meet, the next segment is done again."""
        n_lang, lens = len(self.langs), np.fromiter(map(len, texts), np.int64, len(texts))
        pieces = -(-lens // segment)
        of = np.repeat(np.arange(len(texts)), pieces)
        number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(np.cumsum(lens) - lens, pieces) + number * segment
        size = np.minimum(segment, np.repeat(lens, pieces) - number * segment)
        flat = self.codes[np.concatenate([np.zeros(0, np.uint32), *texts])]
        order = np.argsort(-size, kind="stable")  # those still going on come first
        begin, size, rank = begin[order], size[order], np.argsort(order)
        state, offset = np.tile(self.start, (len(size), 1)), np.arange(n_lang) * self.size
        begins = np.zeros((int(size.max(initial=0)), len(size), n_lang), bool)
        for at in range(0, len(size), SIDE):  # few enough to stay in the cache
            part = slice(at, at + SIDE)
            going = len(size[part]) - np.searchsorted(size[part][::-1], np.arange(int(size[at])), "right")
            now, start, row, place = state[part], np.tile(self.start, (len(size[part]), 1)), np.tile(offset, (len(size[part]), 1)), begin[part]
            for t, a in enumerate(going.tolist()):
                now[:a], begins[t, at : at + a] = self._step(now[:a], start[:a], row[:a], flat.take(place[:a] + t)[:, None])
        count = begins.sum(axis=0, dtype=np.int32)
        own, last = count.copy(), state.copy()

        todo = np.repeat(rank[number > 0], n_lang), np.tile(np.arange(n_lang), int((number > 0).sum()))
        before = np.empty(len(order), np.int64)
        before[rank[number > 0]] = rank[np.flatnonzero(number > 0) - 1]
        while len(todo[0]):
            row, k = todo
            now = last[before[row], k]
            more, t, changed = np.zeros(len(row), np.int32), 0, []  # more: phrases that it has beyond the segment's own parse
            live = np.arange(len(row))
            while len(live):
                ended = size[row[live]] <= t
                if ended.any():  # never met: its end differs from that of its own parse
                    e = live[ended]
                    own[row[e], k[e]] = count[row[e], k[e]] + more[e]
                    changed.append(e[last[row[e], k[e]] != now[e]])
                    last[row[e], k[e]] = now[e]
                    live = live[~ended]
                    continue
                r, j = row[live], k[live]
                now[live], starts = self._step(now[live], self.start[j], offset[j], flat[begin[r] + t])
                theirs = begins[t, r, j]
                met = starts & theirs
                more[live] += starts.view(np.int8) - theirs.view(np.int8)
                m = live[met]
                if len(m):
                    own[row[m], k[m]] = count[row[m], k[m]] + more[m]
                    end = state[row[m], k[m]]
                    changed.append(m[last[row[m], k[m]] != end])
                    last[row[m], k[m]] = end
                    live = live[~met]
                t += 1
            again = np.concatenate([np.zeros(0, np.int64), *changed])
            after = np.full(len(order), -1, np.int64)
            after[before[rank[number > 0]]] = rank[number > 0]
            follow = after[row[again]]
            todo = follow[follow >= 0], k[again][follow >= 0]
        out = np.zeros((len(texts), n_lang), np.int64)
        np.add.at(out, of[order], own)
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        own = letters(texts)
        if not self.langs:
            return [("und", 0.0)] * len(own)
        counts = self.phrases(own)
        out = []
        for x, n in zip(own, counts, strict=True):
            best = int(n.argmin())
            rest = np.delete(n, best)
            out.append(("und", 0.0) if not len(x) else (self.langs[best], float(rest.min() / (rest.min() + n[best])) if len(rest) else 1.0))
        return out


def reference_texts(df: DataFrame, learn_from, lang_col: str, id_col: str, text_col: str, rows: int, chars: int) -> dict[str, str]:
    """Of each language whole texts of at most rows rows: in the order of a hash of id and text those that fit in what is
    left of chars characters, or where none fits the shortest one."""
    known = df.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("gl_lang"), F.col(text_col).alias("gl_text"), F.xxhash64(id_col, text_col).alias("gl_h"), F.length(text_col).alias("gl_n"))
    first = Window.partitionBy("gl_lang").orderBy("gl_h", "gl_text")
    chosen = known.where(F.col("gl_n") <= chars).withColumn("gl_k", F.row_number().over(first)).where(F.col("gl_k") <= rows)
    found: dict[str, list[str]] = {}
    left: dict[str, int] = {}
    for lang, text in chosen.orderBy("gl_lang", "gl_k").select("gl_lang", "gl_text").toLocalIterator():
        own = "".join(map(chr, letters([text])[0]))
        if own and len(own) <= left.setdefault(lang, chars):
            left[lang] -= len(own)
            found.setdefault(lang, []).append(own)
    lacking = known.where(~F.col("gl_lang").isin(list(found))) if found else known
    for lang, text in lacking.groupBy("gl_lang").agg(F.min_by("gl_text", F.struct("gl_n", "gl_h"))).toLocalIterator():
        if len(own := letters([text])[0]):
            found[lang] = ["".join(map(chr, own))]
    return {lang: "".join(own) for lang, own in found.items()}


def identify(df: DataFrame, learn_from, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """One row for each row of df: id, lang_pred, score.

    learn_from: the condition on the id under which text and language may be learned. Of each language at most
    sample_rows rows are, those of whole texts that together have at most sample_chars characters (the shortest one if
    each is longer), so what is sent to the workers does not grow with the input. Every text is parsed from end to end,
    however long. score is second / (first + second) of the phrase counts of the best two languages: 0.5 if they tie
    (then the name that sorts first wins), 1 with a single language. A null text or one without a letter (Unicode category
    L) is 'und' with score 0, as is everything if nothing can be learned. Rows that repeat get a row each; an empty table
    gives an empty result; other columns are ignored."""
    texts = reference_texts(df, learn_from, lang_col, id_col, text_col, sample_rows, sample_chars)
    model = df.sparkSession.sparkContext.broadcast(Parser(texts))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, found = model.value, []
            for _, part in pieces_of(batch.column(1), PIECE_BYTES):
                found += known.predict(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [batch.schema.names[0], "lang_pred", "score"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(predict, f"`{id_col}` {type_of(df, id_col)}, lang_pred string, score double")
