"""Language identification by cross-parsing entropy.

A suffix automaton holds each language's sample of labelled text. A text is parsed against it into phrases, each the
longest match from where the one before ended (a letter that the sample lacks is a phrase); the language that needs
fewest phrases for its symbols wins. A phrase costs the bits that point into the largest sample, in all languages alike,
so that a small sample gives no language an advantage.

Texts and samples are lower-cased letters; whatever stands between letters is one space. Every letter of the samples has
a code of its own, in writings of many letters one of several symbols. Parsing starts anew every SEGMENT symbols, so
that texts of any length are parsed in step with each other, as arrays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The bounds of the sample: rows of each language (those with the smallest hashes of their ids), code points of each language, of
#: whole rows, and code points of all languages together, which they share alike: so the automata of four languages or of a
#: thousand take at most about 400 MB of a worker, and 60 MB where letters are few.
ROWS, CHARS, TOTAL = 64, 1 << 15, 1 << 17
#: Symbols of the most frequent letters, and in each place of the others' codes.
DIRECT, DIGITS = 62, 64
#: A text of n symbols is rejected if its parse needs MOST * (1 + WIDE / n) times the bits of a uniform code of its letters, or more:
#: one rule for all lengths, under which what few symbols show weighs little. Texts half in one learned language and half in
#: another need up to 1.0 times.
MOST, WIDE = 1.25, 64
SEGMENT, LOT = 1024, 1 << 21
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("bigint").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS, chars: int = CHARS, total: int = TOTAL) -> dict[str, list[str]]:
    """Labelled text by language, for every label: rows in the order of their ids' hashes, as long as they fit together into
    ``chars`` code points or the label's share of ``total``; of a longer row, a stretch of that length at a hashed place. Rows
    without an id, text or label, and held-out ones, are left out; repeated rows count once."""
    use = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    use = use.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    chars = max(1, min(chars, total // max(1, use.select("lang").distinct().count())))
    order, size = F.xxhash64("doc_id"), F.char_length("text")
    begin = F.when(size > chars, F.pmod(order, size - chars + 1)).otherwise(0) + 1
    use = use.select("lang", "doc_id", order.alias("order"), F.substr("text", begin.cast("int"), F.lit(chars)).alias("text"))
    w = Window.partitionBy("lang").orderBy("order", "doc_id", "text")
    use = use.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= rows)
    found: dict[str, list[str]] = {}
    left: dict[str, int] = {}
    for r in use.orderBy("lang", "rank").collect():
        mine, room = found.setdefault(r["lang"], []), left.setdefault(r["lang"], chars)
        if len(r["text"]) <= room and r["text"] not in mine:
            mine.append(r["text"])
            left[r["lang"]] = room - len(r["text"])
    return found


def automaton(sequence: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton, a row for each state: 0, the start state, where there is none."""
    move: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in sequence.tolist():
        now = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = now
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    table = np.zeros((len(move), width), np.int32)
    for s, to in enumerate(move):
        for c, t in to.items():
            table[s, c] = t
    return table


class Parser:
    """Automata of some languages, over one alphabet: 0 for a gap, 1 for a letter that no sample has, then the letters."""

    def __init__(self, samples: dict[str, list[str]]):
        lower = lambda c: x if len(x := c.lower()) == 1 else c
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        common = Counter(lower(c) for texts in samples.values() for t in texts for c in t if c.isalpha())
        ranked = {c: k for k, (c, _) in enumerate(sorted(common.items(), key=lambda x: (-x[1], x[0])))}
        direct, places = (len(ranked), 0) if len(ranked) <= 2 * DIRECT else (DIRECT, 2)
        while places and DIGITS**places < len(ranked) - direct:
            places += 1
        self.letters, self.width = max(len(ranked), 2), 2 + direct + places * DIGITS
        # symbols by code point: one of its own, or one for each place of a number; -1 where there is no symbol
        self.code = np.full((0x110000, max(places, 1)), -1, np.int16)
        self.code[:, 0] = letter
        for i in np.flatnonzero(letter).tolist():
            if (k := ranked.get(lower(chr(i)))) is None:
                continue
            if k < direct:
                self.code[i, 0] = 2 + k
            else:
                for d in range(places):
                    self.code[i, d] = 2 + direct + d * DIGITS + (k - direct) // DIGITS**d % DIGITS
        self.langs = sorted(samples)
        sequences = [self.normalised(" ".join(samples[n])) for n in self.langs]
        self.tables = [automaton(s, self.width).reshape(-1) for s in sequences]
        self.bits = log2(max(map(len, sequences), default=0) + 2)

    def normalised(self, text: str) -> np.ndarray:
        """Symbols of letters, and 0 for each run of anything else; none at the ends."""
        c = self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].reshape(-1)
        c = c[c >= 0] if self.code.shape[1] > 1 else c
        keep = c != 0
        if not keep.any():
            return c[:0]
        keep[1:] |= c[:-1] != 0
        c = c[keep]
        return c[int(c[0] == 0) : len(c) - int(c[-1] == 0)]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each normalised text in each language's automaton: a row for each language."""
        cuts = [(k, t[lo : lo + SEGMENT]) for k, t in enumerate(texts) for lo in range(0, len(t), SEGMENT)]
        cuts.sort(key=lambda x: -len(x[1]))
        out = np.zeros((len(self.tables), len(texts)), np.int64)
        if not cuts:
            return out
        sizes = np.array([len(c) for _, c in cuts])
        grid = np.zeros((len(cuts), sizes[0]), np.int16)
        for k, (_, c) in enumerate(cuts):
            grid[k, : len(c)] = c
        grid = np.ascontiguousarray(grid.T)
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        owner = np.array([k for k, _ in cuts])
        for k, table in enumerate(self.tables):
            state, count = np.zeros(len(cuts), np.int32), np.zeros(len(cuts), np.int32)
            for t, n in enumerate(active.tolist()):
                c, s = grid[t, :n], state[:n]
                to = table.take(s * np.int32(self.width) + c)
                ended = to == 0
                count[:n] += ended | (s == 0)
                np.copyto(to, table.take(c), where=ended)
                state[:n] = to
            np.add.at(out[k], owner, count)
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """The winner, the alphabetically first among equals; its share in the two best, 1 - best / (best + second); and
        bits of its parse over those of a uniform code, times n / (n + WIDE) for n symbols."""
        codes = [self.normalised(t) for t in texts]
        count = self.phrases(codes)
        out = []
        for k, c in enumerate(codes):
            if not len(c) or not self.langs:
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            best = int(np.argmin(count[:, k]))
            both = count[best, k] + np.delete(count[:, k], best).min() if len(self.langs) > 1 else np.inf
            out.append((self.langs[best], float(1 - count[best, k] / both), float(count[best, k] * self.bits / (len(c) + WIDE) / log2(self.letters))))
        return out


_PARSERS: dict[str, Parser] = {}


def _parser(key: str, samples: dict[str, list[str]]) -> Parser:
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(samples)
    return _PARSERS[key]


def identify(docs: DataFrame, samples: dict[str, list[str]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns doc_id, held_out, lang_pred and score (0 to 1) for each row, repeated ones too. ``und`` with score 0 if
    the text is null or has no letter, or if no language was learned. Whole texts are parsed; other columns are ignored.
    """
    key = repr(sorted(samples.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(key, samples)

        def lots():
            rows, size = [], 0
            for b in batches:
                for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    rows.append(row)
                    size += len(row[2])
                    if size >= LOT:
                        yield rows
                        rows, size = [], 0
            yield rows

        for rows in lots():
            found = parser.predict([t for _, _, t in rows])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()),
                                              pa.array([x for x, *_ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64())], names)

    names = ["doc_id", "held_out", "lang_pred", "score"]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out(doc_id).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, samples: dict[str, list[str]], text: str = "text", lang: str = "lang", most: float = MOST) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with all their columns, and the language in ``lang``, if there
    is such a column. Rows with a null text and those without a letter go, and texts of n symbols whose
    parse in the best language needs ``most`` * (1 + WIDE / n) times the bits of a uniform code of the letters, or more: no
    language explains them. Repeated rows share a decision. If no language was learned, rows with a letter stay as they are.
    Texts of any length are parsed whole. No exchange."""
    if not samples:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    key = repr(sorted(samples.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(key, samples)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            found: list[tuple[str, float, float]] = []
            lot, size = [], 0
            for k, t in enumerate(texts):
                lot.append(t.as_py() or "")
                size += len(lot[-1])
                if size >= LOT or k == len(texts) - 1:
                    found += parser.predict(lot)
                    lot, size = [], 0
            at = b.schema.get_field_index(lang)
            if at >= 0:
                b = b.set_column(at, b.schema.field(at), pa.array([x for x, *_ in found], b.schema.field(at).type))
            yield b.filter(pa.array([x != UNKNOWN and rate < most for x, _, rate in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
