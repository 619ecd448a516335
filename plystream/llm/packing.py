"""Packing of tokenised documents into sequences by a linear grouping scheme and best fit.

Lengths are whole numbers up to the capacity, so the counts of each length, at most 2048 rows, say all that a plan needs,
however many documents there are. The plan is made from these counts:

1. large lengths are ordered and cut into groups of equal cardinality; each group counts as its largest length;
2. configurations of these few sizes are optimised: the largest size left is completed by the fullest set of others that
   still have documents, and the configuration is used as often as counts allow;
3. actual lengths are substituted, which leaves gaps;
4. small lengths go to the gaps by best fit, longest first, and then to sequences of their own.

A plan is a list of slots: the documents of a length with ranks from r to r + n go to sequences from s to s + n. Spark
ranks the documents of each length and looks their slots up.
"""

from __future__ import annotations

import array
import gc
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plystream.llm.common import parallelism, staged

#: GROUPS: where there are documents for it, a group for nearly each of the 1,792 large lengths, as one plan for all documents
#: costs little; of 50,000 exponential lengths that leaves 5 sequences above the bound of 11,978, 64 groups leave 44.
CAPACITY, GROUPS, SMALL = 2048, 2048, 8
#: Entries of a worker's memory of words, code points of a word that is remembered, and of a text that is cut at once.
WORDS, WORD, BLOCK = 500_000, 64, 1 << 22
#: Words that normalisation only lower-cases and that have no part of a special token; words in a line of them.
PLAIN, LINE = re.compile("[!-;=-~\\xa1-\\xff]+").fullmatch, 500
#: The tokenizer's own words, lower-cased, among the first 256 code points.
NARROW = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|"
                    r"[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+").findall
#: Lots of rows that are ranked together, for each shuffle partition; a lot has rows of one length.
LOTS = 4


def cut(text: str) -> list[str]:
    """A text's words. No token crosses a space or new line, so these cut any text. Texts of the first 256 code points
    that hold no part of a special token are cut further, as the tokenizer itself does once it has lower-cased them."""
    if "<" not in text:
        try:
            text.encode("latin-1")
            return NARROW(text.lower())
        except UnicodeEncodeError:
            pass
    return text.replace("\n", " ").split(" ")


class Words:
    """Ids of texts as those of their words, of which a bounded number is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}

    def _learn(self, words: list[str]) -> None:
        plain, other = [], []
        for w in words:
            (other if PLAIN(w) is None else plain).append(w)
        for lo in range(0, len(other), LINE):
            part = other[lo : lo + LINE]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known |= {w: array.array("I", e.ids).tobytes() for w, e in zip(part, found, strict=True)}
        for lo in range(0, len(plain), LINE):  # plain words are encoded as lines, whose tokens' offsets tell them apart
            part = plain[lo : lo + LINE]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = array.array("I", e.ids).tobytes()
            begin = np.fromiter((a for a, _ in e.offsets), np.int64, len(e))
            words_at = np.cumsum([0, *[len(w) + 1 for w in part]])
            cut = (4 * np.searchsorted(begin, words_at)).tolist()
            self.known |= {w: ids[a:b] for w, a, b in zip(part, cut[:-1], cut[1:], strict=True)}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cuts = [*map(cut, texts)]
        need = set().union(*cuts)
        new = list(need.difference(self.known))
        if len(self.known) + len(new) > WORDS:
            self.known = {"": b""} | {w: self.known[w] for w in need if w in self.known}
        gc.disable()  # no cycles are made here; what is remembered is then left out of later collections
        self._learn(new)
        gc.freeze()
        gc.enable()
        out = [b"".join(map(self.known.__getitem__, words)) for words in cuts]
        for w in new:
            if len(w) > WORD:
                del self.known[w]
        return out


_WORDS: dict[str, Words] = {}


def _words(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that end before a space or new line."""
    lo = 0
    while len(text) - lo > BLOCK:
        hi = max(text.rfind(" ", lo + 1, lo + BLOCK), text.rfind("\n", lo + 1, lo + BLOCK))
        if hi < 0:
            found = [x for x in (text.find(" ", lo + BLOCK), text.find("\n", lo + BLOCK)) if x >= 0]
            hi = min(found, default=len(text))
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenises each text, ends it with id 0 and cuts what is longer than the capacity.

    Returns doc_id, piece, start, length, ids_crc32. A null or empty text is the one id 0. Only words are remembered
    between texts, so memory is bounded by the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _words(path)

        def lots():
            lot, size = [], 0
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    lot.append((i, t))
                    size += len(t)
                    if size >= BLOCK // 2:
                        yield lot
                        lot, size = [], 0
            yield lot

        for lot in lots():
            ids = words.ids([t for _, t in lot if len(t) <= BLOCK])[::-1]
            out: list[tuple] = []
            for i, t in lot:
                data = (ids.pop() if len(t) <= BLOCK else b"".join(words.ids([p])[0] for p in _parts(t))) + bytes(4)
                for k, lo in enumerate(range(0, len(data), 4 * capacity)):
                    x = data[lo : lo + 4 * capacity]
                    out.append((i, k, lo // 4, len(x) // 4, zlib.crc32(x)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def _groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Runs of (length, first rank, number), longest first, cut into groups of equal cardinality, with the size of each."""
    total = sum(counts.values())
    out, room, done = [], 0, 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            if not room:
                room = max(1, (len(out) + 1) * total // groups - done)
                out.append((length, []))
            n = min(left, room)
            out[-1][1].append([length, rank, n])
            left, rank, room, done = left - n, rank + n, room - n, done + n
    return out


def _fullest(room: int, sizes: list[int], left: list[int], start: int) -> list[int]:
    """Indexes, from ``start`` on, of a set of sizes with the largest sum up to room, the longest first among equals."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for i in range(start, len(sizes)):
        for _ in range(min(left[i], room // sizes[i]) if left[i] else 0):
            after = (reach | reach << sizes[i]) & mask
            if after == reach:
                break
            steps.append((i, reach))
            reach = after
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, []
    for i, before in reversed(steps):
        if not before >> at & 1:
            used.append(i)
            at -= sizes[i]
    return used


def _take(runs: list[list[int]], n: int) -> list[list[int]]:
    out = []
    while n:
        length, rank, have = runs[0]
        k = min(n, have)
        out.append([length, rank, k])
        if k == have:
            runs.pop(0)
        else:
            runs[0] = [length, rank + k, have - k]
        n -= k
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, number, first sequence, offset), by length and rank, and the number of sequences."""
    bins: list[tuple[int, tuple]] = []  # runs of sequences alike: number, ((length, first rank), ...)
    large = {n: c for n, c in counts.items() if n * small > capacity and c}
    few = _groups(large, groups)
    sizes, left = [s for s, _ in few], [sum(r[2] for r in runs) for _, runs in few]
    first = 0
    while first < len(sizes):
        if not left[first]:
            first += 1
            continue
        left[first] -= 1
        used = [first, *_fullest(capacity - sizes[first], sizes, left, first)]
        left[first] += 1
        need = {i: used.count(i) for i in used}
        times = min(left[i] // k for i, k in need.items())
        slots = []
        for i, k in need.items():
            left[i] -= k * times
            slots += [_take(few[i][1], times) for _ in range(k)]
        done = 0
        while done < times:  # actual documents for the rounded ones: a new run wherever a length changes
            n = min(s[0][2] for s in slots)
            bins.append((n, tuple((s[0][0], s[0][1]) for s in slots)))
            for s in slots:
                if s[0][2] == n:
                    s.pop(0)
                else:
                    s[0] = [s[0][0], s[0][1] + n, s[0][2] - n]
            done += n
    open_ = sorted((capacity - sum(n for n, _ in b[1]), k) for k, b in enumerate(bins))
    for length in sorted((n for n in counts if n * small <= capacity and counts[n]), reverse=True):
        rank, c = 0, counts[length]
        while c:
            at = bisect_left(open_, (length, -1))
            if at == len(open_):
                per = min(c, capacity // length)
                n = c // per
                bins.append((n, tuple((length, rank + j * n) for j in range(per))))
                insort(open_, (capacity - per * length, len(bins) - 1))
                rank, c = rank + per * n, c - per * n
                continue
            gap, k = open_.pop(at)
            n, items = bins[k]
            m = min(n, c)
            if m < n:  # the rest of the run stays as it is
                bins.append((n - m, tuple((x, r + m) for x, r in items)))
                insort(open_, (gap, len(bins) - 1))
            bins[k] = (m, (*items, (length, rank)))
            insort(open_, (gap - length, k))
            rank, c = rank + m, c - m
    rows, sequence = [], 0
    for n, items in bins:
        offset = 0
        for length, rank in items:
            rows.append((length, rank, n, sequence, offset))
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def pack(found: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length and any other columns).

    Sequences hold at most ``capacity`` tokens and have no gaps. Ranks are by doc_id, piece and, for repeated rows, in
    any order. No pieces give no rows. The driver gets one count for each length and lot, 2048 and LOTS for each shuffle
    partition; the plan that is broadcast depends on the number of lengths, not of documents.
    """
    spark = found.sparkSession
    found = found.drop("sequence_id", "offset")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan(counts, capacity, groups)
    # the rows of a length are ranked in lots, so that a common length is no single task; lots are as many as lengths and
    # LOTS for each partition together, whatever the number of rows
    most = max(1, sum(counts.values()) // (LOTS * parallelism(spark)))
    lots = F.array(*[F.lit(max(1, -(-counts.get(n, 0) // most))) for n in range(capacity + 1)])
    lot = F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(lots, (F.col("length") + 1).cast("int"))).cast("int")
    rows = found.withColumn("__lot", lot)
    sizes = sorted(map(tuple, rows.groupBy("length", "__lot").agg(F.count("*").alias("n")).collect()))
    ahead, before = {}, 0
    for i, (length, k, n) in enumerate(sizes):
        before = 0 if i == 0 or sizes[i - 1][0] != length else before
        ahead[length << 32 | k] = before
        before += n
    keys, firsts = (np.array(x, np.int64) for x in ([*ahead], [*ahead.values()]))
    given = spark.sparkContext.broadcast((keys, firsts, slots[:, 0] << 44 | slots[:, 1], slots))

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pd.Series, lot: pd.Series, row: pd.Series) -> pd.DataFrame:
        keys, firsts, begin, slots = given.value
        length = length.to_numpy()
        rank = firsts[np.searchsorted(keys, length << 32 | lot.to_numpy())] + row.to_numpy() - 1
        s = slots[np.searchsorted(begin, length << 44 | rank, side="right") - 1]
        return pd.DataFrame({"sequence_id": s[:, 3] + rank - s[:, 1], "offset": s[:, 4]})

    w = Window.partitionBy("length", "__lot").orderBy("doc_id", "piece")
    rows = rows.withColumn("__row", F.row_number().over(w).cast("bigint")).withColumn("__at", place("length", "__lot", "__row"))
    return rows.select(*found.columns, "__at.sequence_id", "__at.offset")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(staged(pieces(docs, path, capacity, doc_id, text), "pieces"), capacity)
