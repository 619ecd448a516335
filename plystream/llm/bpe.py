"""Byte-level BPE by merge replay over a corpus of words.

Texts are cut into words, the matches of a pattern, and the distinct words of a lot of documents are merged together: an inverted index leads from each mergeable token pair to all its places in all words,
pairs are taken in rank order, and each merge updates the two neighbours it touches. Words don't affect each other, so
lots, remembered words and their order change no result. Memory is bounded by a lot and the longest text; a word of
1.6 million letters took 384 MB.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space, letters and numbers among the first 256 code points, as character classes.
_WS1, _L1, _N1 = r"\t-\r \x85\xa0", r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: Entries of a worker's memory of words, code points of a word that is remembered, and of a lot of texts.
WORDS, WORD, LOT = 1_000_000, 64, 1 << 21
#: A token that merges with nothing, and the mark of a place whose token has gone into the one before.
NOTHING, DEAD = 1 << 19, -1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def replay(words: list[bytes], table: Table) -> list[list[int]]:
    """The ids of each word, which may not be empty."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    # bytes of all words, with a token that merges with nothing before, between and after them
    data = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
    gaps = np.concatenate([[0], np.cumsum(sizes + 1)])
    first = table.single[data]
    first[gaps] = NOTHING
    pair = np.zeros(len(data), np.int64)  # by place, the id that the token there and the next one merge into, or 0
    pair[:-1] = table.double[data[:-1], data[1:]]
    pair[gaps] = 0
    pair[gaps[1:] - 1] = 0
    at = np.flatnonzero(pair)
    at = at[np.argsort(pair[at], kind="stable")]
    found, begin = np.unique(pair[at], return_index=True)
    places: list[list[int] | None] = [None] * (table.size + 1)  # the inverted index, by the id that a pair merges into
    for m, lo, hi in zip(found.tolist(), begin.tolist(), [*begin.tolist(), len(at)][1:], strict=True):
        places[m] = at[lo:hi].tolist()
    tok, pair = first.tolist(), pair.tolist()
    nxt, prv = [*range(1, len(tok) + 1)], [*range(-1, len(tok) - 1)]
    get, m = table.merges.get, 0
    while m < table.size:
        m += 1
        todo = places[m]
        if not todo:
            continue
        places[m] = None
        todo.sort()
        back = m
        for n, i in enumerate(todo):
            if pair[i] != m:
                continue
            j = nxt[i]
            k = nxt[i] = nxt[j]
            prv[k] = i
            h = prv[i]
            tok[i], pair[j] = m, DEAD
            r = pair[i] = get(m << 20 | tok[k], 0)
            if r:
                if places[r] is None:
                    places[r] = [i]
                else:
                    places[r].append(i)
                if r < back:
                    back = r
            r = pair[h] = get(tok[h] << 20 | m, 0)
            if r:
                if places[r] is None:
                    places[r] = [h]
                else:
                    places[r].append(h)
                if r < back:
                    back = r
            if back < m:  # a pair of a lower rank has come up: it goes before the rest
                places[m] = (places[m] or []) + todo[n + 1 :]
                m = back - 1
                break
    alive = np.array(pair) != DEAD
    alive[gaps] = False
    ids = np.array(tok)[alive].tolist()
    ends = np.cumsum(alive)[gaps].tolist()
    return [ids[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


class Table:
    """The vocabulary as replay needs it; ids are raised by 1, so that 0 says that a pair doesn't merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        if self.size >= NOTHING:
            raise ValueError("the vocabulary is too large")
        self.token = {i: t for t, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] + 1 for b in range(256)])
        self.merges = {ranks[t[:k]] + 1 << 20 | ranks[t[k:]] + 1: i + 1 for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.double = np.array([[ranks.get(bytes([a, b]), -1) + 1 for b in range(256)] for a in range(256)])

    def encode(self, words: list[bytes]) -> list[list[int]]:
        return [[i - 1 for i in ids] for ids in replay(words, self)] if words else []


class Encoder:
    """Encodes and decodes by a rank file; remembers a bounded number of words."""

    def __init__(self, path: str, pattern: str):
        import re

        import regex

        self.table = Table(load_ranks(path))
        self.pattern = regex.compile(pattern)
        # the same pattern with its classes spelt out for texts of the first 256 code points, for the faster module
        narrow = pattern.replace(r"\s\p{L}\p{N}", _WS1 + _L1 + _N1).replace(r"\p{L}", f"[{_L1}]").replace(r"\p{N}", f"[{_N1}]")
        narrow = narrow.replace(r"\S", f"[^{_WS1}]").replace(r"\s", f"[{_WS1}]")
        self.narrow = re.compile(narrow) if "\\p" not in narrow else None
        self.known: dict[str, tuple[str, bytes]] = {}

    def cut(self, text: str) -> list[str]:
        """The pattern's matches."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern.findall(text)
        return (self.narrow or self.pattern).findall(text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.table.token[i] for i in ids])

    def look_up(self, cuts: list[list[str]]) -> list[list[tuple[str, bytes]]]:
        """Decimal ids, each with a comma after it, and decoded bytes of the matches in some texts."""
        need = set().union(*cuts)
        new = list(need.difference(self.known))
        if len(self.known) + len(new) > WORDS:
            self.known = {w: self.known[w] for w in need if w in self.known}
        gc.disable()  # no cycles are made here; what is remembered is then left out of later collections
        for w, ids in zip(new, self.table.encode([w.encode() for w in new]), strict=True):
            self.known[w] = ("".join([f"{i}," for i in ids]), self.decode(ids))
        gc.freeze()
        gc.enable()
        out = [[*map(self.known.__getitem__, c)] for c in cuts]
        for w in new:
            if len(w) > WORD:
                del self.known[w]
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= LOT:
                yield ids, texts
                ids, texts, size = [], [], 0
    yield ids, texts


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns doc_id and ids for each row, repeated ones too. Null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for i, texts in _lots(batches):
            cuts = [e.cut(t) for t in texts]
            ids = [[int(x) for x in "".join([x for x, _ in f]).split(",")[:-1]] for f in e.look_up(cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _rows(docs, doc_id, text).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Returns doc_id and the decoded bytes of rows (doc_id, ids); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes without leaving the task: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas),
    decoded_sha256, for each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for i, texts in _lots(batches):
            cuts = [e.cut(t) for t in texts]
            found = e.look_up(cuts)
            ids = ["".join([x for x, _ in f]) for f in found]
            back = [b"".join([x for _, x in f]) for f in found]
            yield pa.RecordBatch.from_arrays([
                pa.array(i, pa.int64()), pa.array([x.count(",") for x in ids], pa.int64()),
                pa.array([sha256(x[:-1].encode()).hexdigest() for x in ids], pa.string()), pa.array([sha256(x).hexdigest() for x in back], pa.string())], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return _rows(docs, doc_id, text).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
