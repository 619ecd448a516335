"""Document fingerprints from closed syncmers.

A k-mer of code points is selected if the smallest hash among its inner s-mers is at its first or last place. Whether it
is selected depends on the k-mer alone, so equal passages select equal anchors wherever they stand. The fingerprint is
the bottom-m sketch of a document's anchors, the hash and the first place of each. Likeness matches anchors by hash and
chains the matches: it is the largest number of them that stand in the same order in both documents, over the number of
anchors in the sketch of both. Without moved passages it estimates the Jaccard index of the two sets of anchors.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plystream.llm.common import parallelism

K, S, SKETCH = 16, 6, 128
#: Code points in a block of work; longer texts are done in overlapping pieces of this length.
BLOCK = 1 << 19
_EDGE = 0x110000  # no code point; K // 2 of them stand before and after a text, so that short texts have anchors
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Where a row without an id stands in the order: before all others.
NO_ID = -(2**63)
ANCHOR = np.dtype([("hash", np.uint64), ("at", np.int64)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def select(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes (48 bits) of the closed syncmers of an array of code points."""
    n = len(points) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    c = points.astype(np.uint64)
    m = len(c) - s + 1
    h = c[:m].copy()
    for j in range(1, s):
        h *= _ODD
        h += c[j : j + m]
    h = _mix(h)
    w = k - s + 1
    low, span = h, 1
    while span < w:  # the minimum over a window, by doubling
        step = min(span, w - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    at = np.flatnonzero((low == h[:n]) | (low == h[w - 1 :]))
    kmer = h[at]
    for j in (*range(s, k - s, s), k - s):
        kmer = kmer * _ODD + h[at + j]
    return at, _mix(kmer) >> np.uint64(16)


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places (negative ones begin in the edge) and hashes of a whole text's anchors."""
    edge = np.full(K // 2, _EDGE, np.uint32)
    points = np.concatenate([edge, code_points(text), edge]) if text else np.zeros(0, np.uint32)
    parts = [(lo, *select(points[lo : lo + BLOCK + K - 1])) for lo in range(0, len(points), BLOCK)]
    at = np.concatenate([lo + a for lo, a, _ in parts] or [np.zeros(0, np.int64)])
    return at - K // 2, np.concatenate([h for _, _, h in parts] or [np.zeros(0, np.uint64)])


def _whole(text: str) -> np.ndarray:
    """For a text without anchors: its own hash."""
    h = np.uint64(len(text))
    with np.errstate(over="ignore"):
        for c in code_points(text):
            h = h * _ODD + np.uint64(c)
    return _mix(np.array([h], np.uint64)) >> np.uint64(16)


def _smallest(h: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """The m smallest distinct hashes with the first place of each, by hash."""
    found, first = np.unique(h, return_index=True)
    out = np.zeros(min(len(found), m), ANCHOR)
    out["hash"], out["at"] = found[:m], at[first[:m]]
    return out


def sketches(texts: list[str], m: int = SKETCH) -> list[np.ndarray]:
    """The m anchors of each text with the smallest hashes; none for an empty text. Places count from K // 2 before the
    text. Many short texts are done at once."""
    out: list[np.ndarray | None] = [None] * len(texts)
    edge = np.full(K // 2, _EDGE, np.uint32)
    todo: list[int] = []
    size = 0

    def flush() -> None:
        parts = [p for i in todo for p in (edge, code_points(texts[i]), edge)]
        ends = np.cumsum([len(texts[i]) + K // 2 * 2 for i in todo])
        at, h = select(np.concatenate(parts))
        cut = np.searchsorted(at, ends)
        last = np.searchsorted(at, ends - K, side="right")  # beyond it, k-mers cross into the next text
        lo = begin = 0
        for i, a, b, end in zip(todo, last, cut, ends, strict=True):
            out[i] = _smallest(h[lo:a], at[lo:a] - begin, m) if a > lo else _smallest(_whole(texts[i]), np.zeros(1, np.int64), m)
            lo, begin = b, end
    for i, t in enumerate(texts):
        if not t:
            out[i] = np.zeros(0, ANCHOR)
        elif len(t) > BLOCK:
            found = np.zeros(0, ANCHOR)
            points = np.concatenate([edge, code_points(t), edge])
            for lo in range(0, len(points), BLOCK):
                at, h = select(points[lo : lo + BLOCK + K - 1])
                found = _smallest(np.concatenate([found["hash"], h]), np.concatenate([found["at"], at + lo]), m)
            out[i] = found
        else:
            todo.append(i)
            size += len(t) + K
            if size >= BLOCK:
                flush()
                todo, size = [], 0
    if todo:
        flush()
    return out


def to_text(sketch: np.ndarray) -> str:
    """48 bits for each hash and 32 for its place, big-endian, in base 64; empty for an empty text."""
    eight = lambda name: sketch[name].astype(">u8").view(np.uint8).reshape(-1, 8)
    return base64.b64encode(np.concatenate([eight("hash")[:, 2:], eight("at")[:, 4:]], axis=1).tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    ten = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 10)
    out = np.zeros(len(ten), ANCHOR)
    for name, part in (("hash", ten[:, :6]), ("at", ten[:, 6:])):
        out[name] = np.concatenate([np.zeros((len(ten), 8 - part.shape[1]), np.uint8), part], axis=1).reshape(-1).view(">u8")
    return out


def chain(places: list[int]) -> int:
    """The length of the longest increasing subsequence."""
    ends: list[int] = []
    for x in places:
        k = bisect_left(ends, x)
        ends[k : k + 1] = [x]
    return len(ends)


def likeness(a: np.ndarray, b: np.ndarray, m: int = SKETCH) -> float:
    """Of the m smallest hashes of both texts, the share that both have and that can be matched in order of place. Two
    empty texts are alike; an empty and another not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, i, j = np.intersect1d(a["hash"], b["hash"], assume_unique=True, return_indices=True)
    size = min(m, len(a) + len(b) - len(both))
    if not len(both):
        return 0.0
    top = np.union1d(a["hash"], b["hash"])[size - 1]
    i, j = i[both <= top], j[both <= top]
    return chain(b["at"][j][np.argsort(a["at"][i])].tolist()) / size


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns doc_id, n_chars, fingerprint for each row. Null texts count as empty; other columns are ignored; repeated
    rows give repeated rows. No exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_text(x) for x in sketches(texts)], pa.string())], names)

    names = ["doc_id", "n_chars", "fingerprint"]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, fingerprint string")


def in_order(docs: DataFrame, buckets: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Deals rows to ``buckets`` ranges of doc_id, sorted in each, and gives each range a copy of the first document of
    the range after it (the last one: of the first), so that a task sees the document that follows each of its own.

    Returns __bucket, __copy, doc_id, text. Only the ranges' bounds and first ids, as many as buckets, go to the driver.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    bounds = ids.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets) if buckets > 1 else []
    bounds = np.unique(np.array([int(x) for x in bounds], np.int64))

    @F.pandas_udf("int")
    def bucket(s):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, s.to_numpy(), side="right").astype("int32"))

    firsts = sorted((r["b"], r["first"]) for r in ids.groupBy(bucket("doc_id").alias("b")).agg(F.min("doc_id").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    rows = rows.withColumn("own", bucket("doc_id"))
    if before:
        to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        also = F.when(F.col("doc_id").isin(list(before)), F.array(F.struct(F.col("own").alias("b"), F.lit(False).alias("c")), F.struct(F.element_at(to, F.col("doc_id")).alias("b"), F.lit(True).alias("c"))))
    else:
        also = F.lit(None)
    rows = rows.withColumn("x", F.explode(F.coalesce(also, F.array(F.struct(F.col("own").alias("b"), F.lit(False).alias("c"))))))
    rows = rows.select(F.col("x.b").alias("__bucket"), F.col("x.c").alias("__copy"), "doc_id", "text")
    return rows.repartitionById(buckets, F.col("__bucket")).sortWithinPartitions("__bucket", "__copy", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited form: the last quarter of its code points (rounded down) gives way to
    as many of the next document's first ones, or all it has; the document after the last is the first.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Rows that share an
    id follow each other by text. A lone document follows itself. Null texts count as empty; null ids come first
    and stay null. An empty table gives no rows. The texts cross one exchange.
    """
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():  # rows, a bounded lot of text at a time
            lot, size = [], 0
            for b in batches:
                for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    lot.append(row)
                    size += len(row[3])
                    if size >= BLOCK:
                        yield lot
                        lot, size = [], 0
            yield lot

        held = None  # the row before, with its sketch, that still lacks the next
        for lot in pieces():
            found = sketches([r[3] for r in lot])
            pairs = []
            for row, sketch in zip(lot, found, strict=True):
                if held and not held[0][1] and held[0][0] == row[0]:
                    pairs.append((held, (row, sketch)))
                held = (row, sketch)
            edited = [(t := a[0][3])[: len(t) - len(t) // 4] + b[0][3][: len(t) // 4] for a, b in pairs]
            after = sketches(edited)
            yield pa.RecordBatch.from_arrays([
                pa.array([None if a[0][2] == NO_ID else a[0][2] for a, _ in pairs], pa.int64()), pa.array([len(a[0][3]) for a, _ in pairs], pa.int64()),
                pa.array([sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                pa.array([to_text(a[1]) for a, _ in pairs], pa.string()), pa.array([to_text(x) for x in after], pa.string()),
                pa.array([likeness(a[1], x) for (a, _), x in zip(pairs, after, strict=True)], pa.float64()),
                pa.array([likeness(a[1], b[1]) for a, b in pairs], pa.float64())], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = in_order(docs, buckets or parallelism(docs.sparkSession), doc_id, text)
    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
