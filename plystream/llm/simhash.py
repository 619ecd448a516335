"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints have 64 bits, 8 bytes. Two that differ in at most 2 bits share at least 6 bytes at the same positions, so the
guaranteed minimum of shared positional bytes is 6. The index therefore has a posting list for each set of 6 positions
and the bytes there: two fingerprints meet in some list exactly if they reach the minimum, without a tally of the far
larger lists of single bytes, each of which would hold a 256th of the corpus. What a list's members still may differ in
are 16 bits, so a list of distinct fingerprints has at most 65536 members. Members are verified by their Hamming
distance, and a list gives the edges of a spanning forest instead of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plystream.llm.common import join_groups, staged, without
from plystream.llm.components import connected_components

SEED, WIDTH, BITS = 42, 3, 2
#: Bytes of a text that are cut into words at once.
BLOCK = 1 << 22


def shingle_hashes(text: str, width: int = WIDTH, block: int = BLOCK) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a whole text, repeats included, some at a time."""
    from xxhash import xxh64_intdigest

    data, lo, kept, any_ = text.encode("utf-8", "surrogatepass").lower(), 0, [], False  # bytes.lower() changes A-Z only
    while lo < len(data):
        hi = lo + block
        while hi < len(data) and data[hi] not in b"\x20\t\n\x0b\x0c\r":
            hi += 1
        words = kept + data[lo:hi].split()  # bytes.split() cuts at \x20\x09-\x0D
        if len(words) >= width:
            any_ = True
            joined = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            yield np.fromiter(map(partial(xxh64_intdigest, seed=SEED), joined), np.uint64, len(words) - width + 1)
        kept, lo = words[-(width - 1) :] if width > 1 else [], hi
    if not any_ and kept:
        yield np.array([xxh64_intdigest(b" ".join(kept), seed=SEED)], np.uint64)


def simhash(text: str, width: int = WIDTH) -> int:
    """Each bit is 1 if set in over half the hashes; 0 without words."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width):
        for lo in range(0, len(h), 1 << 15):
            bits = np.unpackbits(h[lo : lo + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Returns doc_id and fp, the fingerprint as a signed long, for each row. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((simhash(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def _forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges that join those of the distinct fingerprints that differ in at most ``bits`` bits, no more than needed."""
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def near() -> Iterator[tuple[int, int]]:
        if len(fps) <= 64:
            for i in range(len(fps) - 1):
                for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= bits):
                    yield i, i + 1 + int(j)
            return
        order = np.argsort(fps)
        values, free = fps[order], int(np.bitwise_or.reduce(fps ^ fps[0]))
        single = [1 << b for b in range(64) if free >> b & 1]  # at most 16 bits vary in a list
        for size in range(1, bits + 1):
            for flips in combinations(single, size):
                other = values ^ np.uint64(sum(flips))
                at = np.minimum(np.searchsorted(values, other), len(values) - 1)
                for i in np.flatnonzero((values[at] == other) & (other > values)):
                    yield int(order[i]), int(order[at[i]])

    edges = []
    for i, j in near():
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((i, j))
    return edges


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """fps: distinct (fp, rep). Returns edges (u, v) of representatives that join all fingerprints that link."""
    if not 0 <= bits <= 4:
        raise ValueError("bits: 0 to 4")
    masks = [sum(0xFF << 8 * i for i in kept) for kept in combinations(range(8), 8 - bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    posted = fps.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("positions", "bytes"))
    lists = posted.groupBy("positions", "bytes").agg(F.collect_list(F.struct("fp", "rep")).alias("members")).where(F.size("members") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0)
            starts, rows = col.offsets.to_numpy(), col.values
            fp, rep = rows.field("fp").to_numpy().view(np.uint64), rows.field("rep").to_numpy()
            u, v = [], []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                for i, j in _forest(fp[lo:hi], bits):
                    u.append(rep[lo + i])
                    v.append(rep[lo + j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return lists.select("members").mapInArrow(run, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """Returns doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links, one row for
    each row of ``docs``. Documents without words have fingerprint zero and link like others. Rows with a null id get a
    fingerprint, and a component if their fingerprint is some other document's. Repeated rows share a component;
    other columns are ignored; an empty table gives no rows.
    """
    rows = staged(fingerprints(docs, doc_id, text, width), "simhash")
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-distinct")
    known = connected_components(links(fps.where("rep is not null"), bits))
    classes = staged(fps.join(known.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id")), "simhash-classes")
    return join_groups(rows, classes, "fp", "n").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """The documents that are the smallest of their component, with all their columns. Rows with a null id link no others;
    those that link to no document with an id stay, one for each component of such rows."""
    near = near_duplicates(docs, doc_id, text, width, bits)
    gone = near.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone"))
    kept = without(docs, doc_id, gone.where("gone").select("doc_id"))
    unnamed = docs.where(docs[doc_id].cast("bigint").isNull()).withColumn("__hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    if unnamed.isEmpty():
        return kept
    named = near.where("doc_id is not null").select(F.conv("fingerprint", 16, -10).cast("bigint").alias("fp")).distinct()
    lone = staged(fingerprints(unnamed, "__hash", text, width).distinct(), "simhash-unnamed")
    fps = staged(named.select("fp", F.lit(1).alias("named")).unionAll(lone.select("fp", F.lit(0))).groupBy("fp").agg(F.max("named").alias("named")), "simhash-all")
    known = connected_components(links(fps.select("fp", F.col("fp").alias("rep")), bits)).withColumnRenamed("node", "fp")
    classes = fps.join(known, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    alone = classes.groupBy("component").agg(F.max("named").alias("named")).where("named = 0").select("component")
    chosen = lone.join(classes.join(alone, "component"), "fp").groupBy("component").agg(F.min("doc_id").alias("__hash")).select("__hash")
    return kept.unionByName(unnamed.join(chosen, "__hash", "left_semi").dropDuplicates(["__hash"]).select(*docs.columns))
