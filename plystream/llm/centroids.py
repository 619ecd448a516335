"""Clustering around centroids with Drake's adaptive bounds, in exact integers.

Each vector keeps, beside its cluster and an upper bound of the distance to that centroid, the few centroids that come
next, each with a lower bound of its distance, and one bound for all the rest. When centroids move, bounds move by as much.
A vector whose upper bound stays under the first lower bound needs no distance at all; otherwise it is compared with no
more than the centroids before the first bound that certifies the order, and with all of them only if none does. How many
bounds are kept adapts to how many the last round needed.

A round reads the vectors with their bounds once and writes them once to the shared folder; vectors never cross an exchange. The
new centroids come from the old sums and the vectors that changed their cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plystream.llm.common import staged

DIM, K, ROUNDS, SCALE, BOUNDS = 64, 8, 10, 1024, 4
#: Components up to which the squared distance of 64 of them fits into 64 bits.
LARGEST = 1 << 27
#: Room for the rounding of bounds, which are doubles. Distances that are compared with each other are exact.
UP, DOWN = 1 + 1e-12, 1 - 1e-12


def prepared(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the vectors with exactly ``dim`` components, none null or non-finite, as integers floor(scale * component)."""
    v = F.col(embedding)
    fine = lambda e: e.isNotNull() & (F.abs(e) * scale < LARGEST)  # noqa: E731  NaN is larger than all numbers
    rows = vectors.where((F.size(v) == dim) & F.coalesce(F.forall(v, lambda e: F.coalesce(fine(e.cast("double")), F.lit(False))), F.lit(False)))
    return rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(v, lambda e: F.floor(e.cast("double") * scale).cast("int")).alias("x"))


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers to one centroid, or each to its own."""
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """Clusters of a batch of vectors with their bounds: ``near`` holds the next centroids in order, ``low`` a bound for each, that also
    holds for all behind it, and last the one for the rest."""

    def __init__(self, cluster, upper, near, low):
        self.cluster, self.upper, self.near, self.low = cluster, upper, near, low
        self.used = np.zeros(len(cluster), np.int32)

    @classmethod
    def scanned(cls, x: np.ndarray, c: np.ndarray, kept: int) -> Bounds:
        """From all distances; of equal ones the smaller number comes first."""
        d = np.stack([squared(x, one) for one in c], axis=1)
        order = np.argsort(d, axis=1, kind="stable")
        far = np.take_along_axis(d, order, axis=1)
        low = np.concatenate([np.sqrt(far[:, 1:]) * DOWN, np.full((len(x), 1), np.inf)], axis=1)[:, : kept + 1]
        return cls(order[:, 0], np.sqrt(far[:, 0]) * UP, order[:, 1 : 1 + kept], low)

    def put(self, at: np.ndarray, other: Bounds) -> None:
        self.cluster[at], self.upper[at], self.near[at], self.low[at] = other.cluster, other.upper, other.near, other.low

    def moved(self, drift: np.ndarray) -> None:
        """The bounds after the centroids have moved by ``drift``."""
        self.upper = (self.upper + drift[self.cluster]) * UP
        self.low[:, :-1] = self.low[:, :-1] * DOWN - drift[self.near]
        self.low[:, -1] = self.low[:, -1] * DOWN - drift.max()
        self.low = np.minimum.accumulate(self.low[:, ::-1], axis=1)[:, ::-1].copy()

    def certified(self, at: np.ndarray) -> np.ndarray:
        """How many of the next centroids come before the first bound over the upper one; one more than there are, if none is."""
        over = self.upper[at, None] < self.low[at]
        return np.where(over.any(axis=1), over.argmax(axis=1), over.shape[1])

    def settle(self, x: np.ndarray, c: np.ndarray) -> None:
        """Brings clusters up to date with the centroids, exactly."""
        at = np.flatnonzero(self.certified(np.arange(len(x))))
        self.upper[at] = np.sqrt(squared(x[at], c[self.cluster[at]])) * UP
        need = self.certified(at)
        at, need = at[need > 0], need[need > 0]
        self.used[at] = need
        kept = self.near.shape[1]
        for z in range(1, kept + 1):
            rows = at[need == z]
            if len(rows):
                some = np.sort(np.concatenate([self.cluster[rows, None], self.near[rows, :z]], axis=1), axis=1)
                d = np.stack([squared(x[rows], c[some[:, k]]) for k in range(z + 1)], axis=1)
                order = np.argsort(d, axis=1, kind="stable")
                some, d = np.take_along_axis(some, order, axis=1), np.take_along_axis(d, order, axis=1)
                self.cluster[rows], self.upper[rows], self.near[rows, :z] = some[:, 0], np.sqrt(d[:, 0]) * UP, some[:, 1:]
                self.low[rows, :z] = np.sqrt(d[:, 1:]) * DOWN
        rows = at[need > kept]
        if len(rows):
            self.put(rows, Bounds.scanned(x[rows], c, kept))

    def narrowed(self, kept: int) -> None:
        """Keeps fewer bounds; the first that goes holds for all behind it."""
        if kept < self.near.shape[1]:
            self.near, self.low = self.near[:, :kept], self.low[:, : kept + 1]


def _ints(column: pa.Array, kind=np.int64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), len(flat) // len(column))


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel()))


STATE = "vec_id bigint, x array<int>, cluster int, was int, upper double, near array<int>, low array<double>, used int"


def assigned(rows: DataFrame, centroids: np.ndarray, kept: int, before: np.ndarray | None = None) -> DataFrame:
    """One round: rows (vec_id, x), or those of the round before, whose centroids were ``before``, with their clusters."""
    drift = None if before is None else np.sqrt(squared(centroids, before)) * UP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _ints(b.column("x"))
            if drift is None:
                was, now = np.full(len(x), -1), Bounds.scanned(x, centroids, kept)
            else:
                was = b.column("cluster").to_numpy().astype(np.int64)
                now = Bounds(was.copy(), b.column("upper").to_numpy().copy(), _ints(b.column("near")), _ints(b.column("low"), float))
                now.moved(drift)
                now.settle(x, centroids)
                now.narrowed(kept)
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id"), b.column("x"), pa.array(now.cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(now.upper),
                _lists(now.near.astype(np.int32)), _lists(now.low), pa.array(now.used)], [f.split()[0] for f in STATE.split(", ")])

    return rows.mapInArrow(run, STATE)


def changes(state: DataFrame, k: int, dim: int) -> np.ndarray:
    """What the vectors that changed their cluster add to each cluster: k rows of a count and ``dim`` sums. A task adds its own up
    first, so that k * (dim + 1) numbers of each task are exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for b in batches:
            if b.num_rows:
                x = np.concatenate([np.ones((b.num_rows, 1), np.int64), _ints(b.column(0))], axis=1)
                now, was = b.column(1).to_numpy(), b.column(2).to_numpy()
                np.add.at(total, now, x)
                np.subtract.at(total, was[was >= 0], x[was >= 0])
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "n"])

    moved = state.where("cluster <> was").select("x", "cluster", "was").mapInArrow(run, "i int, j int, n bigint")
    out = np.zeros((k, dim + 1), np.int64)
    for r in moved.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # at most k * (dim + 1) rows
        out[r["i"], r["j"]] = r["n"]
    return out


def clustered(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = "3", bounds: int = BOUNDS) -> tuple[DataFrame, np.ndarray]:
    """``rows``: (vec_id, x), arrays of integers of one length. Returns (vec_id, cluster, distance) and the k centroids.

    Centroids start as the k vectors with the smallest sha256 of ``seed:vec_id``; of rows with one id the smallest vector comes
    first, rows without an id come last. After ``rounds`` rounds vectors are assigned once more. Of equal distances the smaller
    number wins; a centroid without vectors stays. Fewer than k vectors are as many centroids; none give no rows. The
    centroids, k times the length, are all that passes the driver.
    """
    spark = rows.sparkSession
    rows = staged(rows, "centroids-vectors")
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = [r["x"] for r in rows.orderBy(named.asc_nulls_last(), "x").limit(k).select("x").collect()]
    if not first:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), np.zeros((0, 0), np.int64)
    c = np.array(first, np.int64)
    k, dim = c.shape
    kept = min(bounds, k - 1)
    state = staged(assigned(rows, c, kept), "centroids-state", instead_of=rows)
    total, before = changes(state, k, dim), c
    for done in range(1, rounds + 1):
        c = np.where(total[:, :1] > 0, total[:, 1:] // np.maximum(total[:, :1], 1), before)  # // floors
        if np.array_equal(c, before):
            break
        state = staged(assigned(state, c, kept, before), "centroids-state", instead_of=state)
        if done < rounds:
            kept = min(kept, max(state.agg(F.max("used")).first()[0], 1)) if kept else 0
            total, before = total + changes(state, k, dim), c

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = squared(_ints(b.column(1)), c[b.column(2).to_numpy()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(d)], ["vec_id", "cluster", "distance"])

    return staged(state.select("vec_id", "x", "cluster").mapInArrow(measure, "vec_id bigint, cluster int, distance bigint"), "centroids-found", instead_of=state), c


def clusters(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = DIM, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: str = "3") -> DataFrame:
    """Returns vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256, one row for each vector kept.

    Vectors of another length, null ones, and those with a null or non-finite component are left out; so are those with a
    component of 2^17 or more after which a squared distance would not fit into 64 bits. Repeated rows count one by one; null ids
    are rows like others; an empty table gives no rows; other columns play no part.
    """
    found, c = clustered(prepared(vectors, vec_id, embedding, dim, scale), k, rounds, seed)
    each = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # at most k rows
    shown = [(i, each.get(i, 0), sum(each.values()), sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(c.tolist())]
    small = found.sparkSession.createDataFrame(shown, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
