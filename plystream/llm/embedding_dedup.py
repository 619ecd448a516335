"""Near-duplicate embeddings by randomly rotated binary codes with stored correction factors.

A unit vector x is rotated by one random rotation, the same for all, and stored as the signs of what comes out, its code, and
a = <code, x>, its correction factor. For any unit vector y, <code, y> / a is an unbiased estimate of <x, y>. Its error is
<e, y'> sqrt(1 - <x, y>^2) sqrt(1 - a^2) / a for unit vectors e and y', so the code and the factor bound the cosine: with t the
threshold, <x, y> >= t is possible only if the estimate lies between t - h and t + h, h = sqrt(1 - t^2) sqrt(1 - a^2) / a (above,
the whole interval applies in angles, see ``bounds``). The bound is taken at a confidence of 1, so that a pair outside of it is no
link for certain, and only the pairs inside of it are computed again, in double precision.

Pairs are compared in blocks of bounded size, one task each. Large labels are cut into cells around a bounded sample of their
vectors; a vector is compared outside its own cell only with cells on whose side of the bisecting plane a vector within the
threshold can lie, which loses nothing. A cell that is still too large is dealt into lots, and each pair of lots is a block.
A block gives the number of links of each vector and a spanning forest of its links, never all its pairs; equal vectors
are compared once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plystream.llm.common import BROADCAST, join_groups, parallelism, staged
from plystream.llm.components import connected_components

THRESHOLD, SEED = 0.93, 12
#: Vectors of a cell or lot, so a block holds at most about twice as many; and centres of cells over all labels.
CELL, CENTRES = 16384, 16384
#: Room for rounding in comparisons of cosines in single precision; the links themselves are decided in double precision.
SLACK = 1e-4


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def encode(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes, one row of bytes each, and correction factors of unit vectors."""
    y = units @ turn.T
    return np.packbits(y > 0, axis=1), np.abs(y).sum(axis=1) / np.sqrt(y.shape[1])


def signs(codes: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1


def estimates(units: np.ndarray, turn: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Unbiased estimates of all inner products of unit vectors (rows) with the vectors that the codes stand for (columns)."""
    dim = units.shape[1]
    return ((units @ turn.T).astype(np.float32) @ signs(codes, dim).T) / (np.sqrt(dim) * factors).astype(np.float32)


def bounds(factors: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The interval of estimates, for each code, in which a cosine of the threshold or more can lie."""
    far = np.sqrt(1 - threshold**2) * np.sqrt(np.maximum(1 - factors**2, 0)) / factors
    # a vector nearer to the code than x is by more than the threshold's angle is no link either
    high = np.where(factors < threshold, threshold + far, 1 / factors)
    return threshold - far - SLACK, high + SLACK


class Links:
    """The links of a block: how many vectors each of its vectors links to, and a spanning forest."""

    def __init__(self, n: int):
        self.label, self.count, self.edges = np.arange(n), np.zeros(n, np.int64), []

    def add(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> None:
        np.add.at(self.count, i, size[j])
        np.add.at(self.count, j, size[i])
        while True:
            a, b = self.label[i], self.label[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            if not len(i):
                return
            high, first = np.unique(np.maximum(a, b), return_index=True)  # each tree is hung to one smaller tree
            parent = np.arange(len(self.label))
            parent[high] = np.minimum(a, b)[first]
            self.edges += zip(i[first].tolist(), j[first].tolist(), strict=True)
            while not np.array_equal(parent, parent[parent]):
                parent = parent[parent]
            self.label = parent[self.label]


def compare(units: np.ndarray, codes: np.ndarray, factors: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, turn: np.ndarray, rows: int = 256) -> Links:
    """The links between the vectors at ``left`` and at ``right``, two ranges of places; the same one twice: among each other."""
    links, low_high = Links(len(units)), bounds(factors[right], threshold)
    code, factor, within = codes[right], factors[right], left is right
    for at in range(0, len(left), rows):
        part = left[at : at + rows]
        shown = estimates(units[part], turn, code, factor)
        open_ = (shown >= low_high[0]) & (shown <= low_high[1])
        i, j = np.nonzero(open_)
        if within:
            i, j = i[j > i + at], j[j > i + at]
        for lo in range(0, len(i), 1 << 16):
            a, b = part[i[lo : lo + (1 << 16)]], right[j[lo : lo + (1 << 16)]]
            near = np.einsum("ij,ij->i", units[a], units[b]) >= threshold
            links.add(a[near], b[near], size)
    return links


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def coded(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, node, label, dim, vector, code, factor); node names the label and vector, and is null where there is nothing to
    compare: no label, no components, a null or non-finite one, or zero length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            ids, vectors, labels = b.column(0), b.column(1), b.column(2)
            offsets, flat = vectors.offsets.to_numpy(), vectors.values
            holes = np.concatenate([[0], np.cumsum(~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False)))])
            rough = flat.fill_null(0).to_numpy(zero_copy_only=False)
            filled = np.concatenate([[0], np.cumsum(np.nan_to_num(rough) != 0)])
            begin, end = offsets[:-1], offsets[1:]
            good = (holes[end] == holes[begin]) & (filled[end] > filled[begin]) & vectors.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
            node, code, factor = [None] * len(ids), [None] * len(ids), np.zeros(len(ids))
            by_dim = defaultdict(list)
            for k in np.flatnonzero(good):
                by_dim[int(end[k] - begin[k])].append(int(k))
            for dim, at in by_dim.items():
                if dim not in turns:
                    turns[dim] = rotation(dim)
                x = rough[begin[at][:, None] + np.arange(dim)]
                codes, factor[at] = encode(unit(x), turns[dim])
                for k, row, c in zip(at, x, codes, strict=True):
                    node[k], code[k] = blake2b(f"{labels[k].as_py()}\0".encode() + row.tobytes(), digest_size=16).digest(), c.tobytes()
            dims = pa.array(end - begin, pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.array(node, pa.binary()), labels, dims, vectors, pa.array(code, pa.binary()), pa.array(factor)],
                                             ["vec_id", "node", "label", "dim", "vector", "code", "factor"])

    kind = vectors.schema[embedding].dataType.simpleString()
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("vector"), F.col(label).cast("string").alias("label"))
    return rows.mapInArrow(run, f"vec_id bigint, node binary, label string, dim int, vector {kind}, code binary, factor double")


def _centres(classes: DataFrame, cell: int, most: int) -> dict[tuple[str, int], np.ndarray]:
    """Centres of cells, members of the label themselves, for the largest of the labels with more than ``cell`` vectors: about one
    for each ``cell`` vectors, ``most`` in all. Chosen by the hash of their names, a bounded sample."""
    large = classes.groupBy("label", "dim").agg(F.count("*").alias("of")).where(F.col("of") > cell).orderBy(F.desc("of"), "label", "dim").limit(most // 2)
    large = large.collect()
    if not large:
        return {}
    total = sum(r["of"] for r in large)
    share = {(r["label"], r["dim"]): min(-(-r["of"] // cell), max(r["of"] * most // total, 2)) for r in large}
    known = classes.sparkSession.createDataFrame([(lab, dim, min(1.0, 2.0 * k / r["of"])) for ((lab, dim), k), r in zip(share.items(), large, strict=True)], "label string, dim int, odds double")
    picked = classes.join(F.broadcast(known), ["label", "dim"]).where(F.crc32("node") < F.col("odds") * float(1 << 32)).select("label", "dim", "node", "vector")
    found = defaultdict(list)
    for r in picked.collect():
        found[r["label"], r["dim"]].append((bytes(r["node"]), r["vector"]))
    return {key: unit(np.array([v for _, v in sorted(rows)[: share[key]]])) for key, rows in found.items() if len(rows) > 1}


def celled(classes: DataFrame, threshold: float, cell: int, most: int) -> DataFrame:
    """``classes`` once for each cell that they are compared in: with cell, own (whether they live there) and parted (whether
    their label has several cells). x, which lives in p, meets the vectors that live in q > p only if it is within the
    sine of the threshold's angle of the plane between p and q, since any y beyond the plane is as far from x as x is from it."""
    centres = _centres(classes, cell, most)
    reach = np.sqrt(1 - threshold**2) + SLACK
    if not centres:
        return classes.select("*", F.lit(0).alias("cell"), F.lit(True).alias("own"), F.lit(False).alias("parted"))
    given = classes.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {}
        for b in batches:
            keys = list(zip(b.column("label").to_pylist(), b.column("dim").to_pylist(), strict=True))
            by_key = defaultdict(list)
            for k, key in enumerate(keys):
                by_key[key].append(k)
            rows, cells, own, parted = [], [], [], []
            for key, at in by_key.items():
                at, c = np.array(at), given.value.get(key)
                if c is None:
                    home, go = np.zeros(len(at), np.int64), np.ones((len(at), 1), bool)
                else:
                    if key not in apart:
                        apart[key] = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
                    cos = unit(_matrix(b.column("vector").take(pa.array(at)))) @ c.T
                    home = cos.argmax(axis=1)
                    own_cos = cos[np.arange(len(at)), home]
                    go = (own_cos[:, None] - cos <= reach * apart[key][home]) & (np.arange(len(c)) > home[:, None])
                    go[np.arange(len(at)), home] = True
                i, q = np.nonzero(go)
                rows.append(at[i])
                cells.append(q)
                own.append(q == home[i])
                parted.append(np.full(len(i), c is not None))
            for lo in range(0, sum(map(len, rows)), 4096):
                pick = [np.concatenate(x)[lo : lo + 4096] for x in (rows, cells, own, parted)]
                out = b.take(pa.array(pick[0]))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(pick[1], pa.int32()), pa.array(pick[2]), pa.array(pick[3])], [*b.schema.names, "cell", "own", "parted"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{schema}, cell int, own boolean, parted boolean")


def blocks(rows: DataFrame, cell: int) -> DataFrame:
    """The rows of ``celled`` once for each block they belong to: kind 0 pairs lots (i, j) of the vectors that live in a cell,
    kind 1 lots of its visitors (i) and of them (j); side says which lot a row is of."""
    spark = rows.sparkSession
    key = ["label", "dim", "cell"]
    large = rows.groupBy(*key).agg(*(F.ceil(F.count_if(c) / cell).cast("int").alias(a) for c, a in ((F.col("own"), "homes"), (~F.col("own"), "guests"))))
    large = staged(large.where("homes > 1 or guests > 1"), "embedding-lots")
    small = large.count() * 64 <= BROADCAST  # beyond it a join by shuffle, whose hot keys AQE splits
    rows = rows.join(F.broadcast(large) if small else large, key, "left").withColumns({"homes": F.coalesce("homes", F.lit(1)), "guests": F.coalesce("guests", F.lit(1))})
    lot = F.pmod(F.xxhash64("node", F.lit("lot")), F.when(F.col("own"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    rows = rows.withColumn("lot", lot)
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    mine = F.col("lot")
    inner = F.transform(every("homes"), lambda o: block(0, F.least(mine, o), F.greatest(mine, o), (mine > o).cast("int")))
    hosts = F.transform(every("guests"), lambda k: block(1, k, mine, F.lit(1)))
    visits = F.transform(every("homes"), lambda o: block(1, mine, o, F.lit(0)))
    at = F.when(~F.col("own"), visits).when(F.col("parted"), F.concat(inner, hosts)).otherwise(inner)
    return rows.select("label", "dim", "cell", "node", "n", "vector", "code", "factor", F.explode(at).alias("at")).select("*", "at.*").drop("at")


def links(classes: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, most: int = CENTRES) -> DataFrame:
    """(u, v, n): with null v, u links to n vectors in some block; otherwise the edge (u, v) of a spanning forest of the links."""
    found = blocks(celled(classes, threshold, cell, most), cell)

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        node, side = block.column("node").to_pylist(), block.column("side").to_numpy()
        units = unit(_matrix(block.column("vector").combine_chunks()))
        turn, dim = rotation(units.shape[1]), units.shape[1]
        codes = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(len(node), -(-dim // 8))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if block.column("kind")[0].as_py() == 0 and block.column("i")[0] == block.column("j")[0]:
            right = left
        got = compare(units, codes, block.column("factor").to_numpy(), block.column("n").to_numpy(), left, right, threshold, turn)
        linked = np.flatnonzero(got.count)
        u = [node[k] for k in linked] + [node[i] for i, _ in got.edges]
        v = [None] * len(linked) + [node[j] for _, j in got.edges]
        return pa.table([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array([*got.count[linked].tolist(), *[0] * len(got.edges)], pa.int64())], ["u", "v", "n"])

    key = ["label", "dim", "cell", "kind", "i", "j"]
    # a fixed number of partitions, as blocks are small in bytes but not in work
    return found.repartition(parallelism(classes.sparkSession), *key).groupBy(*key).applyInArrow(run, "u binary, v binary, n bigint")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, cell: int = CELL, most: int = CENTRES) -> DataFrame:
    """Returns vec_id, n_links (other vectors linked directly), component_id (the smallest vec_id reachable) and kept, one row for
    each row of ``vectors``. Vectors of one label and length link from a cosine of ``threshold`` on; all such pairs are found.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with nothing.
    Rows that repeat a vector are vectors of their own, which link to each other. A row without an id counts as a vector; its
    component's id is null if nothing in it has one, and it is kept only then. Rows that share an id need not share a
    component. An empty table gives no rows; other columns play no part.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold: over 0 and under 1")
    rows = staged(coded(vectors, vec_id, embedding, label), "embedding-codes")
    first = lambda c: F.first(c).alias(c)
    classes = staged(rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), *map(first, ("label", "dim", "vector", "code", "factor"))), "embedding-classes")
    found = staged(links(classes, threshold, cell, most), "embedding-links")
    degree = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    joined = connected_components(found.where("v is not null").select("u", "v"))
    known = classes.select("node", "first_id", "n").join(degree, "node", "left").join(joined, "node", "left")
    known = staged(known.select("node", "first_id", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "embedding-known")
    least = known.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    lone = known.where("n_links = n - 1").select("node", "n", "n_links", F.col("first_id").alias("component_id"))
    many = known.where("n_links > n - 1").select("component", "node", "n", "n_links")
    decided = staged(lone.unionByName(join_groups(many, staged(least.where("members > 1"), "embedding-components"), "component", "members").select("node", "n", "n_links", "component_id")), "embedding-decided")
    compared = join_groups(rows.where("node is not null").select("vec_id", "node"), decided, "node", "n").select("vec_id", "n_links", "component_id")
    alone = rows.where("node is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return compared.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
