from hashlib import sha256
from math import floor, isfinite

import numpy as np
import pytest

from plystream.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>, cluster string, x int"


def plain(rows, dim, k=8, rounds=10, scale=1024):
    kept = [(i, [floor(scale * float(np.float32(e))) for e in v]) for i, v in rows if v is not None and len(v) == dim and all(e is not None and isfinite(e) and abs(e) * scale < ce.LARGEST for e in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [x for _, x in order[:k]]
    away = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    nearest = lambda x: min(range(len(c)), key=lambda j: (away(x, c[j]), j))
    for _ in range(rounds):
        at = [nearest(x) for _, x in kept]
        for j in range(len(c)):
            mine = [x for (_, x), a in zip(kept, at, strict=True) if a == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = [(i, nearest(x), away(x, c[nearest(x)])) for i, x in kept]
    total = [sum(d for _, j, d in found if j == n) for n in range(len(c))]
    return sorted(((i, j, d, total[j], sum(total), sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found), key=str)


def corpus(n, dim, seed=0, grid=None):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * rng.uniform(0.1, 2, (n, 1)) + rng.integers(0, 5, (n, 1))
    x = np.round(x * grid) / grid if grid else x
    return [(int(i), [float(e) for e in v.astype(np.float32)]) for i, v in enumerate(x)]


def odd(dim):
    return [(900, None), (901, []), (902, [1.0] * (dim - 1)), (903, [1.0] * (dim - 1) + [None]), (904, [float("nan")] * dim), (905, [float("-inf")] * dim), (906, [3e38] * dim),
            (None, [0.5] * dim), (None, [0.25] * dim), (907, [1.0] * dim), (907, [2.0] * dim), (907, [2.0] * dim), (908, [-0.0] * dim), (909, [1e-30] * dim), (910, [-1e-30] * dim)]


def run(spark, rows, dim, **how):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in ce.clusters(df, dim=dim, **how).collect()), key=str)


@pytest.mark.parametrize(("n", "dim", "grid"), [(300, 6, None), (200, 3, 2), (5, 4, None)])
def test_against_brute_force(spark, n, dim, grid):
    """Also where many distances tie, and with fewer vectors than centroids."""
    rows = corpus(n, dim, grid=grid) + (odd(dim) if n > 5 else [])
    assert run(spark, rows, dim) == plain(rows, dim)


@pytest.mark.parametrize(("k", "bounds"), [(1, 4), (2, 1), (12, 3)])
def test_other_numbers_of_centroids_and_bounds(spark, k, bounds):
    rows = corpus(150, 4, seed=2)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    found, c = ce.clustered(ce.prepared(df, dim=4), k=k, rounds=4, bounds=bounds)
    assert sorted(tuple(r) for r in found.collect()) == sorted((r[0], r[1], r[2]) for r in plain(rows, 4, k=k, rounds=4)) and len(c) == k


def test_empty(spark):
    assert run(spark, [], 4) == [] and run(spark, odd(4)[:7], 4) == []


def test_bounds_hold_and_save_distances(monkeypatch):
    """Through rounds of moving centroids clusters stay exact, bounds stay bounds, and far fewer distances are computed than a scan."""
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((4000, 16)) * 200 + rng.integers(0, 8, (4000, 1)) * 500).astype(np.int64)
    c, computed = x[:8].copy(), []
    real = ce.squared
    monkeypatch.setattr(ce, "squared", lambda a, b: (computed.append(len(a)), real(a, b))[1])
    now, scanned = ce.Bounds.scanned(x, c, 3), 0
    for _ in range(12):
        true = np.stack([real(x, one) for one in c], axis=1)
        assert np.array_equal(now.cluster, true.argmin(axis=1))
        assert (now.upper >= np.sqrt(true.min(axis=1))).all()
        assert (now.low[:, :3] <= np.sqrt(np.take_along_axis(true, now.near, axis=1))).all()
        rest = np.array([[j not in (a, *near) for j in range(8)] for a, near in zip(now.cluster, now.near, strict=True)])
        assert (now.low[:, 3] <= np.sqrt(np.where(rest, true, 1 << 60).min(axis=1))).all()
        after = np.stack([x[now.cluster == j].sum(axis=0) // max((now.cluster == j).sum(), 1) for j in range(8)])
        computed.clear()
        now.moved(np.sqrt(real(after, c)) * ce.UP)
        now.settle(x, after)
        c, scanned = after, scanned + 1
    assert sum(computed) < 8 * len(x) / 3  # the last round


def test_narrowed_bounds_still_hold():
    rng = np.random.default_rng(2)
    x = rng.integers(-500, 500, (500, 5))
    c = x[:7].copy()
    now = ce.Bounds.scanned(x, c, 4)
    now.narrowed(2)
    after = c + rng.integers(-60, 60, c.shape)
    now.moved(np.sqrt(ce.squared(after, c)) * ce.UP)
    now.settle(x, after)
    assert np.array_equal(now.cluster, np.stack([ce.squared(x, one) for one in after], axis=1).argmin(axis=1))
