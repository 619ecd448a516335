import numpy as np
import pytest

from plystream.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n int"


def clustered(seed=0, dim=16, groups=12, each=9):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        for k in range(each):
            x = centre + rng.standard_normal(dim) * (0.02 + 0.03 * (k % 4))
            out.append((len(out), [float(np.float32(v)) for v in x * (1 + k)], g % 3))
    return out


def odd():
    x = [1.0, 2.0, 3.0]
    return [(900, None, 1), (901, [], 1), (902, [0.0] * 3, 1), (903, [1.0, None, 2.0], 1), (904, [float("nan"), 1.0, 1.0], 1), (905, [float("inf"), 1.0, 1.0], 1),
            (906, x, None), (907, x, None), (910, x, 1), (911, x, 1), (912, [2.0, 4.0, 6.0], 1), (912, [2.0, 4.0, 6.0], 1), (913, x, 2), (914, [1.0, 2.0], 1), (915, [1e-30, 2e-30, 3e-30], 1),
            (None, [9.0, -9.0, 0.0], 1), (None, x, 2), (916, [1e30, -1e30, 0.0], 7), (916, [-1e30, 1e30, 0.0], 7)]


def plain(rows, threshold=0.93):
    def fine(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if i != j and la is not None and la == lb and fine(a) and fine(b) and len(a) == len(b):
                a, b = np.float32(a).astype(float), np.float32(b).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    near[i].append(j)
    least = [r[0] for r in rows]
    small = lambda a, b: b if a is None else a if b is None else min(a, b)
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in near[i]:
                if small(least[i], least[j]) != least[i]:
                    least[i], changed = least[j], True
    return sorted(((r[0], len(near[i]), least[i], r[0] == least[i]) for i, r in enumerate(rows)), key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in ed.near_duplicates(df, **how).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"cell": 10}, {"cell": 7, "most": 4}, {"cell": 5, "most": 0}])
def test_against_brute_force(spark, how):
    """In one block each, in cells around centres, in lots of large cells, and in lots without centres."""
    rows = clustered() + odd()
    assert run(spark, rows, **how) == plain(rows)


def test_empty(spark):
    assert run(spark, []) == [] and len(run(spark, odd()[:4])) == 4


def test_estimates_are_unbiased():
    rng = np.random.default_rng(3)
    x, y = ed.unit(rng.standard_normal((2, 64)))
    got = []
    for seed in range(3000):
        turn = ed.rotation(64, seed)
        got.append(ed.estimates(y[None], turn, *ed.encode(x[None], turn))[0, 0])
    assert abs(np.mean(got) - x @ y) < 4 * np.std(got) / np.sqrt(len(got)) < 0.02


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.93, 0.999])
def test_bounds_lose_no_pair(threshold):
    rng = np.random.default_rng(4)
    x = ed.unit(rng.standard_normal((400, 32)))
    y = ed.unit(x[rng.integers(0, 400, 400)] + rng.standard_normal((400, 32)) * rng.uniform(0, 0.3, (400, 1)))
    turn = ed.rotation(32)
    codes, factors = ed.encode(x, turn)
    shown, (low, high) = ed.estimates(y, turn, codes, factors), ed.bounds(factors, threshold)
    linked = y @ x.T >= threshold
    assert linked.any() and ((shown >= low) & (shown <= high))[linked].all()
    if threshold >= 0.8:
        assert ((shown >= low) & (shown <= high))[~linked].mean() < 0.3  # most others are never computed


def test_forest_joins_what_links_join():
    rng = np.random.default_rng(5)
    links = ed.Links(300)
    i = rng.integers(0, 300, 280)
    j = (i + rng.integers(1, 300, 280)) % 300
    for lo in range(0, 280, 50):
        links.add(i[lo : lo + 50], j[lo : lo + 50], np.ones(300, np.int64))
    at = np.arange(300)
    for a, b in zip(i, j, strict=True):
        at[at == at[max(a, b)]] = at[min(a, b)]
    assert len(links.edges) == 300 - len(set(at.tolist()))
    assert all(at[a] == at[b] for a, b in links.edges) and links.count.sum() == 560


def test_a_block_never_emits_all_pairs(spark):
    """A group of near copies gives as many edges as vectors, not as pairs."""
    rng = np.random.default_rng(6)
    rows = [(k, [float(v) for v in np.ones(8) + rng.standard_normal(8) * 0.01], 1) for k in range(500)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    coded = ed.coded(df, "vec_id", "embedding", "label").selectExpr("node", "vec_id as first_id", "1L as n", "label", "dim", "vector", "code", "factor")
    found = ed.links(coded)
    assert found.where("v is not null").count() == 499 and found.where("v is null and n = 499").count() == 500
