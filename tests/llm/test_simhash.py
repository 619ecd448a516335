import random
import re

import numpy as np
import pytest
import xxhash

from plystream.llm import simhash as sh
from plystream.llm.components import connected_components

SCHEMA = "doc_id long, text string, fingerprint int, component_id string"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64)) if hashes else 0


def components(rows):
    fps = [plain(t) for _, t in rows]
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fps[a] ^ fps[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, label, strict=True))


def corpus():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)] + ["Ä", "É", "ABC", "x\x1cy", "z q"]
    base = [" ".join(rng.choice(words, 150)) for _ in range(12)]
    out = [t + " " + " ".join(rng.choice(words, k)) for t in base for k in (0, 1, 2, 3, 4)]
    return [(i * 3 % 61, t) for i, t in enumerate(out)] + [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "One"), (105, "a b"), (106, "a\x0b b"), (107, out[0]), (108, out[0])]


def test_query_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(4)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in sh.near_duplicates(df).collect())
    assert got == components(rows)
    assert len({c for _, _, c in got}) < len(got) - 8


@pytest.mark.parametrize("block", [1, 7, 50, 1 << 20])
def test_blocks_change_nothing(block):
    for _, t in corpus()[:20]:
        h = np.concatenate(list(sh.shingle_hashes(t, 3, block)) or [np.zeros(0, np.uint64)])
        assert np.array_equal(h, np.concatenate(list(sh.shingle_hashes(t))))


@pytest.mark.parametrize("n", [5, 64, 65, 900])
def test_forest_joins_what_pairs_join(n):
    rng = np.random.default_rng(n)
    low = np.unique(rng.integers(0, 1 << 16, n).astype(np.uint64))
    fps = low << np.uint64(24) | np.uint64(7 << 56)
    def classes(edges):
        at = list(range(len(fps)))
        for i, j in list(edges) * 1:
            a, b = at[i], at[j]
            at = [min(a, b) if x in (a, b) else x for x in at]
        return at
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 2]
    edges = sh._forest(fps, 2)
    assert classes(edges) == classes(pairs) and len(edges) < len(fps)


def test_edge_cases(spark):
    assert sh.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c"), (3, "a b c"), (2, "x y z"), (2, "x y z")]
    got = sh.near_duplicates(spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 3), (2, 2), (2, 2), (3, 3)]
    assert sh.one_of_each(spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)).count() == 3


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).selectExpr("id as u", "id + 1 as v").unionAll(spark.sql("select 1000L as u, 1000L as v"))
    got = dict(map(tuple, connected_components(edges).collect()))
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000}


def test_lists_are_the_guaranteed_minimum():
    """Two fingerprints meet in the list of some 6 positions exactly if they share 6 positional bytes or more, as all within two
    bits do; a tally over the lists of single bytes counts the same."""
    from itertools import combinations

    rng = random.Random(6)
    masks = [sum(0xFF << 8 * i for i in kept) for kept in combinations(range(8), 6)]
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randint(0, 4)):
            b ^= 1 << rng.randrange(64)
        tally = sum((a >> 8 * i & 0xFF) == (b >> 8 * i & 0xFF) for i in range(8))
        assert any(a & m == b & m for m in masks) == (tally >= 6)
        assert (a ^ b).bit_count() > 2 or tally >= 6
