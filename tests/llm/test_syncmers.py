import hashlib

import numpy as np
import pytest

from plystream.llm import syncmers as sy

SCHEMA = "doc_id long, text string, n_chars string, fingerprint int"


def closed(text, k=sy.K, s=sy.S):
    """Anchors from the definition, one k-mer at a time, with the module's hash of single s-mers."""
    pad = [sy._EDGE] * (k // 2)
    points = np.array(pad + [ord(c) for c in text] + pad, np.uint32)

    def smer(i):
        h = int(points[i])
        for c in points[i + 1 : i + s]:
            h = (h * int(sy._ODD) + int(c)) % 2**64
        return int(sy._mix(np.array([h], np.uint64))[0])
    hashes = [smer(i) for i in range(len(points) - s + 1)]
    return [i - k // 2 for i in range(len(points) - k + 1) if min(w := hashes[i : i + k - s + 1]) in (w[0], w[-1])]


def texts(n=40, seed=3):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeéß漢😀"), rng.integers(1, 8))) for _ in range(60)]
    return [" ".join(rng.choice(words, rng.integers(0, 120))) for _ in range(n)]


@pytest.mark.parametrize("text", ["a", "short", *texts(6)])
def test_anchors_follow_the_definition(text):
    if text:
        assert sy.anchors(text)[0].tolist() == closed(text)


def test_anchors_are_context_free():
    passage = texts(1, 9)[0] + " the same passage stands in two texts, at other places " * 3
    a = {(p, h) for p, h in zip(*map(np.ndarray.tolist, sy.anchors("x" * 50 + passage + "y" * 30)), strict=True) if 50 <= p <= 50 + len(passage) - sy.K}
    b = {(p + 40, h) for p, h in zip(*map(np.ndarray.tolist, sy.anchors("some ten c" + passage)), strict=True) if 10 <= p <= 10 + len(passage) - sy.K}
    assert a == b and len(a) > 20


def test_batches_and_blocks_change_nothing(monkeypatch):
    many = ["", "a", *texts(30)]
    whole = [sy.to_text(x) for x in sy.sketches(many)]
    assert whole == [sy.to_text(sy.sketches([t])[0]) for t in many]
    monkeypatch.setattr(sy, "BLOCK", 64)
    assert whole == [sy.to_text(x) for x in sy.sketches(many)]
    assert all(np.array_equal(x, sy.from_text(sy.to_text(x))) for x in sy.sketches(many))


def brute(rows):
    rows = sorted(((i if i is not None else -(2**63)), t or "") for i, t in rows)
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, e, b = (sy.sketches([x])[0] for x in (t, edited, nxt))
        out.append((i if i != -(2**63) else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), sy.to_text(a), sy.to_text(e), sy.likeness(a, e), sy.likeness(a, b)))
    return sorted(out, key=str)


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_query_against_brute_force(spark, buckets):
    rows = [(7 * i % 41, t) for i, t in enumerate(texts(41))] + [(100, None), (101, ""), (102, "x"), (103, "long " * 200_000), (5, "again"), (5, "again"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, sy.edited_fingerprints(df, buckets=buckets).collect()), key=str) == brute(rows)


def test_one_and_no_rows(spark):
    one = sy.edited_fingerprints(spark.createDataFrame([(4, "a lone document", None, None)], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert sy.edited_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    assert sy.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_likeness_follows_shared_text(spark):
    a = texts(1, 5)[0] * 4 + "".join(texts(20, 6))
    far, near = sy.sketches(["".join(texts(20, 7))])[0], sy.sketches([a[: len(a) * 9 // 10]])[0]
    one = sy.sketches([a])[0]
    assert sy.likeness(one, one) == 1 and sy.likeness(one, near) > 0.7 > 0.3 > sy.likeness(one, far)


def test_places_are_the_first_ones():
    for t in [*texts(8), "twice the same passage of text, " * 9]:
        at, h = sy.anchors(t)
        first = {}
        for p, x in zip(at.tolist(), h.tolist(), strict=True):
            first.setdefault(x, p)
        got = {x: p - sy.K // 2 for x, p in sy.sketches([t])[0].tolist()}
        assert got == {x: first[x] for x in sorted(first)[: sy.SKETCH]} or not first


def test_chain_by_trying_all():
    from itertools import combinations

    rng = np.random.default_rng(2)
    for _ in range(60):
        x = rng.permutation(9)[: rng.integers(0, 9)].tolist()
        assert sy.chain(x) == max(k for k in range(len(x) + 1) if any(list(c) == sorted(c) for c in combinations(x, k)))


def test_matches_stand_in_order():
    """The same passages in another order are the same anchors, of which only those of one passage can be matched."""
    a, b = "".join(texts(6, 20)), "".join(texts(6, 21))
    one, other = sy.sketches([a + b])[0], sy.sketches([b + a])[0]
    shared = len(np.intersect1d(one["hash"], other["hash"])) / len(np.union1d(one["hash"], other["hash"]))
    assert shared > 0.9 and 0.3 < sy.likeness(one, other) < 0.7 and sy.likeness(one, other) == sy.likeness(other, one)
