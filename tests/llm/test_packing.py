import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from plystream.llm import packing as pk

PATH = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, sequence_id string, offset string, length string"


def brute(rows, capacity=pk.CAPACITY):
    t = Tokenizer.from_file(PATH)
    out = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(i, k, lo, len(x := ids[lo : lo + capacity]), zlib.crc32(x.tobytes())) for k, lo in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=str)


def best_fit_decreasing(lengths, capacity=pk.CAPACITY):
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        k = bisect_left(gaps, n)
        insort(gaps, (gaps.pop(k) if k < len(gaps) else capacity) - n)
    return len(gaps)


def check(rows, capacity=pk.CAPACITY):
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in at.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(n for _, n in x) <= capacity
    return len(at)


def test_query_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = ["The", "quick", "BROWN", "naïve", "étude", "fox-trot", "end.", "Naïve,", "a%%%", "l'", "it's.", "x's'", "b_c_.", "1.", "é&&&", "<a>", "ab<|endoftext|>.", "ê$*,", "12,5", "don't", "<|endoftext|>", "x<|startoftext|>y", "漢字", " ", "a\tb", "Σίσυφος", "ﬁ"]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60, 400, 3000])))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "same"), (103, "same"), (102, "same"), (None, "no id"), (104, "x" * 6000)]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(5)
    got = pk.packed(df, PATH).collect()
    assert sorted((tuple(r[:5]) for r in got), key=str) == brute(rows)
    n = check(got)
    assert n <= best_fit_decreasing([r.length for r in got])
    monkeypatch.setattr(pk, "LOTS", 64)  # many lots for a length
    assert check(pk.pack(pk.pieces(df, PATH)).collect()) == n
    assert pk.packed(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_parts_and_forgetting(monkeypatch):
    w = pk.Words(PATH)
    text = " ".join(f"word{i} \n{'y' * (i % 90)}" for i in range(3000))
    whole = w.ids([text])[0]
    monkeypatch.setattr(pk, "BLOCK", 500)
    monkeypatch.setattr(pk, "WORDS", 50)
    small = pk.Words(PATH)
    assert b"".join(small.ids([p])[0] for p in pk._parts(text)) == whole and "".join(pk._parts(text)) == text and len(small.known) <= 60


@pytest.mark.parametrize("groups", [1, 7, 64, 2048])
@pytest.mark.parametrize("seed", range(6))
def test_plans(seed, groups):
    rng = random.Random(seed)
    shapes = [lambda: rng.randint(1, 2048), lambda: rng.choice([2048, 700, 1, 300]), lambda: rng.randint(1, 200), lambda: rng.randint(1025, 2048),
              lambda: min(2048, int(rng.expovariate(1 / 500)) + 1), lambda: rng.choice([683, 682, 1365])]
    counts = {}
    for _ in range(20_000):
        counts[n] = counts.get(n := shapes[seed](), 0) + 1
    slots, sequences = pk.plan(counts, groups=groups)
    assert all(n <= sum(c for k, c in counts.items()) for n in slots[:, 2])
    seen = {}
    used = {}
    for length, rank, n, first, offset in slots.tolist():
        assert rank == seen.get(length, 0)  # ranks are covered once
        seen[length] = rank + n
        for s in range(first, first + n):
            used.setdefault(s, []).append((offset, length))
    assert seen == counts and len(used) == sequences
    for x in used.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and x[-1][0] + x[-1][1] <= 2048
    if groups == 2048:
        assert sequences <= best_fit_decreasing([k for k, c in counts.items() for _ in range(c)]) * 1.002 + 1


def test_words_of_narrow_texts():
    rng = random.Random(5)
    t = Tokenizer.from_file(PATH)
    w = pk.Words(PATH)
    texts = ["".join(chr(rng.choice([rng.randint(1, 255), rng.randint(65, 122), 32, 39, 115, 84, 10])) for _ in range(70)) for _ in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in w.ids(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
