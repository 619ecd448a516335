import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from plystream.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids int, n_tokens string"


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def corpus():
    rng = random.Random(4)
    pools = ["abc de'", "aa ", "\x1c\x1f\x85\xa0 　​ x", "é漢字😀ß 12", "  \n\t.", "'s't're'LL ", "́ë "]
    out = ["", " ", "a", "hello world", "  two  spaces ", "don't we'll I'm", "x" * 3000, "ab" * 700 + " " + "1" * 500, "\n\n \n a\n"]
    return out + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for pool in pools for _ in range(40)] + [
        "".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x300, 0xD7FF)])) for _ in range(50)) for _ in range(40)]


def test_against_the_library(spark, reference):
    rows = [(i, t) for i, t in enumerate(corpus())] + [(9000, None), (3, "hello world"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(4)
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in bpe.digests(df, PATH, P.PATTERN).collect())
    encoded = bpe.encode(df, PATH, P.PATTERN)
    assert sorted(str((r.doc_id, r.ids)) for r in encoded.collect()) == sorted(str((i, reference.encode_ordinary(t or ""))) for i, t in rows)
    assert sorted(str((r.doc_id, bytes(r.bytes))) for r in bpe.decode(encoded, PATH, P.PATTERN).collect()) == sorted(str((i, (t or "").encode())) for i, t in rows)


def test_merges_of_lower_rank_come_up_late():
    """'abc' has a lower rank than 'ab': once one 'ab' is merged, 'abc' goes before the next 'ab'."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 301, b"ca": 299, b"ab": 305, b"abcab": 303}
    lib = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    assert bpe.Table(ranks).encode([w.encode() for w in words]) == [lib.encode_ordinary(w) for w in words]


def test_memory_is_bounded(monkeypatch, reference):
    monkeypatch.setattr(bpe, "WORDS", 20)
    e = bpe.Encoder(PATH, P.PATTERN)
    for t in corpus():
        found = e.look_up([e.cut(t)])[0]
        assert "".join(x for x, _ in found) == "".join(f"{i}," for i in reference.encode_ordinary(t)) and len(e.known) <= 60


def test_no_rows(spark):
    assert bpe.digests(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).collect() == []


def test_narrow_pattern():
    e = bpe.Encoder(PATH, P.PATTERN)
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(chr(rng.choice([rng.randint(0, 255), 32, 39, 115, 10])) for _ in range(60))
        assert e.narrow.findall(t) == e.pattern.findall(t)
