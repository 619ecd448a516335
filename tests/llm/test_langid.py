import math
import random
import zlib

import numpy as np

from plystream.llm import langid as li
from plystream.llm.common import table

SCHEMA = "doc_id long, text string, lang string, score string, held_out int"


def brute_phrases(text, sample):
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        n, at = n + 1, end if text[at : at + 1] in sample else at + 1
    return n


def test_phrases_against_substring_search(monkeypatch):
    rng = random.Random(0)
    make = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    samples = {"x": [make(300, "abc de")], "y": [make(200, "abcfg é")], "z": ["q"]}
    parser = li.Parser(samples)
    decode = lambda t: "".join(chr(c + 40) for c in parser.normalised(t).tolist())
    texts = [make(rng.randint(0, 400), "abc defgZé!?9 ") for _ in range(50)] + ["", "!!", "9 9"]
    got = parser.phrases([parser.normalised(t) for t in texts])
    for k, lang in enumerate(parser.langs):
        sample = decode(" ".join(samples[lang]))
        assert got[k].tolist() == [brute_phrases(decode(t), sample) for t in texts]
    monkeypatch.setattr(li, "SEGMENT", 7)
    cut = parser.phrases([parser.normalised(t) for t in texts])
    want = [[sum(brute_phrases(decode(t)[lo : lo + 7], decode(" ".join(samples[lang]))) for lo in range(0, len(decode(t)), 7)) for t in texts] for lang in parser.langs]
    assert cut.tolist() == want


def test_normalised():
    p = li.Parser({"x": ["abc"]})
    assert p.normalised("  A, b!!\n c ").tolist() == p.normalised("a b c").tolist()
    assert p.normalised("123 $%").tolist() == [] == p.normalised("").tolist()
    assert p.normalised("a z c").tolist() == [2, 0, 1, 0, 4]


def test_predictions_against_brute_force():
    """Fewest phrases win, ties go to the first in the alphabet; one price of a phrase for all samples, however unequal."""
    rng = random.Random(3)
    make = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(30):
        samples = {k: [make(rng.choice([1, 5, 40, 300, 900]), letters) for _ in range(rng.randint(1, 3))] for k, letters in zip("wxyz", ["abc de", "bcd ef", "aé漢字 ", "q"], strict=True)}
        parser = li.Parser(samples)
        plain = lambda t: tuple(parser.normalised(t).tolist())
        decode = lambda t: "".join(chr(c + 40) for c in plain(t))
        texts = [make(rng.randint(0, 500), rng.choice(["abc de", "bcdefé ", "漢字q ", "!9"])) for _ in range(20)]
        for t, (lang, score, rate) in zip(texts, parser.predict(texts), strict=True):
            cost = sorted((brute_phrases(decode(t), decode(" ".join(samples[k]))), k) for k in samples)
            if not decode(t):
                assert (lang, score) == ("und", 0.0)
                continue
            assert lang == cost[0][1] and abs(score - (1 - cost[0][0] / (cost[0][0] + cost[1][0]))) < 1e-12
            size = max(len(decode(" ".join(samples[k]))) for k in samples)
            letters = len({c.lower() for k in samples for x in samples[k] for c in x if c.isalpha()})
            want = cost[0][0] * math.log2(size + 2) / (len(decode(t)) + li.WIDE) / math.log2(letters)
            assert abs(rate - want) < 1e-12


def test_a_small_sample_wins_nothing():
    rng = random.Random(1)
    words = {"en": "the cat sat on mat and dog with of house tree was here".split(), "de": "der hund und die katze sind nicht hier auf dem haus mit baum".split()}
    make = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    samples = {k: [make(k, 400)] for k in words}
    for odd in ("e", "der", "123", "the cat sat on the mat"):
        parser = li.Parser(samples | {"xx": [odd]})
        for k in words:
            assert [x for x, *_ in parser.predict([make(k, 30) for _ in range(20)])] == [k] * 20


def test_writings_of_many_letters():
    """Letters of one writing are told apart, and a language in another writing is not taken for either."""
    rng = random.Random(5)
    a, b = ([chr(0x4E00 + i) for i in range(lo, lo + 900)] for lo in (0, 900))
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    words = {"zh": [make(a, 2) for _ in range(600)], "ja": [make(b, 2) for _ in range(600)], "ko": [make([chr(0xAC00 + i) for i in range(800)], 2) for _ in range(600)]}
    samples = {k: ["".join(rng.choice(w) for _ in range(3000))] for k, w in words.items()}
    parser = li.Parser(samples)
    assert parser.code.shape[1] == 2
    for k, w in words.items():
        got = parser.predict(["".join(rng.choice(w) for _ in range(150)) for _ in range(20)])
        assert {x for x, *_ in got} == {k} and max(r for *_, r in got) < 1
    assert parser.normalised(a[0]).tolist() != parser.normalised(a[5]).tolist()
    strange = parser.predict([make([chr(0x1200 + i) for i in range(200)], 300)])[0]
    assert strange[2] > 1


def test_what_no_language_explains_is_rejected(spark):
    rng = random.Random(9)
    words = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(40)] for k, letters in (("en", ["th", "e", "an", "ing", "s"]), ("de", ["sch", "ei", "n", "ung", "er"]))}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(200)), k) for i in range(60) for k in words]
    rows += [(1000, "".join(rng.choice("qxzjkvwbpyfg") for _ in range(2000)), "en"), (1001, "Ж" * 400, None), (1002, "short zzz", "en"), (1003, None, "en"), (1004, " ".join(rng.choice(words["de"]) for _ in range(99)), "en")]
    df = spark.createDataFrame([(i, t, k, "s", 0) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars int")
    learnt = li.sample(df.where("doc_id < 1000"))
    got = {(r.doc_id, r.text): r for r in li.identified(df, learnt).collect()}
    assert {i for i, _ in got} == {*range(60), 1002, 1004}
    assert all(r.lang == k for (i, t), r in got.items() for j, u, k in rows if (i, t) == (j, u) and i < 60) and got[rows[-1][:2]].lang == "de"


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = li.identify(docs, li.sample(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97, [(r.lang, r.lang_pred, r.text[:60]) for r in held if r.lang != r.lang_pred][:9]


def test_edge_cases(spark):
    text = {"en": "the cat sat on the mat and then the dog", "de": "der Hund und die Katze sind nicht hier"}
    rows = [(i, text["en" if i % 2 else "de"] + f" {i}", "en" if i % 2 else "de") for i in range(40)]
    rows += [(50, None, "en"), (51, "", "de"), (52, "123 !?", "en"), (53, "the dog", None), (None, "und der Hund", "de"), (54, "the mat " * 300_000, None), (53, "the dog", None)]
    df = spark.createDataFrame([(i, t, n, "s", 1) for i, t, n in rows], SCHEMA).repartition(3)
    got = {}
    for r in li.identify(df, li.sample(df)).collect():
        got.setdefault(r.doc_id, []).append((r.held_out, r.lang_pred))
    assert [got[i][0][1] for i in (50, 51, 52, 53, None, 54)] == ["und", "und", "und", "en", "de", "en"]
    assert len(got[53]) == 2 and got[None][0][0] is False
    assert all(p == ("en" if i % 2 else "de") for i in range(40) for _, p in got[i])
    empty = spark.createDataFrame([], SCHEMA)
    assert li.sample(empty) == {} and li.identify(empty, {}).collect() == []
    assert {r.lang_pred for r in li.identify(df, {}).collect()} == {"und"}


def test_labels_of_held_out_rows_play_no_part(spark):
    df = spark.createDataFrame([(i, "some text", "aa" if zlib.crc32(str(i).encode()) % 4 == 2 else "bb", None, None) for i in range(60)], SCHEMA)
    assert set(li.sample(df)) == {"bb"}


def test_three_hundred_labels(spark):
    """No label is left out, and their automata stay within bounds."""
    rng = random.Random(11)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 6))) for _ in range(30)] for k in range(300)}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(200)), k) for i, k in enumerate(list(words) * 4)]
    df = spark.createDataFrame([(i, t, k, "s", 1) for i, t, k in rows], SCHEMA)
    learnt = li.sample(df)
    assert len(learnt) >= 295 and sum(len(t) for texts in learnt.values() for t in texts) <= li.TOTAL  # some labels have held-out rows only
    parser = li.Parser(learnt)
    assert sum(t.nbytes for t in parser.tables) < 500 << 20
    some = [(k, " ".join(rng.choice(words[k]) for _ in range(60))) for k in sorted(learnt)[::10]]
    assert [x for x, *_ in parser.predict([t for _, t in some])] == [k for k, _ in some]
