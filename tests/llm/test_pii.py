import hashlib
import math
import random
import re
from decimal import Decimal

import pytest

from plystream.llm import pii

SCHEMA = "doc_id long, text string, n_chars long, spans string, n_email int"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP, CARD, PHONE = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(Decimal(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def texts():
    rng = random.Random(8)
    out = ["", "a@b.c", "a@b", "x@y.z@w.v.", "a@b.c%d@e.f", "@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 9", "+1 (323) 555-9830", "+1..........5", "++12 345 678 90 12",
           "4242424242424242", "1" * 400 + ".1.1.1", "call 0" + "0" * 5000 + ".1.1.1 now", "1" * 5000 + ".1.1.1", "0" * 5000 + "9.255.1.0" + "0" * 5000, "a" * 5000 + "@x.y", "é@b.co", "a@bé.co", "+1 555 000 1111@x.y 10.0.0.1", "٣.1.1.1", "1.1.1.1٣"]
    for alphabet in ("a@.b-1 ", "12. +-()", "4121 -", "+1 9(5)-.", "0123456789.@+ x"):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    return out


def test_spans_against_the_patterns():
    for t in texts():
        assert pii.written(pii.base_spans(t)) == brute(t), t


def test_query(spark):
    rows = [(i, t) for i, t in enumerate(texts()[:200])] + [(900, None), (3, "x@y.z"), (3, "x@y.z"), (None, "q@w.e")]
    df = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], SCHEMA).repartition(4)
    got = pii.find(df).collect()
    want = sorted((str(i), hashlib.sha256(brute(t or "").encode()).hexdigest(), brute(t or "")) for i, t in rows)
    base = lambda s: ",".join(x for x in s.split(",") if not x.startswith("term:"))
    assert sorted((str(r.doc_id), r.base_sha256, base(r.spans)) for r in got) == want
    assert sum(r.n_email for r in got) == sum(len(EMAIL.findall(t or "")) for _, t in rows)
    assert pii.find(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_terms(rows, least=pii.GENERALISE):
    """{(doc_id, text): [(start, end, disclosure)]} by the definition, over distinct documents, one pair at a time."""
    docs = sorted({(i, t or "") for i, t in rows}, key=str)
    word = re.compile(r"[^\W\d_]{3,}")
    spans = {d: pii.base_spans(d[1]) for d in docs}
    have, contexts, both, near = {}, {}, {}, {}
    for d in docs:
        for w in {m[0].lower() for m in word.finditer(d[1])}:
            have[w] = have.get(w, 0) + 1
        words = [(m.start(), m.end(), m[0].lower()) for m in word.finditer(d[1])]
        for a, b, kind, value in spans[d]:
            left, right = [w for w in words if w[1] <= a], [w for w in words if w[0] >= b]
            side = (left[-1][2] if left else "", right[0][2] if right else "")
            for x, y, w in [(0, 0, ""), *left[-pii.NEAR :], *right[: pii.NEAR]]:
                if w and any(x < q and p < y for p, q, *_ in spans[d]):
                    continue
                key = (kind, value), w
                contexts.setdefault(key, set()).add(side)
                both.setdefault(key, set()).add(d)
                near.setdefault(d, set()).add(key)
    out = {}
    for d in docs:
        shown = {}
        for e, w in near.get(d, ()):
            n_e, n = len(both[e, ""]), len(docs)
            if w and n_e < n:
                c = len(contexts[e, w])
                x = math.log(n * len(both[e, w]) / (n_e * have[w])) / math.log(n / n_e) * c / (c + 1)
                if x >= least - 1e-12:
                    shown[w] = max(shown.get(w, 0), x)
        out[d] = [(m.start(), m.end(), shown[m[0].lower()]) for m in word.finditer(d[1])
                  if m[0].lower() in shown and not any(m.start() < q and p < m.end() for p, q, *_ in spans[d])]
    return out


def random_corpus(rng):
    """Few words and entities in short texts; repeated rows, one id with two texts, an entity in every row, a long text."""
    words = ["alpha", "Bravo", "carol", "delta", "echo", "fox", "golf", "hotel", "india", "été", "ab"]
    some = [f"u{k}@x.org" for k in range(4)] + ["10.0.0.1", "+49 30 1234567", "4111 1111 1111 1111"]
    always = rng.random() < 0.5
    rows = []
    for i in range(rng.randint(1, 14)):
        said = [rng.choice(words + some[: rng.randint(1, 7)]) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.2:
            said.append(f"solo{rng.choice('abc')}word")
        rows.append((i // 2 if rng.random() < 0.1 else i, " ".join([*said, *["all@all.net"] * always])))
    rows += [rng.choice(rows) for _ in range(rng.randint(0, 6))]
    if rng.random() < 0.3:
        rows.append((77, " ".join(f"mail u{k % 4}@x.org or p{k}@q.org golf" for k in range(100))))
    return rows + [(None, None)] * rng.randint(0, 2)


@pytest.mark.parametrize("seed", range(8))
def test_terms_against_brute_force(spark, seed):
    rows = random_corpus(random.Random(seed))
    got = pii.find(spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], SCHEMA).repartition(3)).collect()
    want = brute_terms(rows)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.base_sha256), []).append([(x.start, x.end) for x in r.terms])
    for (i, t), terms in want.items():
        found = by[i, hashlib.sha256(brute(t).encode()).hexdigest()]
        assert [(a, b) for a, b, _ in terms] in found, (i, t)
    shown = sorted(round(x.disclosure, 9) for r in {(r.doc_id, r.text_hash): r for r in got}.values() for x in r.terms)
    assert shown == sorted(round(d, 9) for terms in want.values() for *_, d in terms)


def test_an_entity_in_every_document_discloses_nothing(spark):
    rows = [(i, f"{w} x@y.z {w} corp") for i, w in enumerate("alpha bravo carol delta echo fox golf hotel".split())]
    df = spark.createDataFrame([(i, t, len(t), "s", 2) for i, t in rows], SCHEMA)
    assert all(r.terms == [] and r.n_email == 1 for r in pii.find(df).collect())
    assert {r.text for r in pii.sanitised(df).collect()} == {t.replace("x@y.z", "<EMAIL>") for _, t in rows}


def test_disclosing_terms(spark):
    """'zorblax' stands by one address only, in different contexts; 'common' stands everywhere; copies are no evidence."""
    rng = random.Random(2)
    filler = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(6))
    shared = filler()
    rows = [(i, f"common {shared} {filler()}") for i in range(60)]
    rows += [(100 + i, f"Zorblax began common {shared} zorblax {'qrstuv'[i] * 3} boss@corp.com {shared} {shared} zorblax") for i in range(6)]
    rows += [(200 + i, "common lonely words xenon other@corp.com nearby text") for i in range(5)]
    df = spark.createDataFrame([(i, t, len(t), "s", 2) for i, t in rows * 2], SCHEMA)
    got = {r.doc_id: r for r in pii.find(df).collect()}
    for i, t in rows:
        terms = [t[x.start : x.end].lower() for x in got[i].terms]
        if 100 <= i < 106:  # wherever it stands in the document; a word seen only there counts half, and is generalised too
            assert terms.count("zorblax") == 3 and "common" not in terms and shared.split()[0] not in terms
        else:  # copies are one context, and words of theirs disclose half
            assert terms == ([] if i < 100 else ["lonely", "words", "xenon", "nearby", "text"]), (t, terms)
    r, t = got[100], dict(rows)[100]
    z = t.index("zorblax")
    assert f"term:{z}:{z + 7}" in r.spans and "email:" in r.spans
    assert max(x.disclosure for x in r.terms) == pytest.approx(6 / 7)
    clean = {x.doc_id: x for x in pii.sanitised(df, n_chars="n_chars").collect()}
    assert "<EMAIL>" in clean[200].text and "corp.com" not in clean[200].text and clean[200].n_chars == len(clean[200].text)
    assert clean[3].text == dict(rows)[3] and "zorblax" not in clean[100].text.lower()
    assert pii.sanitised(df).count() == len(rows) * 2


def test_sanitise_text():
    t = "call +1 (323) 555-9830 or mail a@b.cd now zed"
    assert pii.sanitise_text(t, [(42, 45, 0.6)]) == "call <PHONE> or mail <EMAIL> now <TERM>"
    assert pii.sanitise_text(t, [(42, 45, 0.95)]) == "call <PHONE> or mail <EMAIL> now "


@pytest.mark.parametrize("n", [3, 64, 65, 300])
def test_no_term_overlaps_an_entity(n):
    text = " ".join(f"mail john.doe{k}@mail{k}.example.org or call +49 30 1234{k:04d} today" for k in range(n))
    spans = pii.base_spans(text)
    near, at = pii.contexts(text, spans)
    assert {t for _, _, t in near if t} == {t for t, _, _ in at} == {"mail", "call", "today"}
    assert len(at) == 3 * n and all(not any(a < y and x < b for x, y, *_ in spans) for _, a, b in at)


def test_terms_are_whole_words():
    text = f"{'a' * 300} x@y.org {'b' * 300} more"
    assert [t for t, _, _ in pii.contexts(text, pii.base_spans(text))[1]] == ["a" * 300, "b" * 300, "more"]
