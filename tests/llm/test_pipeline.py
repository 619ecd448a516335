import re
import zlib

import pytest

import corpus_pipeline
from plystream.llm import langid, packing, pii, simhash
from test_pii import brute_terms


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_run_against_brute_force(spark, sf):
    """By plain Python, with the definitions that the operators' own tests hold them against."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    parser = langid.Parser(langid.sample(docs))
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if t is not None and any(c.isalpha() for c in t) and parser.predict([t])[0][2] < langid.MOST}
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t)
    first = {}
    for i in sorted(rows):
        first.setdefault(norm(rows[i]), i)
    rows = {i: rows[i] for i in first.values()}
    fp = {i: simhash.simhash(t) for i, t in rows.items()}
    label = {i: i for i in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if label[b] < label[a] and (fp[a] ^ fp[b]).bit_count() <= 2:
                    label[a], changed = label[b], True
    rows = {i: t for i, t in rows.items() if label[i] == i}
    terms = brute_terms([*rows.items()])
    assert any(terms.values())
    rows = {i: pii.sanitise_text(t, terms[i, t]) for i, t in rows.items()}
    words = packing.Words(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in rows.items():
        data = words.ids([t])[0] + bytes(4)
        want |= {(i, k, lo // 4, len(x := data[lo : lo + 8192]) // 4, zlib.crc32(x)) for k, lo in enumerate(range(0, len(data), 8192))}
    got = corpus_pipeline.run(spark, f"/root/testdata/{sf}").collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in at.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and x[-1][0] + x[-1][1] <= 2048


def test_language_keeps_clean_documents(spark):
    df = spark.createDataFrame([(1, "words in here", "en", "s", 13), (2, None, "en", "s", 0), (3, "123 ...", "en", "s", 7), (4, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in langid.identified(df, langid.sample(df)).collect()] == [1]
    assert corpus_pipeline.language(spark, df.limit(0), "").collect() == []


def test_no_label_rejects_no_text(spark):
    df = spark.createDataFrame([(1, "words in here", None), (2, None, None), (3, "123 ...", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.identified(df, langid.sample(df)).collect()] == [1]


def test_documents_without_an_id_stay(spark):
    text = lambda a: " ".join(f"{a}{i * i}" for i in range(60))
    rows = [(1, text("a")), (2, text("a")), (None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (7, text("d"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.one_of_each(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([rows[0], rows[3], rows[5], rows[6]], df.schema).collect()))
    named = df.where("doc_id is not null")
    assert sorted(r.doc_id for r in simhash.one_of_each(named).collect()) == [1, 7]


def test_odd_tables(spark, tmp_path):
    """Extra columns with the names of the operators' own, repeated rows, nulls, a very long text; and no rows."""
    prose = lambda k, n: " ".join(f"w{chr(97 + i * k % 23)}{chr(97 + i * i % 19)}" for i in range(n))
    rows = [(i, prose(i + 1, 60), "en") for i in range(20)] + [(3, prose(4, 60), "en")] * 3 + [(40, None, None), (41, "", "en"), (None, prose(50, 70), None), (42, prose(43, 60_000), "en")]
    df = spark.createDataFrame([(i, t, k, "s", len(t or ""), "x", "y", 1.0, 2) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string, fingerprint string, score double, sequence_id int")
    for name, d in (("odd", df), ("none", df.limit(0))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, f"{tmp_path}/{name}")
            assert docs.columns == df.columns
        kept = sorted(str(r.doc_id) for r in docs.collect())
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert sorted({str(r.doc_id) for r in got}) == sorted(set(kept))
        if name == "none":
            assert got == []
        else:
            assert "None" in kept and "42" in kept and "40" not in kept and kept.count("3") == 1 and max(r.piece for r in got if r.doc_id == 42) > 20
