import hashlib
import re

import pytest
from pyspark.sql import functions as F

from plystream.llm import common
from plystream.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, digest string, keep_id string, kept int"


def rows():
    texts = ["a b", "a  b", "a\t\nb", " a b", "a b ", "", None, "x\xa0y", "x y", "A b", "long " * 50_000, "long\n" * 50_000]
    return [(i * 5 % 13, t) for i, t in enumerate(texts)] + [(100 + i, "hot") for i in range(300)] + [(7, "again"), (7, "again"), (None, "null id"), (None, "hot")]


def brute(found):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    out = []
    for i, t in found:
        same = [j for j, u in found if norm(u) == norm(t)]
        keep = min((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(map(str, out))


def frame(spark, found):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in found], SCHEMA).repartition(4)


def test_query_against_brute_force(spark):
    assert sorted(str(tuple(r)) for r in ed.deduplicated(frame(spark, rows())).collect()) == brute(rows())
    assert ed.deduplicated(frame(spark, [])).collect() == []


def test_distinct_documents(spark):
    got = ed.distinct_documents(frame(spark, rows()))
    assert got.columns == ["doc_id", "text", "digest", "keep_id", "kept"]
    want = {b for b in brute(rows()) if ", True," in b}
    assert got.count() == len(want)
    unique = ed.distinct_documents(frame(spark, [r for r in rows() if r[0] not in (7, None)]))
    assert len({r.doc_id for r in unique.collect()}) == unique.count()


def test_index_persists(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = ed.DigestIndex(spark, "persistent_digests", path, 4)
    assert all(r.kept for r in first.add(frame(spark, [(1, "one"), (2, "two")])).collect())
    spark.sql("DROP TABLE persistent_digests")  # the files stay, as for another session
    again = ed.DigestIndex(spark, "persistent_digests", path, 4)
    got = {r.doc_id: (r.keep_id, r.kept) for r in again.add(frame(spark, [(0, "two"), (5, " two"), (3, "three"), (4, "three")])).collect()}
    assert got == {0: (2, False), 5: (5, True), 3: (3, True), 4: (3, False)}
    assert sorted(r.keep_id for r in again.table().collect()) == [1, 2, 3, 5]
    plan = frame(spark, [(9, "nine")]).select(ed.digest().alias("digest")).join(again.table().hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Bucketed: true" in text
    again.drop()


def test_two_batches_decide_as_one(spark):
    """Batches in the order of ids: each document is kept or not as in a single batch, and the sizes of a text's groups add up."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = ed.DigestIndex(spark, "two_batches", buckets=4)
    half = docs.approxQuantile("doc_id", [0.5], 0.0)[0]
    parts = [index.add(docs.where(F.col("doc_id") <= half)), index.add(docs.where(F.col("doc_id") > half))]
    got = parts[0].unionByName(parts[1])
    one = ed.deduplicated(docs)
    cut = lambda d: sorted(map(tuple, d.select("doc_id", "keep_id", "kept", "text_sha256").collect()))
    assert cut(got) == cut(one)
    size = lambda d: {tuple(r) for r in d.select("doc_id", "text_sha256", "group_size").groupBy("text_sha256", "group_size").count().groupBy("text_sha256").agg(F.sum("count")).collect()}
    assert size(got) == size(one)
    before = sorted(map(tuple, index.table().collect()))
    assert len(before) == one.select("text_sha256").distinct().count()
    files = spark.table("two_batches").select("_metadata.file_path").distinct().count()
    index.compact()
    assert spark.table("two_batches").select("_metadata.file_path").distinct().count() == 4 < files
    assert sorted(map(tuple, index.table().collect())) == before
    assert not any(r.kept for r in index.add(docs.withColumn("doc_id", F.col("doc_id") + 10**6)).collect())
    index.drop()


def test_batches_at_once(spark):
    """A digest that two writers add at the same time stays one row for those who read."""
    index = ed.DigestIndex(spark, "at_once", buckets=2)
    index.add(frame(spark, [(5, "one"), (6, "two")]))
    index._write(spark.createDataFrame([(hashlib.sha256(b"one").hexdigest(), 3)], "digest string, keep_id long"))
    assert len(index.table().collect()) == 2
    got = sorted(map(tuple, index.add(frame(spark, [(9, "one"), (8, "three")])).collect()))
    assert [r[:4] for r in got] == [(8, 8, 1, True), (9, 3, 1, False)]
    index.drop()


def test_staged_tables_go(spark):
    made = len(common._STAGED)
    out = common.settled(spark, lambda: ed.distinct_documents(frame(spark, rows())), "settled")
    assert len(common._STAGED) == made + 1 and out.count() > 0
    assert common.settled(spark, lambda: out.limit(2), "again", instead_of=out).count() == 2 and len(common._STAGED) == made + 1


def test_a_cluster_names_its_folder(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert common._temporary("local[2]") == common._temporary("local[2]")
    with pytest.raises(ValueError, match="shared folder"):
        common._temporary("spark://host:7077")
