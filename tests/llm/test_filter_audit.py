import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from plystream.llm import filter_audit as fa

DOCS = "doc_id long, text string, source string, mask string, n int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 50 else ""
    out += "B" if 100 * len(set(words)) < 65 * len(words) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else ""
    return out + ("D" if set(text) & set("#$%&*|") else "")


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, t, s in docs:
        again = i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in docs)
        rows.append((s or "", fails(t or "") + ("E" if again else ""), i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, total = [r for r in rows if r[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                out[part, "".join(order), k] = [len(kept), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == f for r in mine),
                                                sum(r[2] for r in gone), sum(r[3] for r in gone), f]
                total[f] += len(gone)
                left = kept
        for (p, *_), row in out.items():
            if p == part:
                row[6] = total[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def corpus():
    long_ = " ".join(f"w{i}" for i in range(60))
    texts = [long_, long_ + " #", "few words", "", None, "A" * 30, " ".join(["same"] * 80), long_.upper(), long_ + "\x1cx", long_ + " é\x0bü", "x $", " ".join(["S%"] * 60), long_ * 40]
    docs = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    docs += [(20 + i, t, "s1") for i, t in enumerate(texts)] + [(None, long_, "s0"), (None, "", None), (40, long_, None), (40, long_, ""), (40, "other", "s2"), (-1, long_, "s2")]
    labels = [(i, i % 2, (i + 1) % 3) for i in range(30)] + [(40, 0, 1), (40, 1, 0), (None, 1, 1), (3, None, None), (99, 1, 1)]
    return docs, labels


def frames(spark, docs, labels):
    return (spark.createDataFrame([(*d, "clash", 1) for d in docs], DOCS).repartition(3),
            spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, text string"))


def test_against_brute_force(spark):
    docs, labels = corpus()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in fa.audit_documents(*frames(spark, docs, labels)).collect()}
    assert got == plain(docs, labels)


def test_shapley_values_share_what_any_order_removes(spark):
    docs, labels = corpus()
    rows = fa.audit_documents(*frames(spark, docs, labels))
    shared = {r.part: r.n for r in rows.where("filter_order = 'ABCDE'").groupBy("part").agg(F.sum("shapley").alias("n")).collect()}
    removed = {r.part: r.n for r in rows.where("filter_order = 'ABCDE'").groupBy("part").agg(F.sum("removed").alias("n")).collect()}
    assert shared == {p: 120 * n for p, n in removed.items()}


def test_sums_invert_to_cells(spark):
    masks = [0, 0, 5, 7, 7, 7, 2]
    rows = spark.createDataFrame([("p", m, "all") for m in masks], "part string, mask int, label string")
    cell = fa.parity_sums(rows, 3).select(fa.cells(F.col("sums"), 3)).first()[0]
    assert cell == [masks.count(m) for m in range(8)]


@pytest.mark.parametrize("names", ["", "AA", "ABCDEFGHI"])
def test_names_are_checked(spark, names):
    with pytest.raises(ValueError):
        fa.audit(spark.createDataFrame([], "part string, mask int, label string"), names)


def test_empty_tables(spark):
    docs, labels = corpus()
    assert fa.audit_documents(*frames(spark, [], labels)).count() == 0
    got = fa.audit_documents(*frames(spark, docs, []))
    assert got.count() == 4 * 600 and got.agg(F.sum(F.col("good_lost") + F.col("toxic_lost"))).first()[0] == 0


def test_texts_are_not_exchanged(spark):
    docs, labels = frames(spark, *corpus())
    plan = fa.failure_masks(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
