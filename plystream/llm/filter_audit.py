"""Audit of quality filters that act together, by signed parity sums of their failures.

A document fails some of n filters; its failures are the bits of a mask. For each part and label, 2^n parity sums are
aggregated: the sum for a subset S of filters counts a document as +1 if it fails an even number of S, as -1 otherwise. They
are the Walsh-Hadamard transform of the number of documents with each mask, so that the inverse transform, a division by 2^n
that leaves no rest, gives these cells. All that an audit asks for follows from the cells of a part: what any order of the
filters removes at each step, what only one filter fails, and the Shapley value of a filter summed over all orders, as a
document that fails k filters is removed by each of them in n!/k of the n! orders. Built-in functions only.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plystream.llm.common import join_groups, staged

#: White space that ends a word.
_SPACE = r"[\x20\x09-\x0D]+"
LABELS = ("quality", "toxic")


def text_failures(text: str = "text") -> dict[str, Column]:
    """The failures that a text shows by itself: A, under 50 words; B, fewer than 65 different words in 100; C, more than 5
    capital letters in 100 code points; D, one of ``#$%&*|``. Null texts count as empty: they fail A alone."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, _SPACE), lambda w: w != "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(t) - F.char_length(F.regexp_replace(t, "[A-Z]", ""))
    return {"A": n < 50, "B": 100 * different < 65 * n, "C": 100 * capitals > 5 * F.char_length(t), "D": t.rlike(r"[#$%&*|]")}


def failure_masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row for each row of ``docs``: part, mask (bit k: the k-th filter of ABCDE fails), good, toxic.

    E fails where the text is identical to that of a smaller doc_id anywhere in the table. Only digests are exchanged, never
    texts; digests and ids that very many rows share are joined by broadcast. Null parts are the empty string. A row without
    an id has no smaller id, is nobody's smaller id and has no label. Of several labels of one id any that says 1 counts;
    null labels and ids without labels are 0.
    """
    alone = text_failures(text)
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(alone.values())), F.lit(0))
    rows = staged(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"),
                              F.unhex(F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256)).alias("digest")), "audit-rows")
    texts = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "audit-texts")
    again = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    whole = staged(join_groups(rows, texts, "digest", "n").select("doc_id", "part", (F.col("mask") + F.when(again, 1 << len(alone)).otherwise(0)).alias("mask")), "audit-masks")

    said = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.coalesce(F.col(c) == 1, F.lit(False)).alias(c) for c in LABELS))
    said = said.where("doc_id is not null and (quality or toxic)").groupBy("doc_id").agg(*(F.bool_or(c).alias(c) for c in LABELS))
    known = staged(whole.groupBy("doc_id").agg(F.count("*").alias("n")).join(said, "doc_id"), "audit-labels")
    labelled = join_groups(whole, known.select("doc_id", "n", *LABELS), "doc_id", "n").select("part", "mask", *LABELS)
    # labelled rows are counted on top of all rows, so that rows without a label need no join
    return whole.select("part", "mask", F.lit("all").alias("label")).unionAll(
        labelled.where("quality").select("part", "mask", F.lit("good"))).unionAll(labelled.where("toxic").select("part", "mask", F.lit("toxic")))


def parity_sums(rows: DataFrame, n: int) -> DataFrame:
    """(part, label, sums): the 2^n signed parity sums of the masks of each part and label, aggregated before any exchange."""
    signed = [F.sum(1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)).alias(f"s{s}") for s in range(1 << n)]
    return rows.groupBy("part", "label").agg(*signed).select("part", "label", F.array(*(f"s{s}" for s in range(1 << n))).alias("sums"))


def cells(sums: Column, n: int) -> Column:
    """The exact inverse: how many documents have each mask, from their parity sums."""
    every = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    sign = lambda m, s: 1 - 2 * (F.bit_count(m.bitwiseAND(s)) % 2)
    whole = lambda m: F.aggregate(every, F.lit(0).cast("bigint"), lambda total, s: total + F.get(sums, s) * sign(m, s))
    return F.transform(every, lambda m: F.shiftright(whole(m), n))


def _survivors(cell: Column, n: int) -> Column:
    """For each set of filters, how many documents fail none of it."""
    every = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    free = lambda u: F.filter(every, lambda m: m.bitwiseAND(u) == 0)
    return F.transform(every, lambda u: F.aggregate(free(u), F.lit(0).cast("bigint"), lambda total, m: total + F.get(cell, m)))


def _shapley(cell: Column, n: int) -> Column:
    """For each filter, what it removes, summed over all orders."""
    each = [sum((F.get(cell, F.lit(m)) * (factorial(n) // m.bit_count()) for m in range(1 << n) if m >> f & 1), F.lit(0)) for f in range(n)]
    return F.array(*each)


def audit(rows: DataFrame, names: str) -> DataFrame:
    """``rows``: (part, mask, label), label being all, good or toxic. ``names`` has one letter for each bit, at most 8.

    Returns, for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. No rows give no rows. The orders are a constant of n! * n rows, set beside each
    part by a generator; a part is one row of 3 * 2^n counts by then, however many documents it has.
    """
    n = len(names)
    if not 1 <= n <= 8 or len(set(names)) < n:
        raise ValueError("1 to 8 filters with different letters")
    zero = F.array_repeat(F.lit(0).cast("bigint"), 1 << n)
    of = lambda label: F.coalesce(F.max(F.when(F.col("label") == label, F.col("cell"))), zero).alias(label)
    parts = parity_sums(rows, n).select("part", "label", cells(F.col("sums"), n).alias("cell")).groupBy("part").agg(of("all"), of("good"), of("toxic"))
    parts = parts.select("part", "all", _shapley(F.col("all"), n).alias("value"), *(_survivors(F.col(c), n).alias(f"{c}_left") for c in ("all", "good", "toxic")))
    steps = []
    for order in permutations(range(n)):
        before = 0
        for k, f in enumerate(order, 1):
            steps.append(f"{''.join(names[i] for i in order)} {k} {f} {before}")
            before |= 1 << f
    each = F.explode(F.split(F.lit("\n".join(steps)), "\n"))
    field = lambda i, kind: F.split_part("each", F.lit(" "), F.lit(i)).cast(kind)
    out = parts.select("*", each.alias("each")).select(
        "*", field(1, "string").alias("filter_order"), field(2, "int").alias("step"), field(3, "int").alias("f"), field(4, "int").alias("before"))
    bit = F.expr("shiftleft(1, f)")
    after = F.col("before").bitwiseOR(bit)
    gone = lambda c: F.get(c, F.col("before")) - F.get(c, after)
    fails = F.get("all_left", F.lit(0)) - F.get("all_left", bit)
    return out.select("part", "filter_order", "step", F.get("all_left", after).alias("kept"), gone("all_left").alias("removed"), (fails - gone("all_left")).alias("redundant"),
                      F.get("all", bit).alias("unique_fails"), gone("good_left").alias("good_lost"), gone("toxic_left").alias("toxic_lost"), F.get("value", F.col("f")).alias("shapley"))


def audit_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The audit of the five text filters ABCDE over whole texts, see ``failure_masks`` and ``audit``. Empty texts fail A, and E
    if a smaller id is empty too; repeated rows count one by one; an empty table gives no rows; other columns play no part."""
    return audit(failure_masks(docs, labels, doc_id, text, part), "ABCDE")
