"""Personal data: patterns, and information-theoretic sanitisation of terms that reveal what they protect.

The patterns find protected entities: addresses, numbers and hosts. A term near an entity reveals it as far as the corpus
shows them together: disclosure is the pointwise mutual information of entity and term over the information content
of the entity, log(N n_et / (n_e n_t)) / log(N / n_e), counted in distinct documents of the whole corpus, times c / (c + 1)
for c different contexts, so that what is seen once counts half and copies of a passage are no evidence. An entity in
every document has no information to disclose. A term that discloses more than a threshold is generalised, and above
a second one removed, wherever it stands in a document that has it near the entity.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plystream.llm.common import BROADCAST, sliced, staged

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of an entity, and the thresholds of disclosure.
NEAR, GENERALISE, REMOVE = 8, 0.5, 0.9
#: Slots of the filter that carries candidate terms to the counting of documents.
SLOTS = 1 << 22

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match always ends with a run of digits, so none begins inside one
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
Span = tuple[int, int, str, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping, in one pass: what stands before an @ belongs to that @ alone."""
    low, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > low and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            low = m.end()
        else:
            low = at + 1
        at = text.find("@", low)


def _only_digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """(start, end, kind, value) of entities, by start, then kind as listed."""
    out = [(a, b, "email", text[a:b].lower()) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip", m[0]) for m in _IP.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or "0") <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = _only_digits(m[0]) if m.end() - m.start() <= 40 else ""
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card", d))
        if "+" in text:
            out += [(m.start(), m.end(), "phone", d) for m in _PHONE.finditer(text) if 10 <= len(d := _only_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, *_ in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def contexts(text: str, spans: list[Span]) -> tuple[list[tuple[str, int, str]], list[tuple[str, int, int]]]:
    """(entity, context, term) of the terms near each entity, with one row of the entity itself with an empty term; and
    (term, start, end) of all places of these terms in the text, but for those that overlap an entity. The context is
    the hash of the words next to the entity, so copies of a passage are one context. A text is cut into words once."""
    if not spans:
        return [], []
    begins, ends = [s[0] for s in spans], [*accumulate((s[1] for s in spans), max)]  # the furthest end of the spans so far
    words = []
    for m in _TERM.finditer(text):
        k = bisect_left(begins, m.end())  # the spans that begin before the word ends
        words.append((m.start(), m.end(), m[0].lower(), k == 0 or ends[k - 1] <= m.start()))
    starts, stops = [w[0] for w in words], [w[1] for w in words]
    near = []
    for a, b, kind, value in spans:
        i, j = bisect_right(stops, a), bisect_left(starts, b)  # words before the first and from the second on are outside
        sides = [*(w[2] for w in words[max(i - 1, 0) : i]), "|", *(w[2] for w in words[j : j + 1])]
        context, entity = crc32(" ".join(sides).encode("utf-8", "surrogatepass")), f"{kind}:{value}"
        near.append((entity, context, ""))
        near += [(entity, context, w[2]) for w in (*words[max(i - NEAR, 0) : i], *words[j : j + NEAR]) if w[3]]
    terms = {t for _, _, t in near}
    return near, [(t, x, y) for x, y, t, free in words if free and t in terms]


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("text_hash"))


def scan(rows: DataFrame) -> DataFrame:
    """Base spans and contexts of rows (doc_id, text, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = pa.list_(pa.struct([("entity", pa.string()), ("context", pa.int64()), ("term", pa.string())]))
        at = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in sliced(batches):
            texts = b.column(1).to_pylist()
            found = [base_spans(t) for t in texts]
            both = [contexts(t, s) for t, s in zip(texts, found, strict=True)]
            count = [Counter(s[2] for s in f) for f in found]
            base = [written(f) for f in found]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(2), *(pa.array([c[k] for c in count], pa.int64()) for k in KINDS[:4]), pa.array(base, pa.string()),
                pa.array([sha256(x.encode()).hexdigest() for x in base], pa.string()),
                pa.array([[dict(zip(("entity", "context", "term"), x, strict=True)) for x in n] for n, _ in both], near),
                pa.array([[dict(zip(("term", "start", "end"), x, strict=True)) for x in w] for _, w in both], at)], names)

    names = ["doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "near", "at"]
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, base_sha256 string, "
                                "near array<struct<entity:string,context:bigint,term:string>>, at array<struct<term:string,start:int,end:int>>")


def weighted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(text, weight): each distinct document (doc_id, text_hash) has a weight of 1, shared by its rows. Without repeated
    rows nothing is joined."""
    repeated = staged(found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "n"), "pii-repeated")
    many = repeated.count()
    if not many:
        return rows.select("text", F.lit(1.0).alias("weight"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    return rows.join(F.broadcast(repeated) if many * 24 <= BROADCAST else repeated, on, "left").select("text", F.coalesce(1 / F.col("n"), F.lit(1.0)).alias("weight"))


def document_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """In how many documents each of ``terms`` stands: (term, n_term); ``texts`` has (text, weight). A filter of fixed size
    goes to all tasks; the counts are exact."""
    slot = terms.select(F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(SLOTS)).alias("slot"))
    filled = slot.groupBy(F.shiftright("slot", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))").alias("bits")).toArrow()
    packed = np.zeros(SLOTS // 32, np.uint32)
    packed[filled["word"].to_numpy()] = filled["bits"].to_numpy().astype(np.uint32)
    given = texts.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = np.unpackbits(given.value.view(np.uint8), bitorder="little").astype(bool)
        for b in sliced(batches):
            count: defaultdict[str, float] = defaultdict(float)
            for t, weight in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for w in {w.lower() for w in set(_TERM.findall(t.as_py()))}:
                    if want[crc32(w.encode("utf-8", "surrogatepass")) % SLOTS]:
                        count[w] += weight
            yield pa.RecordBatch.from_arrays([pa.array([*count], pa.string()), pa.array([*count.values()], pa.float64())], ["term", "n"])

    counted = texts.select("text", "weight").mapInArrow(run, "term string, n double")
    return counted.groupBy("term").agg(F.round(F.sum("n")).cast("bigint").alias("n_term")).join(terms, "term", "left_semi")


def disclosing(rows: DataFrame, found: DataFrame, least: float = GENERALISE) -> DataFrame:
    """Pairs (entity, term, disclosure) of the corpus that disclose ``least`` or more; ``found`` is what ``scan`` made of ``rows``."""
    near = found.select(F.struct("doc_id", "text_hash").alias("doc"), F.explode("near").alias("x")).select("doc", "x.*")
    counts = staged(near.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("doc").alias("n_both")), "pii-pairs")
    entities = counts.where("term = ''").select("entity", F.col("n_both").alias("n_entity"))
    pairs = counts.where("term <> ''")
    n = F.lit(float(found.select("doc_id", "text_hash").distinct().count()))
    terms = document_counts(weighted(rows, found), pairs.select("term").distinct())
    held = F.ln(n / F.col("n_entity"))
    shown = F.ln(n * F.col("n_both") / (F.col("n_entity") * F.greatest("n_term", "n_both"))) / F.nullif(held, F.lit(0.0))
    shown = F.coalesce(shown, F.lit(0.0)) * F.col("contexts") / (F.col("contexts") + 1)
    return pairs.join(entities, "entity").join(terms, "term").select("entity", "term", shown.alias("disclosure")).where(F.col("disclosure") >= least)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = GENERALISE) -> DataFrame:
    """Returns, for each row: doc_id, text_hash, n_email, n_ip, n_card, n_phone, base_sha256, spans, terms (array of start,
    end, disclosure of the terms to treat: the largest of the entities that the document has them near).

    Terms are words of three letters or more, up to NEAR words from an entity; a stretch of a writing without spaces is one
    word, and names of two letters are none. Null texts count as empty; repeated rows give repeated rows and count once in the corpus; rows of one id with different
    texts are different documents; other columns are ignored; an empty table gives no rows. No entity is lost for
    want of context: base spans never depend on the corpus. The texts are read twice and never shuffled, unless more
    rows are repeated than can be broadcast.
    """
    rows = _rows(docs, doc_id, text)
    found = staged(scan(rows), "pii")
    pairs = staged(disclosing(rows, found, least), "pii-disclosing")
    key = ["doc_id", "text_hash"]
    near = found.select(*key, F.explode("near").alias("x")).select(*key, "x.entity", "x.term")
    shown = near.join(pairs, ["entity", "term"]).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("term").alias("__term")).agg(F.max("disclosure").alias("disclosure"))
    at = found.select(*key, F.explode("at").alias("x")).select(*key, "x.*")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    # a set, as the places of a repeated row come up once for each of its rows
    hits = at.join(shown, same & (F.col("term") == F.col("__term"))).groupBy("__id", "__hash").agg(F.sort_array(F.collect_set(F.struct("start", "end", "disclosure"))).alias("terms"))
    out = found.join(hits, same, "left").select(found["*"], "terms")
    none = F.array().cast("array<struct<start:int,end:int,disclosure:double>>")
    return out.select("doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base",
                      F.coalesce("terms", none).alias("terms")).withColumn("spans", all_spans())


def all_spans():
    """Base and term spans, written by start; at equal starts base ones first."""
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(
        F.split(x, ":")[1].cast("int").alias("start"), F.lit(0).alias("order"), x.alias("span")))
    order = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), F.substring_index(s, ":", 1)).cast("int")
    base = F.transform(base, lambda x: F.struct(x["start"], order(x["span"]).alias("order"), x["span"].alias("span")))
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("order"), F.concat_ws(":", F.lit("term"), t["start"], t["end"]).alias("span")))
    return F.array_join(F.transform(F.array_sort(F.concat(base, terms)), lambda x: x["span"]), ",")


def sanitise_text(text: str, terms: list[tuple[int, int, float]], remove: float = REMOVE) -> str:
    """Entities give way to the names of their kinds, in capitals; terms are generalised to <TERM> or removed."""
    marks = [(a, b, f"<{kind.upper()}>") for a, b, kind, _ in base_spans(text)]
    marks += [(a, b, "" if d >= remove else "<TERM>") for a, b, d in terms]
    out, at = [], 0
    for a, b, mark in sorted(marks):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with entities masked and disclosing terms generalised or removed in their texts, and ``n_chars``, if there is
    such a column, counted anew. Null texts stay null. Only documents with disclosing terms are looked up; Spark
    broadcasts them if their table is small enough, and joins by shuffle otherwise."""
    marked = staged(find(docs, doc_id, text).where(F.size("terms") > 0).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("terms").alias("__terms")).dropDuplicates(["__id", "__hash"]), "pii-terms")
    on = docs[doc_id].cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("__hash"))

    @F.pandas_udf("string")
    def clean(texts, terms):
        import pandas as pd

        return pd.Series([None if t is None else sanitise_text(t, [(x["start"], x["end"], x["disclosure"]) for x in (m if m is not None else [])]) for t, m in zip(texts, terms, strict=True)], dtype=object)

    out = docs.join(marked, on, "left").withColumn(text, clean(F.col(text), F.col("__terms")))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.char_length(text).cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns)
