"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch of documents is reduced to one row for each digest and
merge-joined with the index, which is scanned once and not exchanged: rows without a match, those of the anti-join,
are new and are appended; the others learn which document the index keeps.
Built-in functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plystream.llm.common import SPACE, delete, join_groups, parallelism, shared_dir, staged, without


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def digest(text: str = "text"):
    """SHA-256, in hex, of the text with each run of white space replaced by one space."""
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


class DigestIndex:
    """A table (digest, keep_id) clustered by digest, in the shared folder; with a ``path`` of its own it outlives the session
    that made it."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or parallelism(spark)
        self.own = path is None
        self.path = path or f"{shared_dir(spark)}/{name}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        """One row for each digest, also where two batches have added one at the same time. Buckets are aggregated where
        they are."""
        return self.spark.table(self.name).groupBy("digest").agg(F.min("keep_id").alias("keep_id"))

    def compact(self) -> None:
        """Rewrites the table with one sorted file for each bucket, in place of one for each batch."""
        whole = staged(self.table(), "digest-index")
        self._write(whole, overwrite=True)

    def _write(self, rows: DataFrame, overwrite: bool = False) -> None:
        rows = rows.select("digest", "keep_id").repartition(self.buckets, "digest").sortWithinPartitions("digest")
        rows.write.insertInto(self.name, overwrite=overwrite)
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        """Forgets the table; its files go too, if they are in the shared folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.own:
            delete(self.spark, self.path)

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Deduplicates a batch and appends its new digests.

        Returns one row for each row of ``docs``: doc_id, keep_id, group_size (rows of this batch with the text), kept,
        text_sha256. A text that the index has already is kept by nobody in the batch, unless the batch holds that very
        row again. Null texts count as empty; empty texts equal each other. Rows that repeat id and text all count, and
        share one decision (``distinct_documents`` keeps one of them). Null ids lose to all others. An empty batch
        gives no rows. Other columns play no part.
        """
        rows = staged(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), digest(text).alias("digest")), "digests")
        groups = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")), "digest-groups")
        known = self.table().withColumn("known", F.lit(True)).hint("merge")
        decided = groups.join(known, "digest", "left").withColumn("keep_id", F.when(F.col("known"), F.col("keep_id")).otherwise(F.col("first_id")))
        decided = staged(decided.select("digest", "keep_id", "group_size", "known"), "digest-decided", instead_of=groups)
        self._write(decided.where("known is null"))
        decided = decided.drop("known")
        return join_groups(rows, decided, "digest", "group_size").select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
        )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The decisions over one table, by an index of its own that is dropped at the end."""
    index = DigestIndex(docs.sparkSession, f"plystream_digests_{uuid.uuid4().hex}")
    try:
        return index.add(docs, doc_id, text)
    finally:
        index.drop()


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat an id and text, one.

    Rows with an id of their own are looked up by it. Only rows without an id, and those that share one, are looked up by
    their digest too, and only they go through an aggregation of repeats. Null texts count as empty, very long ones are
    as any; an empty table gives no rows.
    """
    found = deduplicated(docs, doc_id, text)
    ids = staged(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept")), "digest-ids")
    kept = without(docs, doc_id, ids.where("n > 1 or not kept").select("doc_id"))
    odd = ids.where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__id"))
    if odd.isEmpty():
        return kept
    rows = docs.join(odd, docs[doc_id].cast("bigint").eqNullSafe(F.col("__id")), "left_semi")
    rows = rows.withColumns({"__id0": F.col(doc_id).cast("bigint"), "__digest0": digest(text)})
    stay = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest")).distinct()
    same = rows["__id0"].eqNullSafe(stay["__id"]) & (rows["__digest0"] == stay["__digest"])
    return kept.unionByName(rows.join(stay, same, "left_semi").dropDuplicates(["__id0", "__digest0"]).select(*docs.columns))
