"""The corpus pipeline: from raw documents to packed sequences of tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of
``documents``, and whatever other columns the table has. In every stage null texts count as empty, rows without an id
are documents, repeated rows share a decision, texts of any length are worked on whole and an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plystream.llm import exact_dedup, langid, packing, pii, simhash
from plystream.llm.common import settled


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not identified go: null texts, texts without a letter, and longer texts that no learned
    language explains better than chance. ``lang`` becomes the language identified; ties go to the first in the alphabet."""
    return langid.identified(docs, langid.sample(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, white space aside, the smallest doc_id stays; of rows that repeat it, one."""
    return exact_dedup.distinct_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by SimHash links, the smallest doc_id stays; repeated rows of it stay."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, terms that reveal it are generalised or removed; n_chars follows. No row goes; null texts stay null."""
    return pii.sanitised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents are tokenised, cut and packed into sequences; an empty text is the one end token."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("pii", personal_data), ("packing", pack)]

#: Neither automata, SimHash nor tokenizers can be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written to the shared folder; once it is, its input and all it staged on its way are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, partial(stage, spark, docs, sf_dir), name, instead_of=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
