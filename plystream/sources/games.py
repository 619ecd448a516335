"""Readers of game records: a file of games, or a CSV table with one game a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def infer_kind(path: Column) -> Column:
    return F.when(F.endswith(F.lower(path), F.lit(".zst")), "zst").otherwise("text")


def pgn_games(spark: SparkSession, path: str, tag: str, skip: int = 0, most: int | None = None) -> DataFrame:
    """Rows (source_tag, local_id, pgn) of plain or compressed files; local_id counts from 1, ``most`` counts after ``skip``.

    Files are split into blocks. Each block numbers its own games, and the small table of blocks gives each block its
    offset, so that no task sees more than a block. ``skip`` and ``most`` are the caller's resume point and limit.
    """
    raw = spark.read.option("lineSep", "\n[Event ").text(path).select(
        F.struct("_metadata.file_path", "_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("pgn")).where(F.trim("pgn") != "")
    blocks = raw.groupBy("block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = raw.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy("at"))).join(blocks.withColumn("before", before), "block")
    pgn = F.when(F.startswith("pgn", F.lit("[Event ")), F.col("pgn")).otherwise(F.concat(F.lit("[Event "), F.col("pgn")))
    out = numbered.select(F.lit(tag).alias("source_tag"), (F.col("before") + F.col("r")).alias("local_id"), pgn.alias("pgn")).where(F.col("local_id") > skip)
    return out if most is None else out.where(F.col("local_id") <= skip + most)


def csv_games(spark: SparkSession, path: str, column: str = "pgn") -> DataFrame:
    """A CSV table whose quoted fields may hold line ends; rows without a game go."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').where(F.col(column).isNotNull())


def debug_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed ones go."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def sniff(head: Column) -> Column:
    """The format of a file by its first lines: games if the first that is not blank begins one, else a table."""
    return F.when(F.rlike(head, F.lit(r"^\s*\[Event ")), "pgn").otherwise("csv")


def holdout_row(rules: list[str]) -> Column:
    """Rated games of these rules that have a record."""
    return F.lower("rules").isin(rules) & (F.lower("rated") == "true") & F.col("pgn").isNotNull()


def numbered(df: DataFrame, path: str, row: str) -> DataFrame:
    """Numbers the rows of each file from 1, after whatever filters came before."""
    return df.withColumn("local_id", F.row_number().over(Window.partitionBy(path).orderBy(row)).cast("bigint"))


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV tables of results with a header line: empty fields and ``None`` are null, and so is what does not fit its type. Columns
    are found by name; those that a file lacks are null, others are left out."""
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    rows = spark.read.csv(path, header=True, escape='"', enforceSchema=False)
    text = lambda c: F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("None"))
    return rows.select(*[(text(F.col(f"`{f.name}`")).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])
