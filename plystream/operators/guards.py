"""Checks that stop a job or report what is wrong, in the pass that reads the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validate(df: DataFrame, *columns: str) -> DataFrame:
    """Raises, naming the missing columns, before anything runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def required(df: DataFrame, column: str) -> DataFrame:
    """The job fails at a null."""
    return df.withColumn(column, F.coalesce(column, F.raise_error(F.lit(f"{column} is null")).cast(df.schema[column].dataType)))


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys of more than one row, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def aligned(df: DataFrame, header: list[str]) -> DataFrame:
    """The columns of a fixed header: others go, missing ones and nulls are empty."""
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in header])


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in order; the job fails if there are fewer."""
    rows = df.orderBy(order).limit(n)
    have = rows.agg(F.count("*").alias("__have"))
    enough = have.select(F.when(F.col("__have") == n, 0).otherwise(F.raise_error(F.format_string(f"%d rows of {n}", "__have")).cast("int")).alias("__ok"))
    return rows.join(F.broadcast(enough), F.col("__ok") == 0, "left_semi")


def total_join(df: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """A left join that has to find a value for every row; the job fails at the first key without one."""
    found = df.join(other, key, "left")
    fail = F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.withColumn(value, F.coalesce(value, fail.cast(found.schema[value].dataType)))


def whole_windows(df: DataFrame, key: str, windows: str) -> DataFrame:
    """Rows whose array of windows is not empty; the job fails at a key that has more than one row."""
    n = F.count("*").over(Window.partitionBy(key))
    once = F.when(n == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{key} twice: "), F.col(key).cast("string"))).cast(df.schema[key].dataType))
    return df.withColumn(key, once).where(F.size(windows) > 0)
