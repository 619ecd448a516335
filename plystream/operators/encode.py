"""Encoders: a fit is a small table, applied by broadcast or as literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plystream.operators import quantiles

MISSING = -1.0


def minmax_masked(df: DataFrame, value: str, out: str) -> DataFrame:
    """Scales what is neither null nor -1; both of these become -1. A constant column gives 0."""
    ok = F.col(value).isNotNull() & (F.col(value) != MISSING)
    fit = df.agg(F.min(F.when(ok, F.col(value))).alias("__lo"), F.max(F.when(ok, F.col(value))).alias("__hi"))
    x = F.when(~ok, MISSING).when(F.col("__hi") > F.col("__lo"), (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0)
    return df.crossJoin(F.broadcast(fit)).withColumn(out, x).drop("__lo", "__hi")


def minmax_median(df: DataFrame, value: str, out: str) -> DataFrame:
    """Nulls take the exact median, found in bounded memory; then scaled over all rows."""
    fit = df.agg(F.lit(quantiles.median(df, value)).cast("double").alias("__m"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    x = F.coalesce(F.col(value), F.col("__m"))
    return df.crossJoin(F.broadcast(fit)).withColumn(out, F.when(F.col("__hi") > F.col("__lo"), (x - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0)).drop("__m", "__lo", "__hi")


def onehot(c: Column, categories: list[str]) -> list[Column]:
    """A column for each category; unknown values give zeros."""
    return [F.coalesce((c == v).cast("int"), F.lit(0)).alias(f"is_{v}") for v in categories]


def onehot_masked(c: Column, categories: list[str], missing: str = "<NO_DESC>") -> list[Column]:
    """As ``onehot``, and -1 everywhere where the value is missing."""
    return [F.when(c == missing, -1).otherwise(F.coalesce((c == v).cast("int"), F.lit(0))).alias(f"is_{v}") for v in categories]


def look_up(df: DataFrame, vocabulary: DataFrame, key: str, out: str, unknown: int = -1) -> DataFrame:
    """Ids of tokens, ``unknown`` where the vocabulary (token, id) lacks them. Spark broadcasts a small vocabulary."""
    v = vocabulary.select(F.col("token").alias("__token"), F.col("id").alias("__id"))
    return df.join(v, F.col(key) == F.col("__token"), "left").withColumn(out, F.coalesce("__id", F.lit(unknown).cast("bigint"))).drop("__token", "__id")


def pad(c: Column, size: int, value: float = MISSING, before: bool = False) -> Column:
    fill = F.array_repeat(F.lit(value).cast("double"), F.greatest(F.lit(size) - F.size(c), F.lit(0)))
    return F.slice(F.concat(fill, c) if before else F.concat(c, fill), 1, size)
