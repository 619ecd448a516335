"""Sampling, caps and clocks within a case, such as the plies of a game. Every window is partitioned by the case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_tail(df: DataFrame, case: str, ply: str, first: int, step: int, tail: int, tail_step: int) -> DataFrame:
    """Every ``step``-th ply from ``first``; of the last ``tail`` plies every ``tail_step``-th."""
    end = F.max(ply).over(Window.partitionBy(case))
    at = F.when(end - F.col(ply) <= tail, F.lit(tail_step)).otherwise(F.lit(step))
    return df.withColumn("__at", at).where((F.col(ply) >= first) & ((F.col(ply) - first) % F.col("__at") == 0)).drop("__at")


def durations(df: DataFrame, case: str, ply: str, clock: str, base: Column, increment: Column) -> DataFrame:
    """Seconds spent on a move by the side to move: its last known clock, at first the base time, less the new one, plus
    the increment, at least 0; null where the clock is null."""
    w = Window.partitionBy(case, F.col(ply) % 2).orderBy(ply)
    before = F.coalesce(F.last(clock, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), base)
    return df.withColumn("spent", F.when(F.col(clock).isNotNull(), F.greatest(F.lit(0.0), before - F.col(clock) + increment)))


def capped(df: DataFrame, case: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each case; Spark limits each task's groups before the shuffle."""
    r = F.row_number().over(Window.partitionBy(case).orderBy(order))
    return df.withColumn("__r", r).where(F.col("__r") <= most).drop("__r")


def flat_cap(df: DataFrame, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of all, kept by each task before they meet."""
    return df.orderBy(order).limit(most)


def not_forced(df: DataFrame, legal: str) -> DataFrame:
    """Positions with a choice: rows whose number of legal moves is not 1."""
    return df.where(F.col(legal) != 1)


def not_alone(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of classes with more than one row."""
    return df.join(df.groupBy(*keys).count().where("count > 1").drop("count"), list(keys), "left_semi")


def early_stop(losses: DataFrame, run: str, epoch: str, loss: str, patience: int) -> DataFrame:
    """The first epoch that ends ``patience`` epochs in a row without a new minimum, null if none, and the minimum.

    The epochs of a run are few by nature; they are folded in order as one array."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("waited"), F.lit(None).cast("bigint").alias("stop"))

    def step(s, x):
        better = x["loss"] < s["best"]
        waited = F.when(better, 0).otherwise(s["waited"] + 1)
        new = F.struct(F.least(s["best"], x["loss"]).alias("best"), waited.alias("waited"), F.when(waited >= patience, x["epoch"]).alias("stop"))
        return F.when(s["stop"].isNotNull(), s).otherwise(new)

    seen = F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("bigint").alias("epoch"), F.col(loss).cast("double").alias("loss"))))
    return losses.groupBy(run).agg(F.aggregate(seen, start, step).alias("s")).select(run, F.col("s.stop").alias("stop"), F.col("s.best").alias("best"))
