"""Where in their sequences the weight lies, by range of length: long tables of (sequence, position, value)."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plystream.operators import quantiles


def length_bin(length: Column, width: int) -> Column:
    """The lower end of the range of ``width`` lengths."""
    return (F.floor((length - 1) / width) * width + 1).cast("bigint")


def ranked(df: DataFrame, seq: str, pos: str, value: str, most: int = 3) -> DataFrame:
    """The largest values of each sequence with their rank; ties go to the lower position."""
    r = F.row_number().over(Window.partitionBy(seq).orderBy(F.desc(value), pos))
    return df.withColumn("rank", r.cast("bigint")).where(F.col("rank") <= most)


def modal(tops: DataFrame, bin_: str, pos: str, value: str) -> DataFrame:
    """By range and rank: the most frequent position, its share of the sequences in %, and the mean of all values there."""
    c = tops.groupBy(bin_, "rank", pos).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    top = F.max_by(pos, F.struct("n", -F.col(pos)))
    return c.groupBy(bin_, "rank").agg(top.alias("modal"), (100 * F.max("n") / F.sum("n")).alias("dominance"), (F.sum("s") / F.sum("n")).alias("mean_value"))


def window_metrics(df: DataFrame, seq: str, pos: str, value: str) -> DataFrame:
    """By sequence: the peak, the share of positions above half of it, and the peak's place as a share of the length."""
    g = df.groupBy(seq).agg(F.max(value).alias("peak"), F.min_by(pos, F.struct(-F.col(value), F.col(pos))).alias("at"), F.count("*").alias("length"))
    above = df.join(g, seq).groupBy(seq).agg(F.count_if(F.col(value) > F.col("peak") * 0.5).alias("above"))
    return g.join(above, seq).select(seq, "peak", "length", (F.col("above") / F.col("length")).alias("wide"), (F.col("at") / F.col("length")).alias("place"))


def quantile_bins(df: DataFrame, length: str, bins: int) -> DataFrame:
    """Ranges (bin, lo, hi), both ends included, between exact quantiles of the lengths, rounded outwards; they may overlap."""
    at = quantiles.exact(df, length, [i / bins for i in range(bins + 1)])
    if at[0] is None:
        return df.sparkSession.createDataFrame([], "bin int, lo bigint, hi bigint")
    return df.sparkSession.createDataFrame([(i, floor(at[i]), ceil(at[i + 1])) for i in range(bins)], "bin int, lo bigint, hi bigint")


def critical(df: DataFrame, seq: str, pos: str, value: str, length: str, ranges: list[tuple[int, int]], most: int = 3) -> DataFrame:
    """By range of length (lo included, hi not; a sequence may be in several) and position of the largest values: their mean,
    and their number by that of the range's sequences."""
    bins = F.filter(F.array(*[F.when((F.col(length) >= lo) & (F.col(length) < hi), F.lit(i)) for i, (lo, hi) in enumerate(ranges)]), lambda b: b.isNotNull())
    tops = ranked(df.withColumn("bins", bins), seq, pos, value, most).withColumn("bin", F.explode("bins"))
    size = tops.where("rank = 1").groupBy("bin").agg(F.count("*").alias("sequences"))
    got = tops.groupBy("bin", pos).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"))
    return got.join(size, "bin").select("bin", pos, "mean_value", (F.col("n") / F.col("sequences")).alias("frequency"))
