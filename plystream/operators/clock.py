"""Statistics of thinking times, and look-ups by the nearest rating."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plystream.operators import split


def bucket(rating: Column, size: int = 100) -> Column:
    """The nearest multiple of ``size``, halves to even."""
    return (F.bround(rating.cast("double") / size) * size).cast("bigint")


def stats(df: DataFrame, clock: str, rating: str, mate: str, most: float, needed: int = 30) -> DataFrame:
    """Count, mean and population deviation of ln(clock) by (bucket, mate), by bucket and over all; small groups are
    dropped on the first two levels. Clocks below 0.05 or above ``most`` are left out."""
    d = df.where(F.col(clock).between(0.05, most)).select(bucket(F.col(rating)).alias("bucket"), F.col(mate).cast("bigint").alias("mate_n"), F.ln(clock).alias("x"))
    g = d.groupingSets([["bucket", "mate_n"], ["bucket"], []], "bucket", "mate_n").agg(
        F.count("*").alias("n"), F.avg("x").alias("mu"), F.stddev_pop("x").alias("sigma"), F.grouping_id().cast("bigint").alias("level"))
    return g.where((F.col("level") == 3) | (F.col("n") >= needed))


def write_stats(stats_: DataFrame, path: str) -> None:
    """The statistics, a few hundred rows, as one file of JSON lines."""
    stats_.coalesce(1).write.mode("overwrite").json(path)


def nearest(df: DataFrame, key: str, table: DataFrame, at: str, out: str) -> DataFrame:
    """Adds ``out`` and its place ``out``_at from the row of ``table`` whose ``at``, unique, is nearest to ``key``; ties go to
    the smaller, an empty table or a null key gives nulls.

    The distinct keys and the table are laid out in one order, cut into ranges. In its range each key sees the rows before
    and after it; what lies beyond comes from the table of ranges, which has a few thousand rows. Found rows are joined
    back by equality."""
    want = df.select(F.col(key).cast("double").alias("k")).where("k is not null").distinct()
    row = F.struct(F.col(at).alias("at"), F.col(out).alias("v"))
    fit = table.where(F.col(at).isNotNull()).select(F.col(at).cast("double").alias("k"), row.alias("r"))
    none = F.lit(None).cast(fit.schema["r"].dataType)
    both = want.select("k", none.alias("r"), F.lit(True).alias("asked")).unionByName(fit.withColumn("asked", F.lit(False)))
    both = both.withColumn("cell", split.ranges(both, "k"))
    cells = both.groupBy("cell").agg(F.min_by("r", F.when(~F.col("asked"), F.col("k"))).alias("first"), F.max_by("r", F.when(~F.col("asked"), F.col("k"))).alias("last"))
    along = Window.orderBy("cell")
    cells = cells.select("cell", F.last("last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("below"),
                         F.first("first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("above"))
    w = Window.partitionBy("cell").orderBy("k")
    both = both.withColumn("lo", F.last("r", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("hi", F.first("r", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    near = both.where("asked").join(F.broadcast(cells), "cell").select("k", F.coalesce("lo", "below").alias("lo"), F.coalesce("hi", "above").alias("hi"))
    further = F.col("k") - F.col("lo.at") > F.col("hi.at") - F.col("k")
    near = near.select(F.col("k").alias("__k"), F.when(F.col("lo").isNull() | further, F.col("hi")).otherwise(F.col("lo")).alias("__b"))
    return df.join(near, F.col(key).cast("double") == F.col("__k"), "left").withColumn(f"{out}_at", F.col("__b.at")).withColumn(out, F.col("__b.v")).drop("__k", "__b")


def norm(c: Column) -> Column:
    return F.least(F.log1p(F.greatest(c, F.lit(0.0))) / F.log1p(F.lit(600.0)), F.lit(1.0))


def resolve(emt: Column, diff: Column, bucketed: Column, constant: float) -> tuple[Column, Column]:
    """The first clock there is, and where it comes from."""
    source = F.when(emt.isNotNull(), "emt").when(diff.isNotNull(), "clk").when(bucketed.isNotNull(), "rating").otherwise("constant")
    return F.coalesce(emt, diff, bucketed, F.lit(float(constant))), source


def from_average(seconds: Column, sigma: float = 0.9) -> Column:
    """The mean of ln(clock) of a lognormal with this average."""
    return F.ln(F.greatest(seconds.cast("double"), F.lit(1e-3))) - sigma * sigma / 2


def _nearest_buckets(want: DataFrame, fit: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``near``, the nearest bucket's (bucket, mu, sigma) among those with equal ``by``, to distinct (by, b) rows: both
    are laid out in one order, in which each row sees the buckets before and after it."""
    none = F.lit(None).cast("struct<bucket:bigint,mu:double,sigma:double>")
    both = want.select(*by, "b", none.alias("v"), F.lit(True).alias("asked")).unionByName(
        fit.select(*by, F.col("bucket").alias("b"), F.struct("bucket", "mu", "sigma").alias("v"), F.lit(False).alias("asked")))
    w = Window.partitionBy(*by).orderBy("b")
    lo = F.last("v", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    hi = F.first("v", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    both = both.withColumn("lo", lo).withColumn("hi", hi).where("asked")
    further = F.col("b") - F.col("lo.bucket") > F.col("hi.bucket") - F.col("b")
    return both.select(*by, "b", F.when(F.col("lo").isNull() | further, F.col("hi")).otherwise(F.col("lo")).alias("near"))


def with_fallback(df: DataFrame, rating: str, mate: str, stats_: DataFrame, far: int = 300) -> DataFrame:
    """mu and sigma of each row from the result of ``stats``: the nearest bucket of its mate_n if at most ``far`` away, else
    the nearest bucket, else all. Ties go to the smaller bucket; a null rating or mate skips the steps that need it.

    Only the distinct (bucket, mate_n) of the rows meet the statistics, both bounded by the range of ratings, and what is
    found is joined back by equality."""
    d = df.withColumn("__b", bucket(F.col(rating))).withColumn("__m", F.col(mate).cast("bigint"))
    want = d.select(F.col("__b").alias("b"), F.col("__m").alias("mate_n")).distinct()
    fit = lambda level: stats_.where(F.col("level") == level)
    within = _nearest_buckets(want, fit(0), ["mate_n"]).withColumnRenamed("near", "within")
    rated = _nearest_buckets(want.select("b").distinct(), fit(1), []).select(F.col("b").alias("rb"), F.col("near").alias("rated"))
    whole = fit(3).select(F.struct("mu", "sigma").alias("whole"))
    found = within.join(rated, F.col("b").eqNullSafe(F.col("rb")), "left").crossJoin(F.broadcast(whole))
    short = lambda c: F.when(F.col(c).isNotNull(), F.struct(f"{c}.mu", f"{c}.sigma"))
    close = F.when(F.abs(F.col("within.bucket") - F.col("b")) <= far, short("within"))
    found = found.select("b", "mate_n", F.coalesce(close, F.when(F.col("b").isNotNull(), short("rated")), "whole").alias("v"))
    found = found.select(F.col("b").alias("__fb"), F.col("mate_n").alias("__fm"), F.col("v.mu").alias("mu"), F.col("v.sigma").alias("sigma"))
    return d.join(found, F.col("__b").eqNullSafe(F.col("__fb")) & F.col("__m").eqNullSafe(F.col("__fm")), "left").drop("__b", "__m", "__fb", "__fm")


def gauss(key: Column) -> Column:
    """A standard normal number that depends on nothing but its key, by Box and Muller from two 52-bit parts of its md5."""
    h = F.md5(key.cast("string").cast("binary"))
    u, v = ((F.conv(F.substr(h, F.lit(at), F.lit(13)), 16, 10).cast("double") + 0.5) / 2.0**52 for at in (1, 14))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def draw(key: Column, mu: Column, sigma: Column) -> Column:
    """A lognormal clock; sigma is at least 0.3, the clock within 0.5 and 300."""
    return F.least(F.greatest(F.exp(mu + F.greatest(sigma, F.lit(0.3)) * gauss(key)), F.lit(0.5)), F.lit(300.0))


def simulated(key: Column, base: Column) -> Column:
    """The base time with noise of 15 %, at least three tenths of it and 0.5."""
    return F.greatest(F.lit(0.5), base * F.greatest(F.lit(0.3), 1 + 0.15 * gauss(key)))
