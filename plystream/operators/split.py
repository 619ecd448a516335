"""Deterministic splits and shards. Where order is random by intent, it is that of md5(seed:id)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plystream.sources import files


def shuffled(seed: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")).cast("binary"))


def positions(df: DataFrame, strata: list[str], cell: Column, order: list[str]) -> DataFrame:
    """Adds ``__r``, the place from 1 of each row in its stratum, and ``__n``, the stratum's size.

    ``cell`` cuts the order into ranges: of two rows in different cells, the one in the smaller cell comes first. Each
    cell is ranked by itself and the small table of cells gives each its offset, so that a stratum with all of the rows
    is still many tasks."""
    d = df.withColumn("__p", cell)
    whole = Window.partitionBy(*strata)
    parts = d.groupBy(*strata, "__p").agg(F.count("*").alias("__c"))
    parts = parts.withColumn("__n", F.sum("__c").over(whole)).withColumn("__before", F.sum("__c").over(whole.orderBy("__p")) - F.col("__c")).drop("__c")
    parts = parts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*strata, "__p"])], "__n", "__before")
    same = F.lit(True)
    for i, c in enumerate([*strata, "__p"]):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    d = d.withColumn("__r", F.row_number().over(Window.partitionBy(*strata, "__p").orderBy(*order)))
    d = d.join(parts, same).withColumn("__r", F.col("__r") + F.col("__before"))
    return d.drop("__p", "__before", *[f"__k{i}" for i in range(len(strata) + 1)])


def ranked(ids: DataFrame, key: str, strata: list[str], seed: str) -> DataFrame:
    """Places in random order within the stratum, in 4096 ranges of the hash."""
    d = ids.withColumn("__h", shuffled(seed, key))
    return positions(d, strata, F.substring("__h", 1, 3), ["__h", key]).drop("__h")


def ranges(df: DataFrame, order: str, cells: int = 512, spread: int = 64) -> Column:
    """The number of the range in which a number lies, nulls first. Bounds are quantiles of the column, from a sketch that one
    pass merges, so that ranges hold about equally many rows whatever outliers there are; the driver sees ``cells`` numbers.
    A value that is several bounds, as so many rows have it, is dealt over as many ranges by the hash of the whole row, and
    nulls over ``spread``: among equals any order will do."""
    x = F.col(order).cast("double")
    bounds = df.agg(F.percentile_approx(x, [i / cells for i in range(1, cells)], 20 * cells)).first()[0] or []
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    at = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")

    def below(inside) -> Column:
        """How many bounds are ``inside``, a first part of them: a binary search."""
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, step: F.when((n + step <= len(bounds)) & F.coalesce(inside(F.get(at, n + step - 1)), F.lit(False)), n + step).otherwise(n)) if bounds else F.lit(0)

    hash_ = F.xxhash64(*[F.col(c) for c in df.columns])
    pair = F.transform(F.array(F.struct(below(lambda b: b < x).alias("lo"), below(lambda b: b <= x).alias("hi"))),
                       lambda p: F.when(p["hi"] - p["lo"] > 1, p["lo"] + 1 + F.pmod(hash_, p["hi"] - p["lo"])).otherwise(p["hi"]).cast("bigint"))
    return F.when(x.isNull(), -1 - F.pmod(hash_, F.lit(spread))).otherwise(F.get(pair, F.lit(0)))


def stratified(ids: DataFrame, key: str, strata: list[str], train: float, val: float, seed: str = "0") -> DataFrame:
    """Splits each stratum by int(train n) and int(val n); the rest is for testing, so a stratum of one is for testing."""
    a, b = F.floor(F.col("__n") * F.lit(float(train))), F.floor(F.col("__n") * F.lit(float(val)))
    part = F.when(F.col("__r") <= a, "train").when(F.col("__r") <= a + b, "val").otherwise("test")
    return ranked(ids, key, strata, seed).withColumn("split", part).drop("__r", "__n")


def by_length(ids: DataFrame, key: str, length: str, bins: int, test: float, seed: str = "0") -> DataFrame:
    """Equal-width bins of the length; each gives max(1, int(n test)) of its cases to testing."""
    fit = ids.agg(F.min(length).alias("__lo"), F.max(length).alias("__hi"))
    d = ids.crossJoin(F.broadcast(fit)).withColumn("bin", F.floor((F.col(length) - F.col("__lo")) * bins / (F.col("__hi") + 1 - F.col("__lo"))))
    take = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(float(test))))
    return ranked(d, key, ["bin"], seed).withColumn("split", F.when(F.col("__r") <= take, "test").otherwise("train")).drop("__lo", "__hi", "__r", "__n")


def shards(df: DataFrame, part: list[str], order: str, size: int) -> DataFrame:
    """Shards of ``size`` rows in the order of a number or time within each part."""
    return positions(df, part, ranges(df, order), [order]).withColumn("shard_idx", F.floor((F.col("__r") - 1) / size)).drop("__r", "__n")


def manifest(sharded: DataFrame, part: list[str], size: int) -> DataFrame:
    return sharded.groupBy(*part).agg(F.count_distinct("shard_idx").alias("num_shards"), F.count("*").alias("total")).withColumn("shard_size", F.lit(size).cast("bigint"))


def epoch_order(sharded: DataFrame, part: list[str], key: str, epoch: int, workers: int, seed: str = "0") -> DataFrame:
    """Adds worker, turn and place: the shards of a part are permuted by seed and epoch, worker w takes every ``workers``-th of
    them from the w-th on, in turns, and the rows of a shard are permuted by seed, epoch and worker. The table of shards is
    permuted by itself; rows are dealt by shard once and sorted there, and never ranked over the whole."""
    by = [*part, "shard_idx"]
    at = F.row_number().over(Window.partitionBy(*part).orderBy(F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col("shard_idx").cast("string")).cast("binary")), "shard_idx")) - 1
    order = sharded.select(*by).distinct().withColumn("__at", at)
    order = order.select(*by, (F.col("__at") % workers).alias("worker"), F.floor(F.col("__at") / workers).alias("turn"))
    mixed = F.md5(F.concat_ws(":", F.lit(seed), F.lit(str(epoch)), F.col("worker").cast("string"), F.col(key).cast("string")).cast("binary"))
    return sharded.join(order, by).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(mixed, key)))


#: What a shard has at least, so that a folder does not fill with small files.
LEAST = 15_000


def write_shards(df: DataFrame, path: str, part: str, order: str, size: int, least: int = LEAST) -> dict[str, dict]:
    """Writes each part, a split, as a folder of shards of max(``least``, ``size``) rows in the order of ``order``, with a
    ``manifest.json`` of num_shards, shard_size and total. Everything is written beside and renamed, the manifests last, so a
    part either has all of its shards and a manifest or is what it was. Returns the manifests."""
    spark, size = df.sparkSession, max(least, size)
    new = files.beside(spark, path)
    sharded = shards(df, [part], order, size)
    sharded.repartition(part, "shard_idx").sortWithinPartitions(part, "shard_idx", order).write.partitionBy(part, "shard_idx").parquet(new)
    written = spark.read.parquet(new).groupBy(part).agg(F.count_distinct("shard_idx").alias("n"), F.count("*").alias("total"))
    out = {str(r[part]): {"num_shards": r["n"], "shard_size": size, "total": r["total"]} for r in written.collect()}  # a row for each split
    for name, facts in out.items():
        files.replace(spark, f"{new}/{part}={name}", f"{path}/{name}")
        files.publish(spark, f"{path}/{name}/manifest.json", json.dumps(facts))
    files.delete(spark, new)
    return out
