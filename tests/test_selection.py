"""Ranges by quantiles, exact quantiles, joins with overlapping ranges, shuffles of shards and their files."""

import numpy as np
import pytest
from plystream.operators import intervals, quantiles, split
from plystream.sources import files, listed
from pyspark.sql import functions as F


def cells(df, **how):
    return sorted((r.c, r.n, r.lo, r.hi) for r in df.withColumn("c", split.ranges(df, "x", **how)).groupBy("c").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())


def test_ranges_hold_equally_many_rows_beside_an_outlier(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") == 7, F.lit(10**18)).otherwise(F.col("id")).alias("x"))
    found = cells(df, cells=100)
    assert len(found) == 100 and max(n for _, n, *_ in found) < 500
    assert all(a[3] < b[2] for a, b in zip(found, found[1:], strict=False))  # in order


def test_equal_keys_and_nulls_are_dealt(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 < 9, 5).otherwise(F.col("id")).alias("x"))
    found = cells(df, cells=100)
    assert max(n for _, n, *_ in found) < 700 and all(a[3] <= b[2] for a, b in zip(found, found[1:], strict=False))
    nulls = cells(df.withColumn("x", F.lit(None).cast("long")))
    assert len(nulls) > 32 and max(c for c, *_ in nulls) == -1


def test_shards_are_in_order_whatever_the_keys(spark):
    df = spark.range(5000).select("id", (F.col("id") % 2).alias("part"), F.when(F.col("id") % 10 < 9, F.col("id") % 3).otherwise(F.when(F.col("id") == 9, F.lit(10**18)).otherwise(-F.col("id"))).alias("x"))
    got = split.shards(df, ["part"], "x", 100).toPandas()
    for _, rows in got.groupby("part"):
        assert sorted(rows.shard_idx.value_counts()) == [100] * 25
        by = rows.groupby("shard_idx").x.agg(["min", "max"]).sort_index()
        assert (by["max"].values[:-1] <= by["min"].values[1:]).all()


def test_epochs_permute_shards_and_rows(spark):
    sharded = split.shards(spark.range(1000).withColumn("part", F.lit("a")), ["part"], "id", 50)
    one, again, two = ({(r.worker, r.turn, r.place): r.id for r in split.epoch_order(sharded, ["part"], "id", e, 3).collect()} for e in (1, 1, 2))
    assert one == again != two and sorted(one.values()) == list(range(1000))
    assert {w for w, *_ in one} == {0, 1, 2}
    for w in range(3):  # a worker reads whole shards, one after the other
        turns = sorted({t for v, t, _ in one if v == w})
        assert turns == list(range(len(turns)))
        for t in turns:
            rows = [one[w, t, p] for p in range(1, 51)]
            assert len({i // 50 for i in rows}) == 1 and rows != sorted(rows)


@pytest.mark.parametrize("few", [3, 100, 10**6])
def test_quantiles_are_exact(spark, few):
    rng = np.random.default_rng(1)
    probabilities = [0.0, 0.001, 0.25, 0.5, 0.77, 1.0]
    for x in (rng.standard_normal(4000), np.repeat([1.0, 2.0, 5.0], [3000, 1, 999]), np.append(rng.integers(0, 5, 3000), [1e18, -1e18]), np.array([4.0]), np.exp(rng.standard_normal(3001) * 20)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(4)
        assert quantiles.exact(df, "x", probabilities, few=few, sharp=200) == pytest.approx(list(np.quantile(x, probabilities)), rel=1e-12)
    assert quantiles.exact(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]


def test_overlapping_ranges(spark):
    rng = np.random.default_rng(2)
    values = [(int(i), float(v)) for i, v in enumerate(np.concatenate([rng.uniform(-50, 50, 300), rng.integers(-50, 50, 300), np.full(300, 7.0)]))] + [(900, None), (901, 1e12), (902, -1e12)]
    ranges = [(k, float(lo), float(lo + w)) for k, (lo, w) in enumerate(zip(rng.integers(-60, 60, 40), rng.choice([0.25, 1, 3, 4, 17, 64, 1000, 1e13], 40), strict=True))] + [(50, 7.0, 7.0), (51, 9.0, 3.0)]
    df, r = spark.createDataFrame(values, "id long, v double").repartition(3), spark.createDataFrame(ranges, "k int, lo double, hi double")
    hits = {(i, k) for i, v in values for k, lo, hi in ranges if v is not None and lo <= v < hi}
    assert {(x.id, x.k) for x in intervals.all_ranges(df, "v", r).collect()} == hits
    assert intervals.all_ranges(df, "v", r).count() == len(hits)
    first = {x.id: x.k for x in intervals.first_range(df, "v", r, "k").collect()}
    assert first == {i: min((k for j, k in hits if j == i), default=None) for i, _ in values}
    assert [x.k for x in intervals.first_range(df, "v", r.limit(0), "k").limit(3).collect()] == [None] * 3
    plan = intervals.all_ranges(df, "v", r)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ranges_are_counted_without_pairs(spark):
    rng = np.random.default_rng(4)
    values = [(i, float(v)) for i, v in enumerate(np.concatenate([rng.uniform(-50, 50, 300), rng.integers(-50, 50, 300), np.full(300, 7.0)]))] + [(900, None), (901, 1e300), (902, -1e12), (903, float("nan")), (904, float("inf"))]
    ranges = [(k, float(lo), float(lo + w)) for k, (lo, w) in enumerate(zip(rng.integers(-60, 60, 200), rng.choice([5e-324, 0.25, 1, 3, 4, 17, 64, 1000, 1e13], 200), strict=True))] + [(500, 7.0, 7.0), (501, 9.0, 3.0), (502, None, 3.0), (503, 0.0, 5e-324)]
    whole = [(i, int(v * 10**16)) for i, v in values if v is not None and abs(v) < 100] + [(950, 2**63 - 1), (951, -(2**63))]
    wide = [(k, int(lo * 10**16), int(lo * 10**16) + w) for k, (lo, w) in enumerate(zip(rng.integers(-50, 50, 200), [1, 2, 3, 5, 10**15, 10**16, 10**18, 3 * 10**18] * 25, strict=True))] + [(500, -(2**63), 2**63 - 1), (501, 2**63 - 2, 2**63 - 1)]
    for v, r, kind in ((values, ranges, "double"), (whole, wide, "long")):
        df, many = spark.createDataFrame(v, f"id long, v {kind}").repartition(3), spark.createDataFrame(r + r[:9], f"k int, lo {kind}, hi {kind}")
        got = sorted((x.k, x.n, x.least) for x in intervals.range_counts(df, "v", many, "id").collect())
        held = [(k, [i for i, x in v if x is not None and lo <= x < hi]) for k, lo, hi in r + r[:9] if lo is not None]
        assert got == sorted((k, len(h), min(h)) for k, h in held if h)
        first = {x.id: x.k for x in intervals.first_range(df, "v", many, "k").collect()}
        assert first == {i: min((k for k, h in held if i in h), default=None) for i, _ in v}
    assert intervals.range_counts(df, "v", many.limit(0), "id").count() == 0
    # two thousand ranges that all hold two thousand values: nothing makes their pairs
    df, many = spark.range(2000).selectExpr("id", "id as v"), spark.range(2000).selectExpr("id as k", "-id as lo", "2000 + id as hi")
    found = intervals.range_counts(df, "v", many, "id")
    assert found.groupBy("n", "least").count().collect() == [(2000, 0, 2000)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "NestedLoop" not in plan  # of ranges with what was counted for them
    found = intervals.first_range(df, "v", many, "k")
    assert found.groupBy("k").count().collect() == [(0, 2000)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "NestedLoop" not in plan  # of rows with what was found for them


def test_shard_files(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "train").otherwise("test").alias("split"))
    path = f"{tmp_path}/shards"
    assert split.write_shards(df, path, "split", "id", 100, least=150) == {"train": {"num_shards": 5, "shard_size": 150, "total": 700}, "test": {"num_shards": 2, "shard_size": 150, "total": 300}}
    assert listed.manifest(spark, f"{path}/train")["total"] == 700
    got = spark.read.option("pathGlobFilter", "*.parquet").parquet(f"{path}/train").groupBy("shard_idx").agg(F.count("*").alias("n"), F.min("id").alias("lo")).orderBy("shard_idx").collect()
    assert [(r.n, r.lo) for r in got] == [(150, 0), (150, 150), (150, 300), (150, 450), (100, 600)]
    split.write_shards(df.where("id < 10"), path, "split", "id", 100)  # the parts that it has are replaced, at the least size
    assert listed.manifest(spark, f"{path}/train") == {"num_shards": 1, "shard_size": 15000, "total": 10} and listed.manifest(spark, f"{path}/test")["total"] == 300
    assert files.names(spark, path) == ["test", "train"] and files.names(spark, str(tmp_path)) == ["shards"]
