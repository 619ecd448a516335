"""Connected components by alternating large-star and small-star rounds, each a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plystream.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Returns (node, component) for every node of ``edges``; component is the smallest node reachable.

    Loops and repeated edges do no harm; rows with a null end are left out; no edges give no rows. The minimum of a node's
    neighbours is aggregated map-side before the join, and AQE, which has to be on, splits the joins' skewed partitions, so
    a star of any size is no single task. Each round is written to the shared folder, and the one before deleted.
    """
    pairs = staged(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null"), "cc-edges")
    nodes = pairs.select("u").unionAll(pairs.select(F.col("v").alias("u"))).distinct()
    now = staged(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        now = staged(_small_star(_large_star(now)), "cc", instead_of=now)
        mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
