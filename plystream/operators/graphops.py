"""Operators on graph and score tables: pooling, norms, attention, masked choices, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_pool(nodes: DataFrame, graph: str, value: str) -> DataFrame:
    return nodes.groupBy(graph).agg(F.avg(value).alias("pooled"))


def graph_norm(nodes: DataFrame, graph: str, value: str, eps: float = 1e-5) -> DataFrame:
    """Centred and divided by the root of the biased variance, graph by graph."""
    w = Window.partitionBy(graph)
    return nodes.withColumn("normed", (F.col(value) - F.avg(value).over(w)) / F.sqrt(F.var_pop(value).over(w) + eps))


def decay_attention(edges: DataFrame, dst: str, logit: str, time: str, rate: float) -> DataFrame:
    """Softmax over each destination's edges of logits times exp(-rate time), the exponent held within 30."""
    w = Window.partitionBy(dst)
    x = F.col(logit) * F.exp(F.greatest(F.least(F.lit(-float(rate)) * F.col(time), F.lit(30.0)), F.lit(-30.0)))
    e = edges.withColumn("__x", x).withColumn("__e", F.exp(F.col("__x") - F.max("__x").over(w)))
    return e.withColumn("alpha", F.col("__e") / F.sum("__e").over(w)).drop("__x", "__e")


def masked_argmax(scores: Column, allowed: Column) -> Column:
    """The allowed id, from 0, with the largest score; ties go to the lower id; null if none is allowed."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    return F.array_min(F.filter(pairs, lambda p: F.array_contains(allowed, p["i"])))["i"]


def cross_entropy(scores: Column, target: Column) -> Column:
    top = F.array_max(scores)
    return top + F.ln(F.aggregate(F.transform(scores, lambda s: F.exp(s - top)), F.lit(0.0), lambda a, x: a + x)) - F.element_at(scores, (target + 1).cast("int"))


def learning_rate(step: Column, warm: int, total: int, base: float) -> Column:
    """Linear warm-up, then half a cosine."""
    return F.when(step < warm, F.lit(base) * step / max(1, warm)).otherwise(
        F.lit(base) * 0.5 * (1 + F.cos(F.pi() * F.least((step - warm) / F.lit(float(max(1, total - warm))), F.lit(1.0)))))
