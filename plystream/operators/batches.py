"""Assembly of graphs, features and batches: what a model takes as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def features(onehot: list[Column], scaled: list[Column]) -> Column:
    """One array: indicators, then scaled numbers."""
    return F.array(*[c.cast("double") for c in [*onehot, *scaled]])


def in_order(order: str, *columns: str) -> Column:
    """An aggregate: the case's rows as an array of structs in order. A case is one row of the result, so it must fit one."""
    return F.sort_array(F.collect_list(F.struct(order, *columns)))


def core_graphs(df: DataFrame, case: str, order: str, label: str, time: str) -> DataFrame:
    """Node labels and node times of each case."""
    g = df.groupBy(case).agg(in_order(order, label, time).alias("n"))
    return g.select(case, F.transform("n", lambda x: x[label]).alias("event_ids"), F.transform("n", lambda x: x[time]).alias("node_times"), F.size("n").cast("bigint").alias("num_nodes"))


def status_graphs(edges: DataFrame, case: str, order: str, kind: str, delta: str) -> DataFrame:
    """Edges of each case with two attributes, their type and their time difference."""
    g = edges.groupBy(case).agg(in_order(order, kind, delta).alias("e"))
    return g.select(case, F.transform("e", lambda x: x[kind]).alias("edge_types"), F.transform("e", lambda x: x[delta]).alias("edge_times"), F.size("e").cast("bigint").alias("num_edges"))


def prefix_graphs(df: DataFrame, case: str, order: str, label: str, delta: str, k: int, aligned: bool = True) -> DataFrame:
    """A graph for each window of k events, with the k - 1 differences between them, or, if not ``aligned``, with the first
    k - 1 differences of the case in every window."""
    w = Window.partitionBy(case).orderBy(order)
    g = df.withColumn("event_ids", F.collect_list(label).over(w.rowsBetween(0, k - 1)))
    times = F.collect_list(F.coalesce(delta, F.lit(0.0)))
    g = g.withColumn("edge_times", times.over(w.rowsBetween(0, k - 2)) if aligned else F.slice(times.over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 1, k - 1))
    return g.where(F.size("event_ids") == k)


def trimmed_labels(df: DataFrame, case: str, order: str, label: str, feature: str, missing: float = -1.0) -> DataFrame:
    """The case's first labels, as many as its rows whose feature is not missing."""
    g = df.groupBy(case).agg(in_order(order, label).alias("n"), F.count_if(F.col(feature) != missing).alias("n_valid"))
    return g.select(case, "n_valid", F.slice(F.transform("n", lambda x: x[label]), F.lit(1), F.col("n_valid").cast("int")).alias("labels"))


def collate(cases: DataFrame, batch: str, labels: str, value: int = -1) -> DataFrame:
    """Pads each array to the longest of its batch."""
    longest = cases.groupBy(batch).agg(F.max(F.size(labels)).alias("__longest"))
    fill = F.array_repeat(F.lit(value), F.col("__longest") - F.size(labels)).cast(cases.schema[labels].dataType)
    return cases.join(longest, batch).withColumn(labels, F.concat(labels, fill)).drop("__longest")


def reindex(edges: DataFrame, graph: str, src: str, dst: str) -> DataFrame:
    """Node ids counted from 0 within each graph, by their old order; both ends are replaced. Both ends of an edge are rows
    for the ranking and meet again by a sort in the same exchange: no table of a task's edges is kept in memory, and sorts spill."""
    rest = [c for c in edges.columns if c not in (graph, src, dst)]
    numbered = edges.withColumn("__e", F.monotonically_increasing_id())
    nodes = F.array(F.col(src), F.col(dst))
    long = numbered.select(graph, "__e", *rest, F.posexplode(nodes).alias("__end", "__node"))
    ranked = long.select(graph, "__e", *rest, "__end", (F.dense_rank().over(Window.partitionBy(graph).orderBy("__node")) - 1).cast("bigint").alias("__i"))
    other = F.lead("__i").over(Window.partitionBy(graph).orderBy("__e", "__end"))
    return ranked.withColumn(dst, other).where("__end = 0").select(graph, *rest, F.col("__i").alias(src), dst)


def minmax_window(df: DataFrame, graph: str, value: str, out: str, eps: float = 1e-8) -> DataFrame:
    w = Window.partitionBy(graph)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, (F.col(value) - lo) / (hi - lo + eps))


def edge_time(kind: Column, time: Column) -> Column:
    """Times of attacks (1) and pins (2) count half, all others whole."""
    return time * F.when(kind.isin(1, 2), 0.5).otherwise(1.0)


def pack_legal(scores: Column, legal: Column, target: Column) -> tuple[Column, Column]:
    """Scores of the legal ids in id order, and the target's place among them. No legal id, or a target that is none, is an error."""
    ids = F.array_sort(legal)
    at = F.array_position(ids, target)
    ok = F.when(F.size(ids) == 0, F.raise_error(F.lit("no legal id"))).when(at == 0, F.raise_error(F.lit("the target is not legal"))).otherwise(at - 1)
    return F.transform(ids, lambda i: F.get(scores, i.cast("int"))), ok.cast("bigint")


def byte(c: Column) -> Column:
    """0 to 255 in a small integer; anything else is an error."""
    return F.when(c.between(0, 255), c.cast("smallint")).when(c.isNotNull(), F.raise_error(F.concat(F.lit("not a byte: "), c.cast("string"))).cast("smallint"))


def with_end(features: Column) -> Column:
    """An array of feature arrays with one more for the end, all 0."""
    width = F.coalesce(F.size(F.get(features, F.lit(0))), F.lit(0))
    return F.when(F.size(features) > 0, F.concat(features, F.array(F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0))))).otherwise(features)


def binary(c: Column) -> Column:
    """An array of 0 and 1 as booleans; anything else is an error."""
    return F.transform(c, lambda x: F.when(x.isin(0, 1), x == 1).when(x.isNotNull(), F.raise_error(F.concat(F.lit("not binary: "), x.cast("string"))).cast("boolean")))


def time_of_types(edges: Column, tolerance: float = 1e-5) -> Column:
    """A map from type to time of an array of (type, time): times of a type have to be equal, or else it is an error."""
    kinds = F.array_sort(F.array_distinct(F.transform(edges, lambda e: e["type"])))

    def one(kind: Column) -> Column:
        times = F.transform(F.filter(edges, lambda e: e["type"] == kind), lambda e: e["time"])
        same = F.array_max(times) - F.array_min(times) <= tolerance
        return F.when(same, F.get(times, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("times differ in type "), kind.cast("string"))).cast("double"))

    return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k.alias("key"), one(k).alias("value"))))


def times_back(edges: Column, times: Column) -> Column:
    """The times of edges from the map of their types."""
    return F.transform(edges, lambda e: F.element_at(times, e["type"]))
