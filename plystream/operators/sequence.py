"""Labels, time differences, windows and edges of ordered event logs. Each takes the case and order columns explicitly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EOS = "EOS"


def _w(case: str, *order: str):
    return Window.partitionBy(case).orderBy(*order)


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sorted_vocabulary(df: DataFrame, event: str, extra: tuple[str, ...] = (EOS,)) -> DataFrame:
    """(token, id) by code point; extra tokens sort among the others. A small table, ranked after ``distinct``."""
    tokens = df.select(F.col(event).cast("string").alias("token")).where("token is not null")
    for t in extra:
        tokens = tokens.unionAll(df.sparkSession.createDataFrame([(t,)], "token string"))
    return tokens.distinct().withColumn("id", (F.row_number().over(Window.orderBy("token")) - 1).cast("bigint"))


def first_seen_vocabulary(df: DataFrame, event: str, order: str) -> DataFrame:
    seen = df.where(F.col(event).isNotNull()).groupBy(F.col(event).alias("token")).agg(F.min(order).alias("at"))
    return seen.select("token", (F.row_number().over(Window.orderBy("at")) - 1).cast("bigint").alias("id"))


def next_event(df: DataFrame, case: str, order: str, event: str, end: str = EOS) -> DataFrame:
    return df.withColumn("next_event", F.lead(event, 1, end).over(_w(case, order)))


def time_deltas(df: DataFrame, case: str, order: str, ts: str) -> DataFrame:
    """Seconds to the next event of the case, by time and then order; null for the last."""
    return df.withColumn("delta_s", (F.lead(micros(ts)).over(_w(case, ts, order)) - micros(ts)) / 1e6)


def scaled(df: DataFrame, value: str, out: str) -> DataFrame:
    """Min-max scaling over the whole table; constants give 0. The one-row fit is aggregated, then broadcast."""
    fit = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    x = F.when(F.col("__hi") > F.col("__lo"), (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.when(F.col(value).isNotNull(), 0.0))
    return df.crossJoin(F.broadcast(fit)).withColumn(out, x).drop("__lo", "__hi")


def node_times(df: DataFrame, case: str, order: str, ts: str) -> DataFrame:
    """Whole seconds to the case's last event, divided by their maximum; the last event itself is dropped."""
    whole = Window.partitionBy(case)
    t = F.floor(micros(ts) / 1_000_000)
    d = df.withColumn("__t", t).withColumn("seconds", (F.max("__t").over(whole) - F.col("__t")).cast("double"))
    d = d.withColumn("__n", F.row_number().over(_w(case, ts, order))).withColumn("__last", F.count("*").over(whole)).where("__n < __last")
    return d.withColumn("node_time", F.col("seconds") / (F.max("seconds").over(whole) + 1e-8)).drop("__t", "__n", "__last")


def fill_times(df: DataFrame, case: str, order: str, ts: str) -> DataFrame:
    """Missing times: the last one before, else the first one after, else the epoch."""
    before = F.last(ts, ignorenulls=True).over(_w(case, order).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(ts, ignorenulls=True).over(_w(case, order).rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(ts, F.coalesce(before, after, F.timestamp_seconds(F.lit(0)).cast(df.schema[ts].dataType)))


def transitions(df: DataFrame, case: str, order: str, status: str) -> DataFrame:
    return df.withColumn("transition", F.concat(F.col(status), F.lit("→"), F.lead(status).over(_w(case, order)))).where("transition is not null")


def prefix_windows(df: DataFrame, case: str, order: str, event: str, k: int, end: str = EOS) -> DataFrame:
    """Every window of k events in a case and the event that follows it."""
    w = _w(case, order)
    out = df.withColumn("prefix", F.collect_list(event).over(w.rowsBetween(0, k - 1))).withColumn("target", F.lead(event, k, end).over(w))
    return out.where(F.size("prefix") == k)


def chain_edges(df: DataFrame, case: str, order: str) -> DataFrame:
    w = _w(case, order)
    src = (F.row_number().over(w) - 1).cast("bigint")
    return df.withColumn("src", src).withColumn("dst", F.when(F.lead(order).over(w).isNotNull(), src + 1)).where("dst is not null")


def case_first(df: DataFrame, case: str, order: str, *columns: str) -> DataFrame:
    """The first value that is not null, column by column."""
    return df.groupBy(case).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def case_last(df: DataFrame, case: str, order: str, *columns: str) -> DataFrame:
    return df.groupBy(case).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def chain_graphs(df: DataFrame, case: str, order: str, label: str, delta: str) -> DataFrame:
    """One row for each case: node labels in order, edges from each node to the next and their time differences."""
    g = df.groupBy(case).agg(F.sort_array(F.collect_list(F.struct(order, label, delta))).alias("n"))
    ids = F.transform("n", lambda x: x[label])
    return g.select(case, ids.alias("event_ids"), F.sequence(F.lit(0), F.size("n") - 2).alias("src"), F.slice(F.transform("n", lambda x: x[delta]), F.lit(1), F.size("n") - 1).alias("edge_time"),
                    F.size("n").cast("bigint").alias("num_nodes")).withColumn("src", F.when(F.col("num_nodes") > 1, F.col("src")).otherwise(F.array().cast("array<int>")))
