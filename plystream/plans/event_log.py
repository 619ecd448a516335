"""Queries on the event log: labels, times, windows, graphs, encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from plystream.operators import encode, guards, sequence
from plystream.plans.registry import query
from plystream.plans.sources import events, table

R = lambda c, n=8: F.round(c, n)
DELTA = "(epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts)) / 1e6"
VOCAB = "(select t, row_number() over (order by t) - 1 as id from (select distinct event_type as t from events union select 'EOS'))"


@query("graph_ready", f"""with e as (select event_id, user_id, event_type, lead(event_type, 1, 'EOS') over (partition by user_id order by event_id) as nxt, {DELTA} as d from events),
m as (select min(d) as lo, max(d) as hi from e)
select event_id, user_id, a.id as label, b.id as next_label, d as delta_s, round((d - lo) / (hi - lo), 8) as delta_scaled
from e cross join m join {VOCAB} a on a.t = event_type join {VOCAB} b on b.t = nxt""")
def graph_ready(spark, sf):
    e = sequence.next_event(events(spark, sf), "user_id", "event_id", "event_type")
    e = sequence.scaled(sequence.time_deltas(e, "user_id", "event_id", "ts"), "delta_s", "delta_scaled")
    v = sequence.sorted_vocabulary(events(spark, sf), "event_type")
    e = encode.look_up(encode.look_up(e, v, "event_type", "label"), v, "next_event", "next_label")
    return e.select("event_id", "user_id", "label", "next_label", "delta_s", R(F.col("delta_scaled")).alias("delta_scaled"))


@query("next_event_label", "select event_id, lead(event_type, 1, 'EOS') over (partition by user_id order by event_id) as next_event from events")
def next_event_label(spark, sf):
    return sequence.next_event(events(spark, sf), "user_id", "event_id", "event_type").select("event_id", "next_event")


@query("time_deltas", f"select event_id, {DELTA} as delta_s from events")
def time_deltas(spark, sf):
    return sequence.time_deltas(events(spark, sf), "user_id", "event_id", "ts").select("event_id", "delta_s")


@query("time_deltas_scaled", f"""with e as (select event_id, {DELTA} as d from events), m as (select min(d) as lo, max(d) as hi from e)
select event_id, round((d - lo) / (hi - lo), 8) as delta_scaled from e cross join m""")
def time_deltas_scaled(spark, sf):
    e = sequence.scaled(sequence.time_deltas(events(spark, sf), "user_id", "event_id", "ts"), "delta_s", "delta_scaled")
    return e.select("event_id", R(F.col("delta_scaled")).alias("delta_scaled"))


@query("node_times", """with e as (select event_id, user_id, cast(floor(epoch_us(ts) / 1000000.0) as bigint) as t, row_number() over (partition by user_id order by ts, event_id) as n, count(*) over (partition by user_id) as c from events),
f as (select event_id, user_id, n, c, cast(max(t) over (partition by user_id) - t as double) as s from e),
g as (select * from f where n < c)
select event_id, s as seconds, round(s / (max(s) over (partition by user_id) + 1e-8), 8) as node_time from g""")
def node_times(spark, sf):
    d = sequence.node_times(events(spark, sf), "user_id", "event_id", "ts")
    return d.select("event_id", "seconds", R(F.col("node_time")).alias("node_time"))


@query("time_fill", """with e as (select event_id, user_id, case when event_id % 3 = 0 or user_id % 11 = 0 then null else ts end as ts from events)
select event_id, epoch_us(coalesce(last_value(ts ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row),
  first_value(ts ignore nulls) over (partition by user_id order by event_id rows between current row and unbounded following), timestamp '1970-01-01')) as us from e""")
def time_fill(spark, sf):
    e = events(spark, sf).withColumn("ts", F.when(~((F.col("event_id") % 3 == 0) | (F.col("user_id") % 11 == 0)), F.col("ts")))
    return sequence.fill_times(e, "user_id", "event_id", "ts").select("event_id", sequence.micros("ts").alias("us"))


@query("status_transitions", """with e as (select event_id, event_type || '→' || lead(event_type) over (partition by user_id order by event_id) as tr from events),
v as (select tr, row_number() over (order by tr) - 1 as id from (select distinct tr from e where tr is not null))
select event_id, tr as transition, id as transition_id from e join v using (tr)""")
def status_transitions(spark, sf):
    t = sequence.transitions(events(spark, sf), "user_id", "event_id", "event_type")
    v = sequence.sorted_vocabulary(t, "transition", ())
    return encode.look_up(t, v, "transition", "transition_id").select("event_id", "transition", "transition_id")


@query("prefix_windows", """with e as (select event_id, row_number() over (partition by user_id order by event_id) as n, count(*) over (partition by user_id) as c,
  event_type || '|' || lead(event_type, 1) over w || '|' || lead(event_type, 2) over w as prefix, lead(event_type, 3, 'EOS') over w as target
  from events window w as (partition by user_id order by event_id))
select event_id, prefix, target from e where n <= c - 2""")
def prefix_windows(spark, sf):
    return sequence.prefix_windows(events(spark, sf), "user_id", "event_id", "event_type", 3).select("event_id", F.array_join("prefix", "|").alias("prefix"), "target")


@query("prefix_sequence_rows", "select event_id from (select event_id, row_number() over (partition by user_id order by event_id) as n from events) where n >= 3")
def prefix_sequence_rows(spark, sf):
    n = F.row_number().over(sequence._w("user_id", "event_id"))
    return events(spark, sf).withColumn("n", n).where("n >= 3").select("event_id")


@query("chain_edges", """select user_id, n - 1 as src, n as dst from (select user_id, row_number() over (partition by user_id order by event_id) as n, count(*) over (partition by user_id) as c from events) where n < c""")
def chain_edges(spark, sf):
    return sequence.chain_edges(events(spark, sf), "user_id", "event_id").select("user_id", "src", "dst")


@query("graph_timediff", f"""with e as (select user_id, event_id, event_type, {DELTA} as d from events)
select user_id, string_agg(event_type, ',' order by event_id) as event_ids, count(*) as num_nodes, count(*) - 1 as num_edges, round(sum(d), 6) as total_time from e group by user_id""")
def graph_timediff(spark, sf):
    e = sequence.time_deltas(events(spark, sf), "user_id", "event_id", "ts")
    g = sequence.chain_graphs(e, "user_id", "event_id", "event_type", "delta_s")
    return g.select("user_id", F.array_join("event_ids", ",").alias("event_ids"), "num_nodes", F.size("src").cast("bigint").alias("num_edges"),
                    R(F.aggregate("edge_time", F.lit(0.0), lambda a, x: a + x), 6).alias("total_time"))


FIRSTS = "case when event_id % 4 = 0 then null else event_type end"


@query("case_first", f"""with e as (select user_id, event_id, {FIRSTS} as a, case when event_id % 3 = 0 then null else value end as b from events)
select user_id, arg_min(a, event_id) filter (a is not null) as a, arg_min(b, event_id) filter (b is not null) as b from e group by user_id""")
def case_first(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", F.expr(FIRSTS).alias("a"), F.expr("case when event_id % 3 = 0 then null else value end").alias("b"))
    return sequence.case_first(e, "user_id", "event_id", "a", "b")


@query("outcome_labels", """with o as (select o_custkey, arg_max(o_orderstatus, o_orderkey) filter (o_orderstatus is not null and o_orderkey % 5 <> 0) as outcome from orders group by o_custkey)
select o_custkey, outcome, dense_rank() over (order by outcome) - 1 as outcome_id from o where outcome is not null""")
def outcome_labels(spark, sf):
    o = table(spark, sf, "orders").withColumn("s", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")))
    o = sequence.case_last(o, "o_custkey", "o_orderkey", "s").where("s is not null")
    v = sequence.sorted_vocabulary(o, "s", ())
    return encode.look_up(o, v, "s", "outcome_id").select("o_custkey", F.col("s").alias("outcome"), "outcome_id")


@query("label_encode_sorted", f"select event_id, id as label from events join {VOCAB} on t = event_type")
def label_encode_sorted(spark, sf):
    e = events(spark, sf)
    return encode.look_up(e, sequence.sorted_vocabulary(e, "event_type"), "event_type", "label").select("event_id", "label")


@query("label_encode_first_seen", """with v as (select t, row_number() over (order by first_at) - 1 as id from (select event_type as t, min(event_id) as first_at from events where event_id < 500 and event_type <> 'view' group by 1))
select event_id, coalesce(id, -1) as label from events left join v on t = event_type""")
def label_encode_first_seen(spark, sf):
    e = events(spark, sf)
    v = sequence.first_seen_vocabulary(e.where("event_id < 500 and event_type <> 'view'"), "event_type", "event_id")
    return encode.look_up(e, v, "event_type", "label").select("event_id", "label")


HOLES = "case when event_id % 7 = 0 then -1 when event_id % 5 = 0 then null else value end"


@query("minmax_masked", f"""with e as (select event_id, cast({HOLES} as double) as v from events), m as (select min(v) as lo, max(v) as hi from e where v <> -1)
select event_id, round(case when v is null or v = -1 then -1.0 when hi > lo then (v - lo) / (hi - lo) else 0.0 end, 8) as x from e cross join m""")
def minmax_masked(spark, sf):
    e = events(spark, sf).withColumn("v", F.expr(HOLES).cast("double"))
    return encode.minmax_masked(e, "v", "x").select("event_id", R(F.col("x")).alias("x"))


@query("minmax_median", f"""with e as (select event_id, cast(case when event_id % 5 = 0 then null else value end as double) as v from events), m as (select median(v) as md, min(v) as lo, max(v) as hi from e)
select event_id, round((coalesce(v, md) - lo) / (hi - lo), 8) as x from e cross join m""")
def minmax_median(spark, sf):
    e = events(spark, sf).withColumn("v", F.expr("case when event_id % 5 = 0 then null else value end").cast("double"))
    return encode.minmax_median(e, "v", "x").select("event_id", R(F.col("x")).alias("x"))


MISSING = "case when event_id % 6 = 0 then '<NO_DESC>' else event_type end"


@query("onehot_masked", f"""with e as (select event_id, {MISSING} as c from events)
select event_id, {", ".join(f"case when c = '<NO_DESC>' then -1 when c = '{k}' then 1 else 0 end as is_{k}" for k in ("click", "view"))} from e""")
def onehot_masked(spark, sf):
    return events(spark, sf).select("event_id", *encode.onehot_masked(F.expr(MISSING), ["click", "view"]))


@query("onehot", "select event_id, cast(event_type = 'click' as int) as is_click, cast(event_type = 'nothing' as int) as is_nothing from events")
def onehot(spark, sf):
    return events(spark, sf).select("event_id", *encode.onehot(F.col("event_type"), ["click", "nothing"]))


@query("pad_sequences", """with e as (select conv_id, list(length(text) order by turn) as n from conversations group by conv_id)
select conv_id, array_to_string(list_concat(n[1:4], [-1 for x in range(4 - least(4, len(n)))]), ',') as padded from e""")
def pad_sequences(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.char_length("text").alias("n")))).alias("t"))
    x = encode.pad(F.transform("t", lambda t: t["n"].cast("double")), 4)
    return c.select("conv_id", F.array_join(F.transform(x, lambda v: v.cast("int").cast("string")), ",").alias("padded"))


@query("filter_case_min_events", "select conv_id, turn from conversations where conv_id in (select conv_id from conversations group by 1 having count(*) >= 5)")
def filter_case_min_events(spark, sf):
    c = table(spark, sf, "conversations")
    return c.join(c.groupBy("conv_id").count().where("count >= 5"), "conv_id", "left_semi").select("conv_id", "turn")


@query("dedupe_within_case", """select doc_id from (select doc_id, row_number() over (partition by source, text order by doc_id) as n from documents) where n = 1""")
def dedupe_within_case(spark, sf):
    """Equal texts of a source are told by their digest, so that no text is shuffled."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return d.groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("dedupe_keep_nulls", """with e as (select event_id, case when event_id % 4 = 0 then null else user_id * 10 + event_id % 3 end as k from events)
select event_id from (select event_id, k, row_number() over (partition by k order by event_id) as n from e) where k is null or n = 1""")
def dedupe_keep_nulls(spark, sf):
    e = events(spark, sf).withColumn("k", F.expr("case when event_id % 4 = 0 then null else user_id * 10 + event_id % 3 end"))
    return e.where("k is null").select("event_id").unionAll(e.where("k is not null").groupBy("k").agg(F.min("event_id").alias("event_id")).select("event_id"))


@query("sample_every_k", "select l_orderkey, l_linenumber from lineitem where l_linenumber >= 2 and (l_linenumber - 2) % 2 = 0")
def sample_every_k(spark, sf):
    return table(spark, sf, "lineitem").where("l_linenumber >= 2 and pmod(l_linenumber - 2, 2) = 0").select("l_orderkey", "l_linenumber")


@query("cap_per_case_pre", """select l_orderkey, l_linenumber from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as n from lineitem) where n <= 3 and l_returnflag = 'N'""")
def cap_per_case_pre(spark, sf):
    n = F.row_number().over(sequence._w("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return table(spark, sf, "lineitem").withColumn("n", n).where("n <= 3").where("l_returnflag = 'N'").select("l_orderkey", "l_linenumber")


@query("cap_per_case_post", """select l_orderkey, l_linenumber from (select *, row_number() over (partition by l_orderkey order by l_linenumber) as n from lineitem where l_returnflag = 'N') where n <= 3""")
def cap_per_case_post(spark, sf):
    n = F.row_number().over(sequence._w("l_orderkey", "l_linenumber"))
    return table(spark, sf, "lineitem").where("l_returnflag = 'N'").select("l_orderkey", "l_linenumber").withColumn("n", n).where("n <= 3").select("l_orderkey", "l_linenumber")


@query("union_sources", "select 'a' as source_tag, event_id from events where event_id % 2 = 0 union all select 'b', event_id from events where event_id % 2 = 1")
def union_sources(spark, sf):
    e = events(spark, sf)
    a, b = (e.where(F.col("event_id") % 2 == r).select(F.lit(t).alias("source_tag"), "event_id") for r, t in ((0, "a"), (1, "b")))
    return a.unionByName(b)


@query("merge_latest_wins", "select user_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def merge_latest_wins(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))


@query("json_props", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark, sf):
    return events(spark, sf).select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("first_n_strict", "select event_id, user_id from events order by event_id limit 50")
def first_n_strict(spark, sf):
    return guards.first_n(events(spark, sf).select("event_id", "user_id"), "event_id", 50)


@query("run_counters", "select event_type, user_id % 3 as source, count(*) as n from events group by grouping sets ((event_type), (user_id % 3))")
def run_counters(spark, sf):
    e = events(spark, sf).select("event_type", (F.col("user_id") % 3).alias("source"))
    return e.groupingSets([["event_type"], ["source"]], "event_type", "source").agg(F.count("*").alias("n")).select("event_type", "source", "n")
