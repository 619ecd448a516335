"""Queries on the assembly of graphs, features and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from plystream.operators import batches, encode, guards, sequence, transformer
from plystream.plans.event_log import DELTA, R
from plystream.plans.registry import query
from plystream.plans.sources import events, literals, table

joined = lambda c: F.array_join(c, ",")
total = lambda c, n=6: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), n)


@query("graph_core", """select user_id, string_agg(event_type, ',' order by event_id) as event_ids, sum(event_id % 13)::double as total_time, count(*) as num_nodes from events group by user_id""")
def graph_core(spark, sf):
    e = events(spark, sf).withColumn("t", (F.col("event_id") % 13).cast("double"))
    return batches.core_graphs(e, "user_id", "event_id", "event_type", "t").select("user_id", joined("event_ids").alias("event_ids"), total(F.col("node_times")).alias("total_time"), "num_nodes")


@query("graph_status", f"""with e as (select user_id, event_id, event_type || '→' || lead(event_type) over (partition by user_id order by event_id) as tr, {DELTA} as d from events)
select user_id, string_agg(tr, ',' order by event_id) as edge_types, round(sum(d), 6) as total_time, count(*) as num_edges from e where tr is not null group by user_id""")
def graph_status(spark, sf):
    e = sequence.transitions(sequence.time_deltas(events(spark, sf), "user_id", "event_id", "ts"), "user_id", "event_id", "event_type")
    g = batches.status_graphs(e, "user_id", "event_id", "transition", "delta_s")
    return g.select("user_id", joined("edge_types").alias("edge_types"), total(F.col("edge_times")).alias("total_time"), "num_edges")


@query("graph_prefix", f"""with e as (select user_id, event_id, event_type, {DELTA} as d from events),
w as (select event_id, event_type || ',' || lead(event_type) over x || ',' || lead(event_type, 2) over x as event_ids, d + lead(d) over x as s from e window x as (partition by user_id order by event_id))
select event_id, event_ids, round(s, 6) as total_time from w where event_ids is not null""")
def graph_prefix(spark, sf):
    e = sequence.time_deltas(events(spark, sf), "user_id", "event_id", "ts")
    g = batches.prefix_graphs(e, "user_id", "event_id", "event_type", "delta_s", 3)
    return g.select("event_id", joined("event_ids").alias("event_ids"), total(F.col("edge_times")).alias("total_time"))


@query("event_features", """with m as (select min(value) as lo, max(value) as hi from events)
select event_id, (event_type = 'click')::double as f0, (event_type = 'view')::double as f1, round((value - lo) / (hi - lo), 8) as f2 from events cross join m""")
def event_features(spark, sf):
    e = sequence.scaled(events(spark, sf), "value", "x")
    f = e.select("event_id", batches.features(encode.onehot(F.col("event_type"), ["click", "view"]), [R(F.col("x"))]).alias("f"))
    return f.select("event_id", *[F.col("f")[i].alias(f"f{i}") for i in range(3)])


@query("event_features_end", """select user_id, count(*) + 1 as n, round(sum(value), 6) as total, cast(0 as double) as last from events group by 1""")
def event_features_end(spark, sf):
    """Feature rows of each case with an end row, all 0."""
    g = events(spark, sf).groupBy("user_id").agg(batches.in_order("event_id", "value").alias("r"))
    f = g.select("user_id", batches.with_end(F.transform("r", lambda x: F.array(F.lit(1.0), x["value"]))).alias("f"))
    flat = F.flatten(F.transform("f", lambda x: F.slice(x, 2, 1)))
    return f.select("user_id", F.size("f").cast("bigint").alias("n"), total(flat).alias("total"), F.element_at(F.element_at("f", -1), 1).alias("last"))


@query("compress_types", "select l_orderkey, count(distinct l_linenumber % 3) as types, count(*) as edges, round(sum(l_linenumber % 3 * 2.5::double), 6) as total from lineitem group by 1")
def compress_types(spark, sf):
    """Times that depend on an edge's type alone are kept once for each type, and come back whole."""
    e = F.struct((F.col("l_linenumber") % 3).alias("type"), (F.col("l_linenumber") % 3 * 2.5).alias("time"))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(e).alias("e")).withColumn("m", batches.time_of_types(F.col("e")))
    return g.select("l_orderkey", F.size("m").cast("bigint").alias("types"), F.size("e").cast("bigint").alias("edges"), total(batches.times_back(F.col("e"), F.col("m"))).alias("total"))


@query("total_join_split", """select o_orderkey, case when o_custkey % 10 < 8 then 'train' else 'test' end as split from orders""")
def total_join_split(spark, sf):
    """Every order has to find its customer's split."""
    split = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 10 < 8, "train").otherwise("test").alias("split"))
    return guards.total_join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), split, "o_custkey", "split").select("o_orderkey", "split")


@query("case_features", """with m as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)
select c_custkey, (c_mktsegment = 'BUILDING')::double as f0, round((c_acctbal - lo) / (hi - lo), 8) as f1 from customer cross join m""")
def case_features(spark, sf):
    e = sequence.scaled(table(spark, sf, "customer"), "c_acctbal", "x")
    f = e.select("c_custkey", batches.features(encode.onehot(F.col("c_mktsegment"), ["BUILDING"]), [R(F.col("x"))]).alias("f"))
    return f.select("c_custkey", *[F.col("f")[i].alias(f"f{i}") for i in range(2)])


@query("seq_features_to_events", "select o_orderkey, c_mktsegment, c_acctbal from orders left join customer on c_custkey = o_custkey")
def seq_features_to_events(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").drop("o_custkey")


@query("seq_left_join_deltas", """select c_custkey, coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderkey), '') as keys, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1""")
def seq_left_join_deltas(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    k = F.coalesce("k", F.array().cast("array<bigint>"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", joined(k.cast("array<string>")).alias("keys"), F.size(k).cast("bigint").alias("n"))


@query("labels_trimmed", """with e as (select user_id, list(event_type order by event_id) as l, count(*) filter (event_id % 7 <> 0) as n_valid from events group by 1)
select user_id, n_valid, array_to_string(l[1:n_valid], ',') as labels from e""")
def labels_trimmed(spark, sf):
    e = events(spark, sf).withColumn("f", F.when(F.col("event_id") % 7 == 0, -1.0).otherwise(F.col("value")))
    return batches.trimmed_labels(e, "user_id", "event_id", "event_type", "f").withColumn("labels", joined("labels"))


@query("collate_labels", """with c as (select conv_id, conv_id // 16 as batch, list(turn order by turn) as l from conversations group by conv_id)
select conv_id, batch, array_to_string(l || list_transform(range(m - len(l)), lambda x: -1), ',') as labels from (select *, max(len(l)) over (partition by batch) as m from c)""")
def collate_labels(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("labels")).withColumn("batch", F.floor(F.col("conv_id") / 16))
    return batches.collate(c, "batch", "labels").select("conv_id", "batch", joined(F.col("labels").cast("array<string>")).alias("labels"))


@query("drop_padding", """select conv_id, n - 1 as pos, y from (select conv_id, row_number() over (partition by conv_id order by turn) as n, turn * 2 as y from conversations) where n <= 8""")
def drop_padding(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    padded = encode.pad(F.transform("t", lambda t: (t * 2).cast("double")), 8)
    return c.select("conv_id", F.posexplode(padded).alias("pos", "y")).where("y <> -1").select("conv_id", F.col("pos").cast("bigint").alias("pos"), F.col("y").cast("bigint").alias("y"))


@query("edge_reindex", """with e as materialized (select row_number() over () as e, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem),
v as (select e, l_orderkey, l_linenumber, 's' as kind, l_partkey as v from e union all select e, l_orderkey, l_linenumber, 'd', l_suppkey from e),
i as (select e, l_orderkey, l_linenumber, kind, dense_rank() over (partition by l_orderkey order by v) - 1 as i from v)
select l_orderkey, l_linenumber, max(case when kind = 's' then i end) as src, max(case when kind = 'd' then i end) as dst from i group by e, l_orderkey, l_linenumber""")
def edge_reindex(spark, sf):
    e = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return batches.reindex(e, "l_orderkey", "src", "dst").select("l_orderkey", "l_linenumber", "src", "dst")


@query("minmax_window", """select event_id, round((value - min(value) over w) / (max(value) over w - min(value) over w + 1e-8), 6) as x from events window w as (partition by user_id)""")
def minmax_window(spark, sf):
    return batches.minmax_window(events(spark, sf), "user_id", "value", "x").select("event_id", R(F.col("x"), 6).alias("x"))


@query("edge_time_weight", "select event_id, value * case when event_id % 5 in (1, 2) then 0.5 else 1.0 end as t from events")
def edge_time_weight(spark, sf):
    return events(spark, sf).select("event_id", batches.edge_time(F.col("event_id") % 5, F.col("value")).alias("t"))


LEGAL = "(values (1, 'e2e4', 'd2d4 e2e4', 2, 3), (2, 'a1a2', 'b1b2', 1, null), (3, 'a7a8q', 'a7a8q a7a8r', 3, 4), (4, 'h2h3', '', 2, -1), (5, 'c2c4', 'c2c4', 2, 2)) as t(i, best, legal, n, second)"


@query("filter_target_legal", f"select i from {LEGAL} where list_contains(string_split(legal, ' '), best)")
def filter_target_legal(spark, sf):
    return literals(spark, LEGAL).where(F.array_contains(F.split("legal", " "), F.col("best"))).select("i")


@query("filter_unique_best", f"select i from {LEGAL} where not coalesce(second > 0 and second <= n, false)")
def filter_unique_best(spark, sf):
    return literals(spark, LEGAL).where(~F.coalesce((F.col("second") > 0) & (F.col("second") <= F.col("n")), F.lit(False))).select("i")


@query("pack_legal", """with e as (select vec_id, embedding, label % 8 + 1 as y from embeddings)
select vec_id, round(sum(embedding[j + 2]::double), 5) as total, count(*) as n, y - 1 as target from e, range(8) r(j) group by vec_id, y""")
def pack_legal(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s"), (F.col("label") % 8 + 1).alias("y"))
    scores, target = batches.pack_legal(F.col("s"), F.sequence(F.lit(8), F.lit(1), F.lit(-1)), F.col("y"))
    return e.select("vec_id", scores.alias("p"), target.alias("target")).select("vec_id", total(F.col("p"), 5).alias("total"), F.size("p").cast("bigint").alias("n"), "target")


@query("compress_roundtrip", "select event_id, event_id % 256 as id from events")
def compress_roundtrip(spark, sf):
    e = events(spark, sf).select("event_id", batches.byte(F.col("event_id") % 256).alias("b"))
    return e.select("event_id", F.col("b").cast("bigint").alias("id"))


@query("scan_events_validated", "select event_id, user_id, event_type from events")
def scan_events_validated(spark, sf):
    return guards.validate(events(spark, sf), "user_id", "event_type", "ts").select("event_id", "user_id", "event_type")


@query("enqueue_guard", "select event_id, user_id from events")
def enqueue_guard(spark, sf):
    return guards.required(events(spark, sf).select("event_id", "user_id"), "user_id")


@query("window_unique_guard", "select l_orderkey, l_suppkey, count(*) as n from lineitem group by all having count(*) > 1")
def window_unique_guard(spark, sf):
    return guards.repeated(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


@query("spool_metadata", "select doc_id, source, lang from documents")
def spool_metadata(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "lang")


@query("metrics_align_header", "select event_id::varchar as event_id, coalesce(event_type, '') as event_type, '' as loss from events")
def metrics_align_header(spark, sf):
    return guards.aligned(events(spark, sf), ["event_id", "event_type", "loss"])


#: Days of the log and a case's first letter make statuses; times are those of the log.
MODES_SQL = """with v as (select event_type, row_number() over (order by event_type) - 1 as id from (select distinct event_type from events union select 'EOS')),
e as (select user_id, event_id, id, event_type, value, ts, lead(event_type) over w as nxt, lag(event_type) over w as prev, epoch_us(ts) as us from events join v using (event_type) window w as (partition by user_id order by event_id)),
tr as (select tr, row_number() over (order by tr) - 1 as id from (select distinct event_type || '→' || nxt as tr from e where nxt is not null union select 'UNK')),
d as (select user_id, event_id, us, lead(us) over (partition by user_id order by us, event_id) - us as gap, max(us) over (partition by user_id) as fin, min(us) over (partition by user_id) as beg, row_number() over (partition by user_id order by us desc, event_id desc) as back from e),
m as (select min(gap) / 1e6 as lo, max(gap) / 1e6 as hi from d), b as (select min(value) as lo, max(value) as hi from events),
t as (select user_id, sum((gap / 1e6 - lo) / (hi - lo)) as et, sum(case when back > 1 then (fin // 1000000 - us // 1000000) / (fin // 1000000 - beg // 1000000 + 1e-8) end) as nt from d cross join m group by 1),
f as (select user_id, string_agg(e.id, ',' order by event_id) as event_ids, string_agg(coalesce(n.id, (select id from v where event_type = 'EOS')), ',' order by event_id) as labels, string_agg(tr.id, ',' order by event_id) as edge_types,
sum((value - lo) / (hi - lo)) as fsum from e cross join b left join v n on n.event_type = nxt left join tr on tr.tr = e.event_type || '→' || nxt group by 1)
select user_id, event_ids, labels, edge_types, round(et, 6) as edge_time, round(nt, 6) as node_time, round(fsum, 6) as features from f join t using (user_id)"""


@query("transform_modes", MODES_SQL)
def transform_modes(spark, sf):
    """A fitted transformer over the log, in the mode that has everything."""
    e = events(spark, sf)
    config = transformer.resolve(case="user_id", event="event_type", time="ts", order="event_id", status="event_type", numbers=("value",), mode="time_decay_status")
    g = transformer.LogTransformer(config).fit_transform(e)
    added = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return g.select("user_id", *[F.array_join(n, ",").alias(n) for n in ("event_ids", "labels", "edge_types")], R(added(F.col("edge_times")), 6).alias("edge_time"),
                    R(added(F.col("node_times")), 6).alias("node_time"), R(added(F.transform("features", lambda x: x[0])), 6).alias("features"))
