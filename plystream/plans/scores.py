"""Queries on the likeness of sequences, accuracy with alternatives, ranges of length and clocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plystream.operators import clock, estimators, importance, likeness, metrics, models
from plystream.plans.evaluation import BUCKET
from plystream.plans.event_log import R
from plystream.plans.registry import query
from plystream.plans.sources import events, literals, table

PAIRS = "(select o_custkey, list(o_orderstatus order by o_orderkey) as t, list(case when o_orderkey % 3 = 0 then 'P' else o_orderstatus end order by o_orderkey desc) as p from orders group by 1)"
GRAMS = " union all ".join(f"select o_custkey as k, {n} as n, '{s}' as s, array_to_string({s}[i:i + {n - 1}], '|') as g from x, range(1, len({s}) - {n} + 2) r(i)" for n in range(1, 5) for s in "pt")


def _pairs(spark, sf):
    p = F.when(F.col("o_orderkey") % 3 == 0, "P").otherwise(F.col("o_orderstatus"))
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.col("o_orderstatus").alias("t"), p.alias("p")))).alias("x"))
    return g.select("o_custkey", F.transform("x", lambda v: v["t"]).alias("t"), F.reverse(F.transform("x", lambda v: v["p"])).alias("p"))


@query("bleu", f"""with x as {PAIRS}, g as ({GRAMS}), c as (select k, n, g, count(*) filter (s = 'p') as p, count(*) filter (s = 't') as t from g group by all),
m as (select k, n, sum(least(p, t)) as c from c group by all), l as (select m.k, n, c, least(4, len(x.p)) as top, len(x.p) - n + 1 as d from m join x on o_custkey = m.k)
select k as o_custkey, round(case when min(case when n = 1 then c end) = 0 then 0.0 else exp(sum(ln(case when c = 0 then 0.1 else c end / d)) filter (n <= top) / max(top)) end, 8) as bleu from l group by k""")
def bleu(spark, sf):
    return likeness.bleu(_pairs(spark, sf), "o_custkey", "p", "t").withColumn("bleu", R(F.col("bleu")))


@query("dls_exact_match", f"""with x as (select array_to_string(p, '') as p, array_to_string(t, '') as t from {PAIRS})
select round(avg(1 - damerau_levenshtein(p, t) / greatest(length(p), length(t))), 8) as similarity, round(avg((p = t)::int), 8) as exact from x""")
def dls_exact_match(spark, sf):
    x = _pairs(spark, sf).select(F.array_join("p", "").alias("p"), F.array_join("t", "").alias("t"))
    return likeness.similarity(x, "p", "t").select(R(F.col("similarity")).alias("similarity"), R(F.col("exact")).alias("exact"))


@query("baseline_most_frequent", "select event_type, count(*) as n from events group by 1 order by n desc, min(event_id) limit 1")
def baseline_most_frequent(spark, sf):
    g = events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(1).select("event_type", "n")


@query("seq_topk_analysis", """with c as (select c_custkey, bool_and(o_orderpriority <> '5-LOW') as hit from customer left join orders on o_custkey = c_custkey group by 1)
select count(*) as n, round(count(*) filter (hit) / count(*), 8) as accuracy from c""")
def seq_topk_analysis(spark, sf):
    """Sequences without a label count as missed: they stay in the denominator."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_and(F.col("o_orderpriority") != "5-LOW").alias("hit"))
    c = table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return c.agg(F.count("*").alias("n"), R(F.count_if("hit") / F.count("*")).alias("accuracy"))


@query("show_error_sequences", """select o_custkey, string_agg(o_orderpriority, ',' order by o_orderkey) as labels, count(*) filter (o_orderpriority = '5-LOW') as misses from orders group by 1 having misses > 0 order by o_custkey limit 3""")
def show_error_sequences(spark, sf):
    """The first three sequences with a miss; the three are found before any labels are gathered."""
    o = table(spark, sf, "orders")
    bad = o.where("o_orderpriority = '5-LOW'").groupBy("o_custkey").agg(F.count("*").alias("misses")).orderBy("o_custkey").limit(3)
    labels = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return o.join(F.broadcast(bad), "o_custkey").groupBy("o_custkey").agg(F.array_join(labels, ",").alias("labels"), F.first("misses").alias("misses"))


ALTS = "(values (1, 10, 10, true, 3, null), (2, 11, 12, true, 3, -2), (3, 11, 12, true, 3, -3), (4, 11, 12, false, 2, -1), (5, 7, 8, true, 1, 0), (6, 7, 8, true, 2, null)) as t(i, y, p, legal, n, after)"


@query("alt_mate_accuracy", f"select count(*) as n, avg((y = p)::int) as strict, avg((y = p or coalesce(legal and after = 1 - n, false))::int) as with_alternatives from {ALTS}")
def alt_mate_accuracy(spark, sf):
    return metrics.with_alternatives(literals(spark, ALTS), "y", "p", "legal", "n", "after")




@query("length_quantile_bins", """with l as (select count(*)::double as len from events group by user_id)
select * from (""" + " union all ".join(f"select {i} as bin, floor(quantile_cont(len, {i / 4}))::bigint as lo, ceil(quantile_cont(len, {(i + 1) / 4}))::bigint as hi from l" for i in range(4)) + ")")
def length_quantile_bins(spark, sf):
    return importance.quantile_bins(events(spark, sf).groupBy("user_id").agg(F.count("*").alias("len")), "len", 4)


@query("critical_windows", """with e as (select user_id, value, count(*) over (partition by user_id) as len, row_number() over (partition by user_id order by event_id) - 1 as pos, row_number() over (partition by user_id order by value desc, event_id) as r from events),
b as (select * from (values (0, 1, 10000), (1, 5, 70)) t(bin, lo, hi)), s as (select bin, count(distinct user_id) as n from e join b on len >= lo and len < hi group by bin)
select e2.bin, pos, round(avg(value), 6) as mean_value, round(count(*) / any_value(n), 8) as frequency from (select * from e join b on len >= lo and len < hi where r <= 3) e2 join s on s.bin = e2.bin group by e2.bin, pos""")
def critical_windows(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = events(spark, sf).select("user_id", "value", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), F.count("*").over(Window.partitionBy("user_id")).alias("len"))
    got = importance.critical(e, "user_id", "pos", "value", "len", [(1, 10000), (5, 70)])
    return got.select("bin", "pos", R(F.col("mean_value"), 6).alias("mean_value"), R(F.col("frequency")).alias("frequency"))


@query("window_metrics_agg", """with p as (select user_id, count(*) as len, max(value) as peak from events group by 1)
select len % 3 as bin, round(avg(peak), 3) as mean, round(stddev_samp(peak), 3) as sd, count(*) as n, round(median(peak), 3) as median from p group by 1""")
def window_metrics_agg(spark, sf):
    p = events(spark, sf).groupBy("user_id").agg((F.count("*") % 3).alias("bin"), F.max("value").alias("peak"))
    return p.groupBy("bin").agg(R(F.avg("peak"), 3).alias("mean"), R(F.stddev_samp("peak"), 3).alias("sd"), F.count("*").alias("n"), R(F.median("peak"), 3).alias("median"))


@query("first_accepted_key", "select user_id, arg_min(value, event_id) filter (event_type = 'purchase') as key from events group by 1")
def first_accepted_key(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.min_by("value", F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("key"))


@query("clock_from_avg", f"select {BUCKET} as bucket, round(ln(greatest(avg(value), 1e-3)) - 0.405, 6) as mu from events group by 1")
def clock_from_avg(spark, sf):
    e = events(spark, sf).groupBy(clock.bucket(F.col("event_id") % 997 + 1000).alias("bucket")).agg(F.avg("value").alias("s"))
    return e.select("bucket", R(clock.from_average(F.col("s")), 6).alias("mu"))


@query("clock_lookup_fallback", f"""with e as (select event_id, {BUCKET} as bucket, event_id % 5 + 1 as mate_n, ln(value) as x from events where value between 0.05 and 300),
g as (select bucket, mate_n, avg(x) as mu, stddev_pop(x) as sigma, grouping(bucket, mate_n) as level from e group by grouping sets ((bucket, mate_n), (bucket), ()) having grouping(bucket, mate_n) = 3 or count(*) >= 30),
q as (select distinct {BUCKET} * 2 - 1500 as b, event_id % 7 as m from events),
w as (select b, m, arg_min(mu, (abs(bucket - b), bucket)) as mu from q join g on level = 0 and mate_n = m and abs(bucket - b) <= 300 group by all),
p as (select b, arg_min(mu, (abs(bucket - b), bucket)) as mu from (select distinct b from q) join g on level = 1 group by all)
select q.b as rating, q.m as mate, round(coalesce(w.mu, p.mu, (select mu from g where level = 3)), 6) as mu from q left join w on w.b = q.b and w.m = q.m left join p on p.b = q.b""")
def clock_lookup_fallback(spark, sf):
    e = events(spark, sf).select("value", (F.col("event_id") % 997 + 1000).alias("rating"), (F.col("event_id") % 5 + 1).alias("mate"), (F.col("event_id") % 7).alias("m"))
    asked = e.select((clock.bucket(F.col("rating")) * 2 - 1500).alias("rating"), F.col("m").alias("mate")).distinct()
    got = clock.with_fallback(asked, "rating", "mate", clock.stats(e, "value", "rating", "mate", 300))
    return got.select("rating", "mate", R(F.col("mu"), 6).alias("mu"))


GAUSS = "sqrt(-2 * ln((('0x' || substr(h, 1, 13))::bigint + 0.5) / pow(2.0, 52))) * cos(2 * pi() * (('0x' || substr(h, 14, 13))::bigint + 0.5) / pow(2.0, 52))"
KEYED = "(select event_id, value, md5(user_id || ':' || event_id) as h from events)"


@query("clock_sample", f"select event_id, round(least(greatest(exp(ln(value + 1) + 0.5 * {GAUSS}), 0.5), 300.0), 6) as clock from {KEYED}")
def clock_sample(spark, sf):
    key = F.concat_ws(":", "user_id", "event_id")
    return events(spark, sf).select("event_id", R(clock.draw(key, F.ln(F.col("value") + 1), F.lit(0.5)), 6).alias("clock"))


@query("clock_simulated", f"select event_id, round(greatest(0.5, value * greatest(0.3, 1 + 0.15 * {GAUSS})), 6) as clock from {KEYED}")
def clock_simulated(spark, sf):
    key = F.concat_ws(":", "user_id", "event_id")
    return events(spark, sf).select("event_id", R(clock.simulated(key, F.col("value").cast("double")), 6).alias("clock"))


NEXT = """(select user_id, event_id, event_type as k, coalesce(lead(event_type) over (partition by user_id order by event_id), 'EOS') as y from events)"""
TRAIN = "(select user_id from (select user_id, row_number() over (order by md5('0:' || cast(user_id as varchar)), user_id) as r, count(*) over () as n from (select distinct user_id from events)) where r <= floor(n * 0.8::double))"


@query("next_event_model", f"""with t as (select k, y, count(*) as n from {NEXT} where user_id in {TRAIN} group by 1, 2),
b as (select k, y from (select k, y, row_number() over (partition by k order by n desc, y) as r from t) where r = 1),
a as (select y from t group by 1 order by sum(n) desc, y limit 1)
select count(*) as n, round(avg((x.y = coalesce(b.y, (select y from a)))::int), 8) as accuracy from {NEXT} x left join b on b.k = x.k where user_id not in {TRAIN}""")
def next_event_model(spark, sf):
    """A model fitted on four fifths of the cases and scored on the rest."""
    found = estimators.NextEvent(caseCol="user_id", eventCol="event_type", orderCol="event_id")
    return models.evaluated(found, events(spark, sf))[1].select("n", R(F.col("accuracy")).alias("accuracy"))


@query("predict_proba", f"""with x as (select user_id, event_id, event_type as k, lag(event_type) over (partition by user_id order by event_id) as before,
  coalesce(lead(event_type) over (partition by user_id order by event_id), 'EOS') as y from events),
c as (select before, k, y, count(*) as n from x group by all), r as (select *, sum(n) over (partition by before, k) as seen, row_number() over (partition by before, k order by n desc, y) as r from c)
select event_id, r.y as prediction, round(n / seen, 8) as probability from x join r on x.before is not distinct from r.before and x.k = r.k and r.r = 1""")
def predict_proba(spark, sf):
    """The likeliest next event after each two events of a case, and its probability."""
    e = events(spark, sf).select("user_id", "event_id", "event_type")
    got = estimators.NextEvent(caseCol="user_id", eventCol="event_type", orderCol="event_id", history=2).fit(e).transform(e)
    return got.select("event_id", "prediction", R(F.element_at("probabilities", F.col("prediction"))).alias("probability"))


@query("sparse_encoder", """with v as (select c, t, row_number() over (order by c, t) as i from (select distinct 'l_partkey' as c, l_partkey::varchar as t from lineitem union select distinct 'l_shipdate', left(l_shipdate::varchar, 10) from lineitem))
select l_orderkey, l_linenumber, l_partkey, p.i::bigint as part_at, d.i::bigint as day_at, round((l_quantity - (select min(l_quantity) from lineitem)) / (select max(l_quantity) - min(l_quantity) from lineitem), 8) as quantity
from lineitem join v p on p.c = 'l_partkey' and p.t = l_partkey::varchar join v d on d.c = 'l_shipdate' and d.t = left(l_shipdate::varchar, 10)""")
def sparse_encoder(spark, sf):
    """Vocabularies as large as the tables of their keys, as places in one sparse vector."""
    d = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.substring(F.col("l_shipdate").cast("string"), 1, 10).alias("l_shipdate"), "l_quantity")
    got = estimators.SparseEncoder(categories=["l_partkey", "l_shipdate"], numbers=["l_quantity"]).fit(d).transform(d)
    at = lambda k: F.get("features.indices", F.lit(k))
    return got.select("l_orderkey", "l_linenumber", "l_partkey", at(1).alias("part_at"), at(2).alias("day_at"), R(F.get("features.values", F.lit(0))).alias("quantity"))
