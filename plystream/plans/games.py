"""Queries on games, puzzles, positions, cases and importance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plystream.functions import parse
from plystream.operators import cases, importance, metrics, split
from plystream.plans.registry import query
from plystream.plans.sources import events, literals, table
from plystream.sources import games

PGN = """(values (1, '[Event "a"]' || chr(10) || '[Result "1-0"]' || chr(10) || chr(10) || '1. e4 e5 1-0' || chr(10) || '[Event "b"]' || chr(10) || chr(10) || '1. d4 [Event 0-1'),
(2, '[Event "c"]' || chr(10) || '1. c4 *'), (3, '')) as t(i, s)"""


@query("pgn_split_games", rf"""select i, cast(j as bigint) as local_id, coalesce(nullif(regexp_extract(g, '\[Event "([^"]*)"\]', 1), ''), '?') as event, length(g) as n
from (select i, unnest(l) as g, generate_subscripts(l, 1) as j from (select i, list_filter(string_split_regex(replace(chr(10) || s, chr(10) || '[Event ', chr(1) || '[Event '), chr(1)), lambda x: trim(x, chr(10)) <> '') as l from {PGN}))""")
def pgn_split_games(spark, sf):
    got = literals(spark, PGN.replace("chr(10)", r"'\n'")).select("i", F.posexplode(parse.split_games(F.col("s"))).alias("p", "g"))
    return got.select("i", (F.col("p") + 1).cast("bigint").alias("local_id"), F.coalesce(parse.header(F.col("g"), "Event"), F.lit("?")).alias("event"),
                      F.char_length(F.rtrim(F.col("g"), F.lit("\n"))).cast("bigint").alias("n"))


PATHS = "(values ('a/b.pgn.zst'), ('c.PGN.ZST'), ('d.pgn'), ('e.bz2')) as t(path)"


@query("infer_kind", f"select path, case when ends_with(lower(path), '.zst') then 'zst' else 'text' end as kind from {PATHS}")
def infer_kind(spark, sf):
    return literals(spark, PATHS).select("path", games.infer_kind(F.col("path")).alias("kind"))


VARIANTS = "(values (1, 'Standard'), (2, null), (3, 'normal'), (4, 'Atomic'), (5, '')) as t(i, v)"


@query("filter_variant", f"select i from {VARIANTS} where lower(coalesce(v, 'Standard')) in ('standard', 'normal')")
def filter_variant(spark, sf):
    return literals(spark, VARIANTS).where(F.lower(F.coalesce("v", F.lit("Standard"))).isin("standard", "normal")).select("i")


@query("filter_range", "select event_id from events where event_id % 5 + 1 between 2 and 4")
def filter_range(spark, sf):
    return table(spark, sf, "events").where((F.col("event_id") % 5 + 1).between(2, 4)).select("event_id")


@query("filter_min_len", "select l_orderkey, count(*) as n from lineitem group by 1 having count(*) >= 4")
def filter_min_len(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n >= 4")


@query("filter_singletons", """select c_custkey from customer join (select c_nationkey, c_mktsegment from customer group by 1, 2 having count(*) > 1) using (c_nationkey, c_mktsegment)""")
def filter_singletons(spark, sf):
    return cases.not_alone(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_nationkey", "c_mktsegment").select("c_custkey")


@query("sample_dense_tail", """select l_orderkey, l_linenumber from (select l_orderkey, l_linenumber, max(l_linenumber) over (partition by l_orderkey) as e from lineitem)
where l_linenumber >= 2 and (l_linenumber - 2) % (case when e - l_linenumber <= 1 then 1 else 3 end) = 0""")
def sample_dense_tail(spark, sf):
    return cases.dense_tail(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", 2, 3, 1, 1)


#: One row for each ply; order lines repeat some.
STEPS = "(select l_orderkey, l_linenumber, min(l_quantity) as l_quantity from lineitem group by 1, 2)"
CLK = "case when (l_orderkey + l_linenumber) % 5 = 0 then null else l_quantity end"


def _steps(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))


@query("clock_durations", f"""select l_orderkey, l_linenumber, case when c is not null then greatest(0.0, coalesce(last_value(c ignore nulls) over (partition by l_orderkey, l_linenumber % 2 order by l_linenumber rows between unbounded preceding and 1 preceding), 60.0) - c + 2.0) end as spent
from (select l_orderkey, l_linenumber, {CLK} as c from {STEPS})""")
def clock_durations(spark, sf):
    d = _steps(spark, sf).select("l_orderkey", "l_linenumber", F.expr(CLK).alias("c"))
    return cases.durations(d, "l_orderkey", "l_linenumber", "c", F.lit(60.0), F.lit(2.0)).select("l_orderkey", "l_linenumber", "spent")


@query("stratified_cap", "select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by doc_id) as r from documents) where r <= 20")
def stratified_cap(spark, sf):
    return cases.capped(table(spark, sf, "documents").select("lang", "doc_id"), "lang", "doc_id", 20).select("lang", "doc_id")


@query("debug_attach_split", """select e.event_id, s.split from events e join (select user_id, case when r <= floor(n * 0.8::double) then 'train' when r <= floor(n * 0.8::double) + floor(n * 0.1::double) then 'val' else 'test' end as split
from (select user_id, row_number() over (order by md5('0:' || cast(user_id as varchar)), user_id) as r, count(*) over () as n from (select distinct user_id from events where user_id % 10 <> 3))) s using (user_id)""")
def debug_attach_split(spark, sf):
    e = events(spark, sf)
    ids = e.where("user_id % 10 <> 3").select("user_id").distinct().withColumn("all", F.lit(0))
    return e.join(split.stratified(ids, "user_id", ["all"], 0.8, 0.1), "user_id").select("event_id", "split")


PUZZLES = "(values ('p1', '1400', 'mateIn1 short', 'e2e4 e7e5'), ('p2', null, 'endgame mateIn2', 'a2a3 b7b6 c2c3 d7d6'), ('p3', '1800', 'mateIn10 long', 'g1f3'), ('p4', 'x', 'crushing', 'h2h4 h7h5')) as t(id, rating, themes, moves)"


@query("puzzle_theme_token", f"select id, case when list_contains(string_split(themes, ' '), 'mateIn2') then 2 when list_contains(string_split(themes, ' '), 'mateIn1') then 1 end as theme from {PUZZLES}")
def puzzle_theme_token(spark, sf):
    return literals(spark, PUZZLES).select("id", parse.theme_token(F.col("themes"), [2, 1]).alias("theme"))


@query("puzzle_theme_flat", f"select id from {PUZZLES} where regexp_matches(themes, 'mateIn1|mateIn3')")
def puzzle_theme_flat(spark, sf):
    return literals(spark, PUZZLES).where(F.col("themes").rlike("mateIn1|mateIn3")).select("id")


@query("puzzle_rating_filter", f"select id from {PUZZLES} where try_cast(rating as double) >= 1500")
def puzzle_rating_filter(spark, sf):
    return literals(spark, PUZZLES).where(F.col("rating").try_cast("double") >= 1500).select("id")


@query("puzzle_plies", f"""select id, cast(j - 1 as bigint) as ply, m as move, cast(greatest(1, 3 - (j - 1) // 2) as bigint) as mate_n
from (select id, unnest(string_split(moves, ' ')) as m, generate_subscripts(string_split(moves, ' '), 1) as j from {PUZZLES}) where (j - 1) % 2 = 1""")
def puzzle_plies(spark, sf):
    d = literals(spark, PUZZLES).select("id", F.posexplode(F.split("moves", " ")).alias("ply", "move")).where("ply % 2 = 1")
    return d.select("id", F.col("ply").cast("bigint").alias("ply"), "move", F.greatest(F.lit(1), F.lit(3) - F.floor(F.col("ply") / 2)).cast("bigint").alias("mate_n"))


FENS = "(values (1, '7k/8/8/8/8/8/8/K6R w'), (2, '7k/8/8/8/8/8/8/KN5b b'), (3, 'rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w')) as t(i, fen)"
FEN_SQUARES = f"""select i, square, case when p = '.' then 0 else instr('pnbrqk', lower(p)) * 2 + 1 + cast(p <> lower(p) as int) end as event_id, case when p = '.' then 0 when (p <> lower(p)) = (split_part(fen, ' ', 2) = 'w') then 1 else -1 end as side
from (select i, fen, cast(s as bigint) as square, substr(string_split(b, '/')[8 - s // 8], s % 8 + 1, 1) as p from (select i, fen,
replace(replace(replace(replace(replace(replace(replace(replace(split_part(fen, ' ', 1), '1', '.'), '2', '..'), '3', '...'), '4', '....'), '5', '.....'), '6', '......'), '7', '.......'), '8', '........') as b from {FENS}), range(64) r(s))"""


@query("fen_squares", FEN_SQUARES)
def fen_squares(spark, sf):
    d = literals(spark, FENS).select("i", "fen", F.posexplode(parse.squares(F.col("fen"))).alias("square", "p"))
    mine = (F.col("p") != F.lower("p")) == parse.white_to_move(F.col("fen"))
    return d.select("i", F.col("square").cast("bigint").alias("square"), parse.square_id(F.col("p")).alias("event_id"), F.when(F.col("p") == ".", 0).when(mine, 1).otherwise(-1).alias("side"))


SCORED = "(select user_id, event_id, event_type as y, case when event_id % 4 = 0 then 'none' else event_type end as p from events) t"


def _scored(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("y"), F.when(F.col("event_id") % 4 == 0, "none").otherwise(F.col("event_type")).alias("p"))


@query("error_positions", f"select pos, count(*) as n from (select cast(row_number() over (partition by user_id order by event_id) - 1 as bigint) as pos, y, p from {SCORED}) where y <> p group by 1")
def error_positions(spark, sf):
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return _scored(spark, sf).withColumn("pos", at.cast("bigint")).where("y <> p").groupBy("pos").agg(F.count("*").alias("n"))


@query("error_pairs", f"select y, p, count(*) as n from {SCORED} where y <> p group by 1, 2 order by n desc, y, p limit 5")
def error_pairs(spark, sf):
    return _scored(spark, sf).where("y <> p").groupBy("y", "p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y", "p").limit(5)


@query("misclassified", f"select event_id, y, p from {SCORED} where y <> p")
def misclassified(spark, sf):
    return _scored(spark, sf).where("y <> p").select("event_id", "y", "p")


@query("seq_length_stats", "select min(n) as lo, max(n) as hi, avg(n) as mean, median(n) as mid from (select user_id, count(*) as n from events group by 1)")
def seq_length_stats(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.avg("n").alias("mean"), F.median("n").alias("mid"))


LONG = "(select vec_id, cast(j - 1 as bigint) as pos, cast(v as double) as v from (select vec_id, unnest(embedding[1:vec_id % 60 + 4]) as v, generate_subscripts(embedding[1:vec_id % 60 + 4], 1) as j from embeddings)) t"
BIN = "cast(floor(({0} - 1) / 10) * 10 + 1 as bigint)"


def _long(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode(F.slice("embedding", F.lit(1), (F.col("vec_id") % 60 + 4).cast("int"))).alias("pos", "v")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.col("v").cast("double").alias("v"))


@query("length_bins", f"select {BIN.format('n')} as bin, count(*) as sequences from (select vec_id, count(*) as n from {LONG} group by 1) group by 1")
def length_bins(spark, sf):
    n = _long(spark, sf).groupBy("vec_id").agg(F.count("*").alias("n"))
    return n.groupBy(importance.length_bin(F.col("n"), 10).alias("bin")).agg(F.count("*").alias("sequences"))


@query("importance_stats", f"""with r as (select {BIN.format('(vec_id % 60 + 4)')} as bin, pos, v, row_number() over (partition by vec_id order by v desc, pos) as rank from {LONG}),
c as (select bin, rank, pos, count(*) as n, sum(v) as s from r where rank <= 3 group by 1, 2, 3)
select bin, rank, arg_max(pos, n * 1000 - pos) as modal, round(100.0 * max(n) / sum(n), 6) as dominance, round(sum(s) / sum(n), 6) as mean_value from c group by 1, 2""")
def importance_stats(spark, sf):
    d = _long(spark, sf).withColumn("bin", importance.length_bin(F.col("vec_id") % 60 + 4, 10))
    m = importance.modal(importance.ranked(d, "vec_id", "pos", "v"), "bin", "pos", "v")
    return m.select("bin", "rank", "modal", F.round("dominance", 6).alias("dominance"), F.round("mean_value", 6).alias("mean_value"))


@query("importance_heatmap", f"select {BIN.format('(vec_id % 60 + 4)')} as bin, pos, round(avg(v), 6) as mean_value from {LONG} group by 1, 2")
def importance_heatmap(spark, sf):
    d = _long(spark, sf)
    return d.groupBy(importance.length_bin(F.col("vec_id") % 60 + 4, 10).alias("bin"), "pos").agg(F.round(F.avg("v"), 6).alias("mean_value"))


@query("window_metrics", f"""with g as (select vec_id, max(v) as peak, arg_max(pos, v) as place_at, count(*) as length from {LONG} group by 1)
select vec_id, round(peak, 6) as peak, length, round(sum(case when v > peak * 0.5 then 1 else 0 end) / length, 6) as wide, round(min(place_at) / length, 6) as place from {LONG} join g using (vec_id) group by vec_id, peak, length""")
def window_metrics(spark, sf):
    m = importance.window_metrics(_long(spark, sf), "vec_id", "pos", "v")
    return m.select("vec_id", "length", *[F.round(c, 6).alias(c) for c in ("peak", "wide", "place")])


@query("compare_models_by_depth", """with a as (select doc_id % 7 as depth, count(*) as n, avg(quality) as acc from labels where doc_id % 7 <> 2 group by 1), b as (select doc_id % 7 as depth, count(*) as n, avg(toxic) as acc from labels where doc_id % 7 <> 5 group by 1)
select depth, case when a.n >= 5 then round(a.acc, 6) end as acc_a, case when b.n >= 5 then round(b.acc, 6) end as acc_b from a full outer join b using (depth)""")
def compare_models_by_depth(spark, sf):
    d = table(spark, sf, "labels").withColumn("depth", F.col("doc_id") % 7)
    side = lambda rows, hit, out: rows.groupBy("depth").agg(F.when(F.count("*") >= 5, F.round(F.avg(hit), 6)).alias(out))
    return side(d.where("depth <> 2"), "quality", "acc_a").join(side(d.where("depth <> 5"), "toxic", "acc_b"), "depth", "full_outer")


@query("align_results", """select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'right only' when b.doc_id is null then 'left only' else 'both' end as found
from (select doc_id from labels where doc_id % 5 <> 0) a full outer join (select doc_id from labels where doc_id % 3 <> 0) b on a.doc_id = b.doc_id""")
def align_results(spark, sf):
    d = table(spark, sf, "labels").select("doc_id")
    a, b = d.where("doc_id % 5 <> 0").withColumn("a", F.lit(1)), d.where("doc_id % 3 <> 0").withColumn("b", F.lit(1))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.when(F.col("a").isNull(), "right only").when(F.col("b").isNull(), "left only").otherwise("both").alias("found"))


@query("key_difference", "select distinct o_custkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 2 = 0)")
def key_difference(spark, sf):
    known = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_custkey").join(known, "o_custkey", "left_anti").distinct()


@query("clean_reshard", "select doc_id, lang, cast(floor((row_number() over (partition by lang order by doc_id) - 1) / 64) as bigint) as shard_idx from documents where text is not null")
def clean_reshard(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "lang")
    return split.shards(d, ["lang"], "doc_id", 64).select("doc_id", "lang", "shard_idx")


@query("edge_type_onehot", "select l_orderkey, l_linenumber, l_linenumber % 3 = 0 as legal, l_linenumber % 3 = 1 as attack, l_linenumber % 3 = 2 as pin, round(l_quantity * (case when l_linenumber % 3 = 0 then 1.0 else 0.5 end), 6) as weighted from lineitem")
def edge_type_onehot(spark, sf):
    kind = F.col("l_linenumber") % 3
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[(kind == i).alias(n) for i, n in enumerate(("legal", "attack", "pin"))],
                                               F.round(F.col("l_quantity") * F.when(kind == 0, 1.0).otherwise(0.5), 6).alias("weighted"))


@query("early_stop_epoch", f"""with l as (select l_orderkey, l_linenumber, l_quantity as v, row_number() over (partition by l_orderkey order by l_linenumber) as e, min(l_quantity) over (partition by l_orderkey order by l_linenumber rows between unbounded preceding and 1 preceding) as before from {STEPS}),
g as (select *, max(case when before is null or v < before then e end) over (partition by l_orderkey order by l_linenumber) as last_best from l), s as (select l_orderkey, min(l_linenumber) as stop from g where e - last_best >= 2 group by 1)
select l_orderkey, cast(s.stop as bigint) as stop, min(v) as best from l left join s using (l_orderkey) where s.stop is null or l_linenumber <= s.stop group by 1, 2""")
def early_stop_epoch(spark, sf):
    return cases.early_stop(_steps(spark, sf), "l_orderkey", "l_linenumber", "l_quantity", 2)


@query("seq_topk_accuracy", """with h as (select vec_id // 4 as seq, label + 1 in (select unnest(list_transform(list_slice(list_sort(list_transform(range(1, 65), lambda i: {'s': -embedding[i], 'i': i})), 1, 20), lambda x: x.i))) as hit from embeddings)
select seq, bool_and(hit) as all_hit from h group by 1""")
def seq_topk_accuracy(spark, sf):
    d = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("bigint").alias("seq"), F.array_contains(metrics.top_k("embedding", 20), F.col("label").cast("int")).alias("hit"))
    return d.groupBy("seq").agg(F.bool_and("hit").alias("all_hit"))


@query("flat_cap", "select doc_id from documents order by doc_id limit 25")
def flat_cap(spark, sf):
    return cases.flat_cap(table(spark, sf, "documents").select("doc_id"), "doc_id", 25)


@query("filter_forced_position", "select l_orderkey, l_linenumber from lineitem where l_linenumber <> 1")
def filter_forced_position(spark, sf):
    return cases.not_forced(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_linenumber")
