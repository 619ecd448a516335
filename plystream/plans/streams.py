"""Queries on streams and sources: they write to the shared folder and read what they have written."""

from __future__ import annotations

from pyspark.sql import functions as F

from plystream.plans.registry import query
from plystream.sources import frames, games, listed, store
from plystream.streaming import cases, ingest


def _stream(spark, sf):
    path = f"{sf}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.replace("events.", "[e]vents."))


@query("stream_ingest", "select event_id, user_id, event_type, value from events")
def stream_ingest(spark, sf):
    out = ingest.folder(spark, "ingest")
    ingest.append(_stream(spark, sf).select("event_id", "user_id", "event_type", "value"), out, ingest.folder(spark, "progress"))
    return spark.read.parquet(out)


SIDE = "event_id % 2"
CLOCK = "case when event_id % 5 = 0 then null else value end"
KEY = "event_type || event_id % 9"


@query("stream_case_state", f"""with e as (select user_id, event_id, {SIDE} as side, {CLOCK} as c, row_number() over (partition by user_id, {KEY} order by event_id) as n from events),
d as (select user_id, event_id, case when c is not null then greatest(0.0, coalesce(last_value(c ignore nulls) over (partition by user_id, side order by event_id rows between unbounded preceding and 1 preceding), 60.0) - c + 2.0) end as spent,
row_number() over (partition by user_id order by event_id) as r from e where n = 1)
select user_id, event_id, round(spent, 6) as spent from d where r <= 12""")
def stream_case_state(spark, sf):
    """Distinct positions of a case, the time each side spent since its last, twelve of a case at most."""
    e = _stream(spark, sf).select("user_id", "event_id", F.expr(f"{SIDE} as side"), F.expr(f"{CLOCK} as c"), F.expr(f"{KEY} as k"))
    out = ingest.folder(spark, "cases")
    ingest.append(cases.accepted(e, "user_id", "event_id", "k", "side", "c", 60.0, 2.0, 12), out, ingest.folder(spark, "progress"))
    return spark.read.parquet(out).select("user_id", F.col("order").alias("event_id"), F.round("spent", 6).alias("spent"))


@query("read_sources", """select case when source like '%1' then 'a' else 'b' end as tag, doc_id as event, row_number() over (partition by source like '%1' order by doc_id) as local_id from documents""")
def read_sources(spark, sf):
    """A list of two files of games, one for each of two sources, written from the documents and read back."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.when(F.col("source").like("%1"), "a").otherwise("b").alias("tag"))
    entries = []
    for tag in "ab":
        path = ingest.folder(spark, f"games-{tag}")
        text = F.format_string('[Event "%d"]\n\n1. e4 *', "doc_id")
        d.where(F.col("tag") == tag).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").select(text).write.text(path)
        entries.append({"path": path, "tag": tag})
    got = listed.read_all(spark, listed.listed(entries))
    return got.select(F.col("source_tag").alias("tag"), F.regexp_extract("pgn", 'Event "([0-9]+)"', 1).cast("bigint").alias("event"), F.col("local_id").cast("bigint").alias("local_id"))


SPLIT = "case when r <= floor(n * 0.8::double) then 'train' when r <= floor(n * 0.8::double) + floor(n * 0.1::double) then 'val' else 'test' end"
LINES = "(select l_orderkey, list_sort(list(l_partkey)) as items from lineitem group by 1)"


def _stored(spark, sf):
    """Orders with their lines as windows, taken as a stream in which every fifth batch is followed by a checkpoint."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_partkey")).alias("items"))
    source = ingest.folder(spark, "windows")
    spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_custkey").join(lines, "o_orderkey", "left").repartition(8, "o_orderkey").write.parquet(source)
    kept = store.WindowStore(spark, ingest.folder(spark, "store"), "o_orderkey", "o_orderpriority", "items")
    windows = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 3).parquet(source)
    take = store.sink(kept, store.furthest("o_orderpriority", "o_orderkey"), every=5)
    ingest.started(windows.writeStream.foreachBatch(take).option("checkpointLocation", ingest.folder(spark, "progress")), spark)
    kept.checkpoint()
    return kept


@query("checkpoint_store", f"""select o_orderkey, o_orderpriority, {SPLIT} as split, k as items from (
  select o_orderkey, o_orderpriority, len(items) as k, row_number() over (partition by o_orderpriority order by md5('0:' || o_orderkey), o_orderkey) as r, count(*) over (partition by o_orderpriority) as n
  from orders join {LINES} on l_orderkey = o_orderkey)""")
def checkpoint_store(spark, sf):
    return _stored(spark, sf).splits().select("o_orderkey", "o_orderpriority", "split", F.size("items").cast("bigint").alias("items"))


@query("resume_points", f"select o_orderpriority as source, max(o_orderkey) as done from orders join {LINES} on l_orderkey = o_orderkey group by 1")
def resume_points(spark, sf):
    """How far each source was taken, as the last commit says."""
    kept = _stored(spark, sf)
    found = kept.windows().groupBy("o_orderpriority").agg(F.max("o_orderkey").alias("done"))
    said = spark.createDataFrame(list(kept.state()["offsets"].items()), "source string, point bigint")
    return found.join(said, (F.col("source") == F.col("o_orderpriority")) & (F.col("point") >= F.col("done"))).select("source", "done")


@query("zst_frames", "select doc_id, md5(coalesce(text, '')) as digest, row_number() over (order by doc_id) as local_id from documents")
def zst_frames(spark, sf):
    """Whole texts as games in zstd files of many frames, read back by runs of frames and numbered across the files."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.format_string('[Event "%d"]\n\n%s\n', "doc_id", F.coalesce("text", F.lit(""))).alias("game"))
    path = ingest.folder(spark, "zst")
    frames.write_zstd(frames.by_order(d, "doc_id"), path, "game", 50)
    got = listed.zst_games(spark, path, split=1 << 16, across=True)
    text = F.regexp_extract("pgn", r'(?s)^\[Event "[0-9]+"\]\n\n(.*)\n$', 1)
    return got.select(F.regexp_extract("pgn", r'^\[Event "([0-9]+)"', 1).cast("bigint").alias("doc_id"), F.md5(F.encode(text, "UTF-8")).alias("digest"), F.col("local_id").cast("bigint").alias("local_id"))


@query("staged_table", "select doc_id, n_chars, source from documents")
def staged_table(spark, sf):
    """A compressed CSV table in files with a header each, staged as Parquet once and then read."""
    lines = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.concat_ws(",", "doc_id", "n_chars", "source"), F.lit("\n")).alias("line"))
    path, target = ingest.folder(spark, "csv"), ingest.folder(spark, "staged")
    frames.write_zstd(frames.by_order(lines, "doc_id"), path, "line", 100, "doc_id,n_chars,source\n")
    for _ in range(2):  # the second time nothing is decompressed
        got = frames.staged_table(spark, path, target, "doc_id bigint, n_chars bigint, source string")
    return got


@query("result_scan", """select doc_id as problem_id, quality = 1 as move_correct, case when doc_id % 3 > 0 then toxic end as mate_true, count(*) over () as n from labels""")
def result_scan(spark, sf):
    """Results as they are written, with ``None`` and empty fields, and read back."""
    d = spark.read.parquet(f"{sf}/labels.parquet")
    said = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "None").otherwise("")).otherwise(F.col("toxic").cast("string"))
    path = ingest.folder(spark, "results")
    d.select(F.col("doc_id").alias("problem_id"), F.initcap((F.col("quality") == 1).cast("string")).alias("move_correct"), said.alias("mate_true"), F.lit("x").alias("other")).write.csv(path, header=True)
    got = games.results(spark, path, "problem_id bigint, move_correct boolean, mate_true int, mate_pred int")
    return got.crossJoin(F.broadcast(got.agg(F.count("*").alias("n")))).where("mate_pred is null").drop("mate_pred")


@query("pending_merge", """with s as (select l_orderkey, case when max(l_linenumber) > 4 then 'train' else 'val' end as split from lineitem where l_linenumber > 2 group by 1)
select o_orderkey, split from orders left join s on l_orderkey = o_orderkey""")
def pending_merge(spark, sf):
    """Rows that come in three batches, of which the last comes twice, and find their split or wait."""
    d = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    dealt = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.max("l_linenumber") > 4, "train").otherwise("val").alias("split"))
    pending = ingest.folder(spark, "pending")
    for k in (0, 1, 2, 2):
        both = store.merge_pending(spark, pending, d.where(F.pmod("o_orderkey", F.lit(3)) == k), k, dealt if k == 2 else None, "o_orderkey")
    ready, waiting = both
    return ready.unionByName(waiting.withColumn("split", F.lit(None).cast("string")))
