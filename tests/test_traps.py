"""One test for each trap of meaning that the library has to step over."""

import pytest
from plystream.functions import parse
from plystream.operators import batches, cases, clock, encode, guards, importance, metrics, sequence, split
from plystream.operators.transformer import LogTransformer, resolve
from pyspark.sql import functions as F

LOG = [(0, "B", "open", "2024-01-01 00:00:00", "new", "x", 1.0, "g"), (1, "A", "open", "2024-01-01 00:05:00", "new", "<NO_DESC>", -1.0, None), (2, "A", "call", "2024-01-01 00:04:00", "busy", "y", 3.0, "h"),
       (3, "B", "close", "2024-01-01 00:00:10", "done", "x", 5.0, "g"), (4, "A", "close", "2024-01-01 00:06:30", "done", "y", None, "h")]


@pytest.fixture
def log(spark):
    d = spark.createDataFrame(LOG, "ord int, case string, event string, time string, status string, cat string, num double, kind string")
    return d.withColumn("time", F.col("time").cast("timestamp"))


def fitted(log, **more):
    return LogTransformer(resolve(case="case", event="event", time="time", order="ord", **more)).fit(log)


def by_case(df):
    return {r[0]: r for r in df.collect()}


def test_t1_labels_go_by_rows_and_times_by_time(log):
    got = by_case(fitted(log).transform(log))
    assert got["A"].event_ids == [3, 1, 2] and got["A"].labels == [1, 2, 0]  # EOS, call, close, open
    assert [round(x, 6) for x in got["A"].edge_times] == [round((60 - 10) / 80, 6), 1.0]  # by time: call, open, close


def test_t2_the_end_sorts_among_the_labels(log, spark):
    assert fitted(log).events == ["EOS", "call", "close", "open"]
    tokens = {r.token: r.id for r in sequence.sorted_vocabulary(spark.createDataFrame([("A",), ("Z",)], "event string"), "event").collect()}
    assert tokens == {"A": 0, "EOS": 1, "Z": 2}


def test_t3_the_unknown_transition_is_a_class(log):
    t = fitted(log, status="status", mode="status")
    assert t.transitions == ["UNK", "busy→done", "new→busy", "new→done"] and t.sizes == {"events": 4, "transitions": 4}
    other = log.withColumn("status", F.lit("odd"))
    assert by_case(t.transform(other))["A"].edge_types == [0, 0]


def test_t4_a_masked_first_feature_shortens_labels(spark):
    d = spark.createDataFrame([("a", 1, 5, -1.0), ("a", 2, 6, 0.5), ("a", 3, 7, 0.25)], "case string, ord int, label int, feature double")
    r = batches.trimmed_labels(d, "case", "ord", "label", "feature").first()
    assert r.n_valid == 2 and r.labels == [5, 6]


def test_t5_null_numbers(log, spark):
    got = {r.case: r.x for r in encode.minmax_masked(spark.createDataFrame([("a", None), ("b", 2.0), ("c", 4.0)], "case string, v double"), "v", "x").collect()}
    assert got == {"a": -1.0, "b": 0.0, "c": 1.0}
    masked = by_case(fitted(log, numbers=("num",)).transform(log))["A"].features
    filled = by_case(fitted(log, numbers=("num",), mask=False).transform(log))["A"].features
    assert masked == [[-1.0], [0.5], [-1.0]] and filled == [[0.5], [0.5], [0.5]]


def test_t6_unknown_categories_are_zeros_and_unknown_events_fail(log):
    t = fitted(log, categories=("cat",))
    other = log.withColumn("cat", F.lit("zzz"))
    assert by_case(t.transform(other))["B"].features == [[0.0, 0.0], [0.0, 0.0]]
    assert by_case(t.transform(log))["A"].features == [[-1.0, -1.0], [0.0, 1.0], [0.0, 1.0]]
    with pytest.raises(Exception, match="unknown event: odd"):
        t.transform(log.withColumn("event", F.lit("odd"))).collect()


def test_t7_prefix_differences(spark):
    d = spark.createDataFrame([("a", i, i * 10, float(i)) for i in range(4)], "case string, ord int, label int, delta double")
    times = lambda aligned: [r.edge_times for r in batches.prefix_graphs(d, "case", "ord", "label", "delta", 3, aligned).orderBy("ord").collect()]
    assert times(True) == [[0.0, 1.0], [1.0, 2.0]] and times(False) == [[0.0, 1.0], [0.0, 1.0]]


def test_t8_rows_of_a_case_meet_by_its_key(log):
    """Case B appears first and sorts last; labels and case features still are its own."""
    got = by_case(fitted(log, case_categories=("kind",)).transform(log))
    assert got["B"].features[0] == [1.0, 0.0] and got["A"].features[0] == [0.0, 1.0] and len(got["B"].labels) == 2


def test_t9_rows_are_told_by_their_order_column(log):
    t = fitted(log, numbers=("num",))
    assert by_case(t.transform(log.repartition(7))) == by_case(t.transform(log))


def test_t10_node_times_are_real_ones(log):
    got = by_case(fitted(log, mode="time_decay").transform(log))
    assert got["A"].node_times == pytest.approx([1.0, 90 / 150]) and "edge_times" not in got["A"].__fields__


def test_t11_missing_times(spark):
    rows = [("a", 0, None), ("a", 1, "2024-01-01 00:00:05"), ("a", 2, None), ("b", 3, None)]
    d = spark.createDataFrame(rows, "case string, ord int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.s for r in sequence.fill_times(d, "case", "ord", "ts").orderBy("ord").select(F.unix_timestamp("ts").alias("s")).collect()] == [1704067205] * 3 + [0]
    e = d.withColumnRenamed("ts", "time").withColumn("event", F.lit("x"))
    got = by_case(LogTransformer(resolve(case="case", event="event")).fit(e).transform(e))
    assert got["a"].edge_times == [None, None] and got["b"].edge_times == []


def test_t12_durations_span_skipped_positions(spark):
    d = spark.createDataFrame([("g", 0, "p", 60.0), ("g", 2, "p", 50.0), ("g", 4, "q", 45.0)], "g string, ply int, pos string, clk double")
    first = d.withColumn("n", F.row_number().over(split.Window.partitionBy("g", "pos").orderBy("ply"))).where("n = 1")
    got = cases.durations(first, "g", "ply", "clk", F.lit(100.0), F.lit(2.0)).orderBy("ply").collect()
    assert [(r.ply, r.spent) for r in got] == [(0, 42.0), (4, 17.0)]


def test_t13_flat_themes_match_inside_and_tokens_whole(spark):
    d = spark.createDataFrame([("mateIn10 long",), ("mateIn1",)], "t string")
    assert [r.a for r in d.select(F.col("t").contains("mateIn1").alias("a")).collect()] == [True, True]
    assert [r.a for r in d.select(parse.theme_token(F.col("t"), [1]).alias("a")).collect()] == [None, 1]


def test_t14_halves_go_to_even(spark):
    assert [r[0] for r in spark.createDataFrame([(1250,), (1350,)], "r int").select(clock.bucket(F.col("r"))).collect()] == [1200, 1400]


def test_t15_nearest_ties_go_to_the_smaller(spark):
    table = spark.createDataFrame([(1000, 1.0), (1200, 2.0), (5000, 3.0)], "at int, v double")
    d = spark.createDataFrame([(0, 1100), (1, 1101), (2, 0), (3, 9000), (4, None), (5, 3100)], "i int, k int")
    got = {r.i: r.v for r in clock.nearest(d, "k", table, "at", "v").collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 1.0, 3: 3.0, 4: None, 5: 2.0}
    assert {r.v for r in clock.nearest(d, "k", table.limit(0), "at", "v").collect()} == {None}


def test_t16_a_stratum_of_one_is_for_testing(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    assert {r.split for r in split.stratified(d, "k", ["s"], 0.8, 0.1).collect()} == {"test"}
    assert {r.split for r in split.by_length(d.withColumn("n", F.col("k") * 5), "k", "n", 2, 0.2).collect()} == {"test"}


def test_t17_splits_are_disjoint_and_repeatable(spark):
    d = spark.range(100).withColumnRenamed("id", "k")
    one, two = ({r.k: r.split for r in split.stratified(x, "k", [], 0.7, 0.2, "s").collect()} for x in (d, d.repartition(9)))
    sizes = [list(one.values()).count(x) for x in ("train", "val", "test")]
    assert one == two and sizes == [70, 20, 10]


def test_t20_negative_classes_count_from_the_end(spark):
    d = spark.createDataFrame([(0, 0), (0, -1), (1, 3), (3, 0), (2, 2)], "t int, p int")
    assert {(r.t, r.p): (r.n, r.share) for r in metrics.confusion(d, "t", "p", 3).collect()} == {(0, 0): (1, 0.5), (0, 2): (1, 0.5), (2, 2): (1, 1.0)}


def test_t22_bins_may_overlap_and_the_first_wins_only_where_said(spark):
    d = spark.createDataFrame([("s", 0, 1.0, 6), ("s", 1, 2.0, 6)], "seq string, pos long, v double, len long")
    assert {r.bin for r in importance.critical(d, "seq", "pos", "v", "len", [(1, 10), (5, 20)]).collect()} == {0, 1}


def test_t23_a_constant_column_scales_to_zero(spark):
    d = spark.createDataFrame([(7.0,), (7.0,)], "v double")
    assert {r.x for r in sequence.scaled(d, "v", "x").collect()} == {0.0}


def test_t25_what_cleaning_drops_is_gone(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "k int, y string, fen string")
    assert guards.aligned(d, ["k", "fen", "game_id"]).columns == ["k", "fen", "game_id"]


def test_t28_softmax_only_where_it_belongs(spark):
    from plystream.operators import graphops

    d = spark.createDataFrame([(1, 2.0, 1000.0), (1, 3.0, 0.0)], "dst int, logit double, time double")
    got = [r.alpha for r in graphops.decay_attention(d, "dst", "logit", "time", 1.0).collect()]
    assert sum(got) == pytest.approx(1.0)
    assert [r.w for r in d.select(batches.edge_time(F.lit(1), F.col("time")).alias("w")).collect()] == [500.0, 0.0]


def test_modes_and_configuration(log):
    full = fitted(log, status="status", mode="time_decay_status").transform(log)
    assert full.columns == ["case", "event_ids", "labels", "features", "edge_times", "edge_types", "node_times"]
    assert fitted(log).transform(log).columns[4:] == ["edge_times", "node_times"]
    with pytest.raises(ValueError, match="unknown mode: odd"):
        fitted(log, mode="odd")
    with pytest.raises(ValueError, match="needs a status"):
        fitted(log, mode="status")
    with pytest.raises(ValueError, match="unknown configuration: kase"):
        resolve(kase="x")
    with pytest.raises(RuntimeError, match="fit first"):
        LogTransformer(resolve()).transform(log)
    with pytest.raises(ValueError, match="more than 2 values"):
        fitted(log, most=2)
