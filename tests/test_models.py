import math

import bz2
import json
import zipfile

import numpy as np
import pytest
from plystream.operators import batches, clock, estimators, guards, metrics, models
from plystream.sources import listed, steps
from plystream.streaming import ingest
from pyspark.sql import functions as F

GAMES = [f'[Event "{i}"]\n[Result "1-0"]\n\n1. e4 {{caf\xe9}} [Event 1-0\n\n' for i in range(2500)]


def test_lists_of_sources():
    ok = [{"path": "a.pgn.zst", "tag": "a"}, {"path": "b.pgn", "tag": "b", "skip_games": 2}, {"path": "c.csv", "tag": "c", "max_games": 5}]
    found = listed.listed(ok, {"fics:b.pgn": 3, "fics:gone": 1})
    assert [(s.kind, s.skip, s.most) for s in found] == [("lichess", 0, None), ("fics", 5, None), ("csv", 0, 5)]
    assert listed.unused(found, {"fics:b.pgn": 3, "fics:gone": 1}) == ["fics:gone"]
    for bad, said in (([], "empty"), ([{"tag": "x"}], "path is missing"), ([{"path": "x"}], "tag is missing"), ([*ok, {"path": "d", "tag": "a"}], "tag a is there twice"), ([{"path": "x", "tag": "x", "kind": "odd"}], "unknown kind")):
        with pytest.raises(ValueError, match=said):
            listed.listed(bad)


def test_every_kind_is_read(spark, tmp_path):
    import zstandard

    text = "".join(GAMES)
    (tmp_path / "g.pgn").write_text(text, "utf-8")
    (tmp_path / "g.pgn.bz2").write_bytes(bz2.compress(text.encode()))
    (tmp_path / "g.pgn.zst").write_bytes(zstandard.compress(text.encode("latin-1")))  # bytes that are no UTF-8 are replaced
    table = "pgn,rules\n" + "".join('"' + g.replace('"', '""') + '",chess\n' for g in GAMES[:5]) + ",chess\n" + '"last",chess\n'
    (tmp_path / "t.csv").write_text(table, "utf-8")
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("in/t.csv", table)
        z.writestr("later.csv", "pgn\nno\n")
    entries = [{"path": str(tmp_path / n), "tag": n.replace(".", "")} for n in ("g.pgn", "g.pgn.bz2", "g.pgn.zst", "t.csv", "t.zip")]
    entries.append({"path": str(tmp_path / "g.pgn.zst"), "tag": "part", "skip_games": 1200, "max_games": 3})
    got = listed.read_all(spark, listed.listed(entries)).collect()
    count = {tag: sorted(r.local_id for r in got if r.source_tag == tag) for tag in {r.source_tag for r in got}}
    assert {t: len(x) for t, x in count.items()} == {"gpgn": 2500, "gpgnbz2": 2500, "gpgnzst": 2500, "tcsv": 6, "tzip": 6, "part": 3}
    assert all(x == list(range(x[0], x[0] + len(x))) for x in count.values()) and count["part"] == [1201, 1202, 1203]
    assert len({r.game_id for r in got}) == len(got) and {r.source_order for r in got} == set(range(6))
    for r in got:
        if r.source_tag.startswith("g") or r.source_tag == "part":
            assert r.pgn.startswith(f'[Event "{r.local_id - 1}"]') and ("caf�" in r.pgn) == (r.source_tag in ("gpgnzst", "part"))
    with pytest.raises(Exception, match="no column odd"):
        listed.zip_games(spark, str(tmp_path / "t.zip"), "odd").collect()


def test_manifest_and_shards(spark, tmp_path):
    with pytest.raises(Exception):  # noqa: B017
        listed.manifest(spark, str(tmp_path))
    (tmp_path / "manifest.json").write_text(json.dumps({"num_shards": 2, "shard_size": 3}))
    with pytest.raises(ValueError, match="lacks total"):
        listed.manifest(spark, str(tmp_path))
    (tmp_path / "manifest.json").write_text(json.dumps({"num_shards": 2, "shard_size": 3, "total": 5}, indent=2))
    assert listed.manifest(spark, str(tmp_path))["total"] == 5
    at = str(tmp_path / "s")
    spark.createDataFrame([(1, 5), (2, None)], "k int, y int").coalesce(1).write.parquet(at)
    (tmp_path / "s" / "part-bad.parquet").write_bytes(b"PAR1 this is no table PAR1")
    assert listed.shards(spark, at, "k int, y int").count() == 2
    with pytest.raises(Exception, match="y is null"):
        listed.shards(spark, at, "k int, y int", "y").collect()
    with pytest.raises(ValueError, match="no scalar"):
        listed.shards(spark, at, "k int, y array<int>", "y")


def test_steps_run_once_and_again_when_asked(spark, tmp_path):
    tried, out, calls = steps.Attempts(spark, f"{tmp_path}/attempts"), f"{tmp_path}/out", []

    def make():
        calls.append(1)
        return spark.range(len(calls))

    assert tried.unfinished({"a": out}) == ["a"] and tried.output("a", make, out).count() == 1 and tried.output("a", make, out).count() == 1
    assert tried.unfinished({"a": out, "b": out}) == ["b"] and tried.output("a", make, out, again=True).count() == 2
    (tmp_path / "out" / "_SUCCESS").unlink()  # an output that is not whole is made again
    assert not steps.ready(spark, out) and tried.output("a", make, out).count() == 3
    assert steps.ready(spark, out) and not steps.ready(spark, out, least=10**9)
    with pytest.raises(ZeroDivisionError):
        tried.output("b", lambda: spark.range(1 // 0), f"{tmp_path}/b", wait=[0.0, 0.0])
    assert [(r.step, r.attempt, r.outcome) for r in tried.table().orderBy("step", "attempt").collect()] == [("a", k, "written") for k in (1, 2, 3)] + [("b", k, "failed") for k in (1, 2, 3)]
    assert "division" in tried.last("b").error and tried.unfinished({"b": out}) == ["b"]


def test_a_job_is_tried_again_after_pauses(spark, tmp_path):
    left = [OSError("no"), OSError("no")]

    def flaky():
        if left:
            raise left.pop()
        return spark.range(7)

    tried = steps.Attempts(spark, f"{tmp_path}/attempts")
    assert tried.output("a", flaky, f"{tmp_path}/a", wait=steps.pauses(0.01, 2)).count() == 7 and tried.last("a").attempt == 3
    assert steps.pauses(2.0, 5) == [2.0, 4.0, 8.0, 16.0, 32.0] and steps.pauses(400.0, 2) == [400.0, 600.0]


def test_models_are_fitted_saved_and_loaded(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    rows = [(c, i, e, float(i)) for c in range(20) for i, e in enumerate("abcab" if c % 3 else "aab")]
    log = spark.createDataFrame(rows, "case_id int, ord int, event string, x double")
    model, score = models.evaluated(estimators.NextEvent(), log)
    assert score.first().accuracy > 0.5 and score.first().n == sum(5 if c % 3 else 3 for c in range(20)) - model.tables["contexts"].where("context is null").first().seen
    chain = Pipeline(stages=[estimators.SparseEncoder(categories=["event"], numbers=["x"]), estimators.NextEvent(history=2)])
    fitted = chain.fit(log)
    fitted.save(f"{tmp_path}/chain")
    again = PipelineModel.load(f"{tmp_path}/chain")
    want, got = (sorted(map(str, m.transform(log).collect())) for m in (fitted, again))
    assert got == want and again.stages[1].getOrDefault("history") == 2
    classes = [r["class"] for r in again.stages[1].classes().collect()]
    assert classes == ["EOS", "a", "b", "c"]
    proba = again.stages[1].predict_proba(log, classes)
    assert all(abs(sum(r.probability) - 1) < 1e-12 and r.prediction == classes[max(range(4), key=lambda k: (r.probability[k], -k))] for r in proba.collect())
    first = proba.where("case_id = 1").orderBy("ord").collect()
    assert [r.prediction for r in first] == ["b", "EOS", "a", "b", "EOS"] and first[0].probability == pytest.approx([0, 7 / 20, 13 / 20, 0])
    new = log.withColumn("event", F.lit("new"))
    assert {r.prediction for r in estimators.NextEvent().fit(log).transform(new).collect()} == {"b"}
    plain = estimators.NextEvent(history=0).fit(log)
    assert {r.prediction for r in plain.transform(log).collect()} == {"b"} and plain.transform(log).count() == len(rows)


def test_sparse_features(spark, tmp_path):
    rows = [("x", "p", 1.0), ("y", None, -1.0), ("x", "q", 3.0), (None, "p", None)]
    df = spark.createDataFrame(rows, "a string, b string, n double")
    model = estimators.SparseEncoder(categories=["a", "b"], numbers=["n"]).fit(df)
    assert sorted((r.column, r.token, r.id) for r in model.tables["tokens"].collect()) == [("a", "x", 0), ("a", "y", 1), ("b", "p", 2), ("b", "q", 3)] and model.size() == 5
    got = {(r.a, r.b): (r.features.indices, r.features["values"]) for r in model.transform(df.union(spark.createDataFrame([("odd", "q", 2.0)], df.schema))).collect()}
    assert got == {("x", "p"): ([0, 1, 3], [0.0, 1.0, 1.0]), ("y", None): ([0, 2], [-1.0, 1.0]), ("x", "q"): ([0, 1, 4], [1.0, 1.0, 1.0]), (None, "p"): ([0, 3], [-1.0, 1.0]), ("odd", "q"): ([0, 4], [0.5, 1.0])}
    many = estimators.SparseEncoder(categories=["t"]).fit(spark.range(30_000).select(F.concat(F.lit("t"), "id").alias("t")))  # more than any list of literals
    ids = many.tables["tokens"].orderBy("token").toPandas()
    assert ids.id.tolist() == list(range(30_000))
    many.save(f"{tmp_path}/m")
    assert estimators.SparseEncoderModel.load(f"{tmp_path}/m").size() == 30_000



def test_projection(spark):
    x = np.random.default_rng(1).normal(size=(60, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    d = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i int, v array<double>")
    got = np.array([r.projection for r in models.projected(d, "v").orderBy("i").collect()])
    axes = np.linalg.svd(x - x.mean(0))[2][:2]
    axes *= np.sign(axes[range(2), np.abs(axes).argmax(1)])[:, None]
    assert np.allclose(got, x @ axes.T)


def test_guards_that_fail(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    assert [r.k for r in guards.first_n(d, "k", 2).orderBy("k").collect()] == [1, 2]
    with pytest.raises(Exception, match="3 rows of 4"):
        guards.first_n(d, "k", 4).collect()
    other = spark.createDataFrame([(1, "train"), (2, "test")], "k int, split string")
    assert guards.total_join(d.where("k < 3"), other, "k", "split").count() == 2
    with pytest.raises(Exception, match="no split for k 3"):
        guards.total_join(d, other, "k", "split").collect()
    w = spark.createDataFrame([("a", [1]), ("b", []), ("c", [2])], "g string, w array<int>")
    assert [r.g for r in guards.whole_windows(w, "g", "w").orderBy("g").collect()] == ["a", "c"]
    with pytest.raises(Exception, match="g twice: a"):
        guards.whole_windows(w.union(w.limit(1)), "g", "w").collect()
    with pytest.raises(Exception, match="no valid label"):
        metrics.class_weights(spark.createDataFrame([(99,)], "y int"), "y", 5).collect()
    with pytest.raises(ValueError, match="unknown scheme"):
        metrics.class_weights(d, "k", 5, scheme="odd")


def test_packing_by_type(spark):
    e = lambda *x: spark.createDataFrame([(list(x),)], "e array<struct<type:int,time:double>>").select(batches.time_of_types(F.col("e")).alias("m"))
    assert e((0, 1.5), (1, 2.0), (0, 1.5)).first().m == {0: 1.5, 1: 2.0} and e().first().m == {}
    with pytest.raises(Exception, match="times differ in type 0"):
        e((0, 1.5), (0, 2.5)).collect()
    b = spark.createDataFrame([([0, 1],), ([0, 2],)], "x array<int>")
    assert b.limit(1).select(batches.binary(F.col("x"))).first()[0] == [False, True]
    with pytest.raises(Exception, match="not binary: 2"):
        b.select(batches.binary(F.col("x"))).collect()
    f = spark.createDataFrame([([[1.0, 2.0]],), ([],)], "f array<array<double>>").select(batches.with_end(F.col("f")).alias("f"))
    assert sorted(r.f for r in f.collect()) == [[], [[1.0, 2.0], [0.0, 0.0]]]


@pytest.mark.parametrize(("t", "df", "p"), [(2.0, 1, 0.29516723530086653), (2.0, 2, 0.18350341907227397), (2.0, 3, 0.13932596855884318), (1.5, 10, 0.16450657889710213), (-2.228138852, 10, 0.05), (1.96, 1001, 0.05027278)])
def test_tails_of_t(spark, t, df, p):
    assert spark.range(1).select(metrics.t_tails(F.lit(t), F.lit(df).cast("bigint"))).first()[0] == pytest.approx(p, rel=1e-5)


def exact_log10(t, df):
    """Both tails for an even number of degrees of freedom, by the finite sum in decimals of 700 digits."""
    from decimal import Decimal, localcontext

    with localcontext() as ctx:
        ctx.prec = 700
        t, df = Decimal(str(t)), Decimal(df)
        c2 = df / (df + t * t)
        term = total = Decimal(1)
        for k in range(1, int(df) // 2):
            term *= c2 * (2 * k - 1) / (2 * k)
            total += term
        return float((1 - (1 - c2).sqrt() * total).log10())


@pytest.mark.parametrize(("t", "df"), [(0.001, 2), (0.3, 4), (0.999, 2), (0.999, 600), (1.0, 2), (1.001, 600), (7.5, 200), (9.0, 1000), (10.0, 5000), (30.0, 2000), (45.0, 4000), (1e6, 2), (1e9, 40)])
def test_tails_of_t_keep_their_digits(spark, t, df):
    """Down to 1e-300 and below, where 1 - inside has none."""
    got = spark.range(1).select(metrics.log_t_tails(F.lit(-t), F.lit(df).cast("bigint"))).first()[0] / math.log(10)
    assert got == pytest.approx(exact_log10(t, df), rel=1e-10, abs=1e-12)


@pytest.mark.parametrize("t", [1e-6, 0.5, 0.99, 1.0, 2.0, 6.0, 20.0, 37.0])
def test_tails_of_a_normal(spark, t):
    """The limit of many degrees of freedom, by erfc."""
    got = spark.range(1).select(metrics.log_t_tails(F.lit(t), F.lit(None)).alias("a"), metrics.log_t_tails(F.lit(t), F.lit(10**14)).alias("b"), metrics.chi2_tail(F.lit(t * t)).alias("c")).first()
    want = math.erfc(t / math.sqrt(2))
    assert got.a == pytest.approx(math.log(want), rel=1e-12, abs=1e-14) and got.c == pytest.approx(want, rel=1e-11)
    assert got.b == pytest.approx(math.log(want), rel=1e-8, abs=1e-12)


def test_the_most_significant_are_told_apart(spark):
    """p below the smallest double is still ordered."""
    pairs = spark.createDataFrame([("a", "b", "**", -400.5, 1.0), ("a", "c", "**", -500.5, 1.0), ("a", "d", "*", -600.0, 1.0), ("b", "c", "**", -400.5, 2.0), ("b", "d", "", -1.0, 0.0)], "g_a string, g_b string, stars string, log10_p double, cohens_d double")
    assert [(r.g_a, r.g_b) for r in metrics.most_significant(pairs, 4).collect()] == [("a", "c"), ("b", "c"), ("a", "b"), ("a", "d")]


@pytest.mark.parametrize(("x", "p"), [(0.0, 1.0), (3.841458820694124, 0.05), (10.827566170662733, 0.001), (50.0, 1.5374597944280347e-12)])
def test_tail_of_chi_squared(spark, x, p):
    assert spark.range(1).select(metrics.chi2_tail(F.lit(x))).first()[0] == pytest.approx(p, rel=1e-9)


def test_clock_statistics_are_written(spark, tmp_path):
    d = spark.createDataFrame([(1.0 + i % 3, 1200, 1) for i in range(40)], "c double, r int, m int")
    clock.write_stats(clock.stats(d, "c", "r", "m", 300), f"{tmp_path}/stats")
    rows = spark.read.json(f"{tmp_path}/stats").collect()
    assert len(rows) == 3 and {r.n for r in rows} == {40}


def test_a_stream_flushes_by_time(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    query = ingest.append(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/mark", every="1 second")
    try:
        query.processAllAvailable()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 10
    finally:
        query.stop()


def test_state_of_cases_goes_on_over_batches(spark, tmp_path):
    from plystream.streaming import cases

    schema = "g string, ply long, pos string, side int, clk double"
    parts = [[("a", 0, "p", 0, 60.0), ("a", 1, "q", 1, 58.0), ("b", 0, "p", 0, None)], [("a", 2, "p", 0, 50.0), ("a", 4, "r", 0, 45.0), ("b", 2, "s", 0, 30.0), ("a", 5, "t", 1, 50.0)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = cases.accepted(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "g", "ply", "pos", "side", "clk", 100.0, 2.0, 3)
        ingest.append(s, f"{tmp_path}/out", f"{tmp_path}/mark")
    got = {(r.g, r.order): r.spent for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 0): 42.0, ("a", 1): 44.0, ("b", 0): None, ("a", 4): 17.0, ("b", 2): 72.0}  # ply 2 repeats p, ply 5 is the fourth


def test_idle_cases_are_forgotten(spark, tmp_path):
    """By their timers, whoever else has rows; what was seen before counts no more."""
    import time

    from plystream.streaming import cases

    schema = "g string, ply long, pos string, side int, clk double"
    for k, part in enumerate([[("a", 0, "p", 0, 60.0)], [("b", 0, "p", 0, 60.0)], [("a", 9, "p", 0, 50.0)]]):
        spark.createDataFrame([*part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = cases.accepted(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "g", "ply", "pos", "side", "clk", 100.0, 2.0, 1, forget=500)
        ingest.append(s, f"{tmp_path}/out", f"{tmp_path}/mark")
        kept = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/mark").selectExpr("key.k").collect()
        assert [r.k for r in kept] == [["a"], ["b"], ["a"]][k]
        time.sleep(0.6)
    got = {(r.g, r.order): r.spent for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 0): 42.0, ("b", 0): 42.0, ("a", 9): 52.0}


def test_a_case_takes_plain_rows():
    """Rows come one by one, in any order, and only the first of each position is held."""

    from types import SimpleNamespace

    from plystream.streaming.cases import DAY, Cases
    from pyspark.sql import Row

    class State:
        def __init__(self):
            self.value, self.items = None, []

        def get(self):
            return self.value if self.value is not None else self.items or None

        def update(self, v):
            self.value = v

        def appendList(self, v):
            self.items += v

    case, seen, last = Cases(60.0, 2.0, 3, DAY), State(), State()
    case.seen, case.last, case.handle = seen, last, SimpleNamespace(registerTimer=lambda at: None)
    now = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 5)
    row = Row("k", "o", "p", "s", "c")
    rows = [row(1, 4, "b", 0, 50.0), row(1, 2, "b", 0, 55.0), row(1, 3, "c", 1, float("nan")), row(1, 1, "a", None, 9.0), row(1, 5, "d", 0, 70.0), row(1, None, "a", 0, 1.0)]
    out = list(case.handleInputRows((1,), iter(rows), now))
    assert [(r.order, r.spent) for r in out] == [(1, None), (2, 7.0), (3, None)]
    assert last.value == (70.0, None, 3, 5) and seen.items == [("a",), ("b",), ("c",), ("d",)]
