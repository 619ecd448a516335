"""The store of windows: commits, repeats, breaks, splits and pending rows."""

import pytest
from plystream.sources import files, store
from plystream.streaming import ingest
from pyspark.sql import functions as F

SCHEMA = "game_id string, mate_n int, positions array<int>, source string, number long"


def batch(spark, lo, hi, empty=()):
    return spark.createDataFrame([(f"g{i}", i % 2, [] if i in empty else [i], f"lichess:{i % 3}", i) for i in range(lo, hi)], SCHEMA)


def opened(spark, path, **how):
    return store.WindowStore(spark, f"{path}/store", "game_id", "mate_n", "positions", 0.5, 0.25, **how)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    s = opened(spark, tmp_path)
    assert s.windows() is None and s.checkpoint() == {}
    assert s.add(batch(spark, 0, 10, empty={3}), 0, {"lichess:a": 7}) and not s.add(batch(spark, 5, 20), 0, {"lichess:a": 99})
    assert s.add(batch(spark, 10, 20), 1, {"lichess:a": 5, "fics:b": 2})
    assert s.windows().count() == 19 and s.state()["offsets"] == {"lichess:a": 7, "fics:b": 2}
    assert opened(spark, tmp_path).windows().count() == 19  # whoever opens it


@pytest.mark.parametrize("bad", [[("g1", 0, [1], "s", 1)], [("new", 0, [1], "s", 1)] * 2, [(None, 0, [1], "s", 1)]])
def test_keys_that_are_there_already_are_an_error(spark, tmp_path, bad):
    s = opened(spark, tmp_path)
    s.add(batch(spark, 0, 4), 0)
    with pytest.raises(ValueError, match="null or there already"):
        s.add(spark.createDataFrame(bad, SCHEMA), 1)
    assert s.windows().count() == 4 and s.add(batch(spark, 4, 6), 1)


def test_breaks_leave_the_old_state(spark, tmp_path, monkeypatch):
    s = opened(spark, tmp_path)
    s.add(batch(spark, 0, 20), 0)
    counts = s.checkpoint()
    assert counts == {"train": 10, "val": 4, "test": 6}  # of each group 5, int(2.5) and the rest
    before = sorted(s.splits().collect())
    publish = files.publish

    def broken(*_):
        raise OSError("killed")

    monkeypatch.setattr(files, "publish", broken)  # after the files, before the marker
    with pytest.raises(OSError):
        s.add(batch(spark, 20, 40), 1)
    with pytest.raises(OSError):
        s.checkpoint()
    assert opened(spark, tmp_path).windows().count() == 20 and sorted(opened(spark, tmp_path).splits().collect()) == before
    monkeypatch.setattr(files, "publish", publish)
    s.add(batch(spark, 20, 40), 1)  # over what was left
    assert sum(s.checkpoint().values()) == 40 and s.checkpoint() == s.checkpoint()
    commits = f"{tmp_path}/store/commits"
    open(f"{commits}/{999:012}.json", "w").write('{"batches": [')  # a marker that was never finished
    assert opened(spark, tmp_path).windows().count() == 40


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    s = opened(spark, tmp_path)
    for k in range(2):
        batch(spark, 10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        writer = stream.writeStream.foreachBatch(store.sink(s, store.furthest("source", "number"), every=2)).option("checkpointLocation", f"{tmp_path}/mark")
        ingest.started(writer, spark)
        assert s.state()["batches"] == list(range(k + 1)) and s.state()["offsets"]["lichess:0"] == [9, 18][k]
    assert s.splits().count() == 20  # after the second batch


def test_pending_rows_wait_for_their_split(spark, tmp_path):
    rows = lambda lo: spark.createDataFrame([(f"g{i}", i) for i in range(lo, lo + 3)], "game_id string, x int")
    at = f"{tmp_path}/pending"
    assert store.merge_pending(spark, at, rows(0), 0) is None
    known = spark.createDataFrame([("g1", "train"), ("g4", "test")], "game_id string, split string")
    for _ in range(2):  # the second time is a repeat
        ready, waiting = store.merge_pending(spark, at, rows(3), 1, known)
        assert sorted((r.game_id, r.split) for r in ready.collect()) == [("g1", "train"), ("g4", "test")]
        assert sorted(r.x for r in waiting.select(F.col("x")).collect()) == [0, 2, 3, 5]
