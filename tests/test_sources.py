import pytest

from plystream.operators import cases
from plystream.sources import games
from plystream.streaming import ingest

TEXT = '[Event "a"]\n[Result "1-0"]\n\n1. e4 e5 1-0\n\n[Event "b"]\n\n1. d4 [Event 0-1\n[Event "c"]\n1. c4 *\n'


def test_games_are_split_at_line_starts_and_numbered(spark, tmp_path):
    (tmp_path / "g.pgn").write_text(TEXT)
    rows = games.pgn_games(spark, str(tmp_path / "g.pgn"), "t").orderBy("local_id").collect()
    assert [r.local_id for r in rows] == [1, 2, 3]
    assert [r.pgn[:10] for r in rows] == ['[Event "a"', '[Event "b"', '[Event "c"']
    assert "[Event 0-1" in rows[1].pgn


def test_the_limit_counts_after_what_is_skipped(spark, tmp_path):
    (tmp_path / "g.pgn").write_text(TEXT)
    assert [r.local_id for r in games.pgn_games(spark, str(tmp_path / "g.pgn"), "t", skip=1, most=1).collect()] == [2]


def test_numbers_go_on_over_blocks(spark, tmp_path):
    (tmp_path / "g.pgn").write_text("".join(f'[Event "{i}"]\n1. e4 *\n' for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = games.pgn_games(spark, str(tmp_path / "g.pgn"), "t").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.local_id, r.pgn.split('"')[1]) for r in rows) == [(i + 1, str(i)) for i in range(2000)]


def test_malformed_lines_go(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"problem_id": "a", "ply": 1}\n\n{oops\n{"problem_id": null, "ply": 2}\n')
    assert sorted(r.ply for r in games.debug_records(spark, str(tmp_path / "d.jsonl"), "problem_id string, ply int").collect()) == [1, 2]


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.range(10).write.parquet(src)
    for _ in range(2):
        ingest.ingest(spark, src, "id long", out, mark)
    assert spark.read.parquet(out).count() == 10
    spark.range(10, 15).write.mode("append").parquet(src)
    ingest.ingest(spark, src, "id long", out, mark)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(15))


@pytest.mark.parametrize(("losses", "stop"), [([3.0, 2.0, 2.5, 2.4, 1.0], 3), ([3.0, 2.0, 1.0], None)])
def test_early_stop(spark, losses, stop):
    d = spark.createDataFrame([("r", i, x) for i, x in enumerate(losses)], "run string, epoch int, loss double")
    assert cases.early_stop(d, "run", "epoch", "loss", 2).first().stop == stop


def test_results_with_nothing_in_them(spark, tmp_path):
    (tmp_path / "r.csv").write_text('problem_id,mate_pred,best_move_uci,move_correct\np1,None,"",True\np2,,e2e4,False\np3,-2," ",\np4,odd,None,true\n')
    got = games.results(spark, str(tmp_path / "r.csv"), "problem_id string, move_correct boolean, mate_pred int, best_move_uci string, mate_n int")
    assert sorted(tuple(r) for r in got.collect()) == [("p1", True, None, None, None), ("p2", False, None, "e2e4", None), ("p3", None, -2, None, None), ("p4", True, None, None, None)]
