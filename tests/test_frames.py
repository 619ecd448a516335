"""Compressed sources by frames."""

import random
import zipfile
from pathlib import Path

import pytest
import zstandard
from plystream.plans import streams
from plystream.sources import files, frames, listed


def written(path, pieces, **how):
    with open(path, "wb") as f:
        for p in pieces:
            f.write(p if isinstance(p, bytes) and p[:4] == b"\x50\x2a\x4d\x18" else zstandard.ZstdCompressor(**how).compress(p))


def plain(text, marker):
    """Records of a whole text, line by line."""
    out, now = [], b""
    for line in text.splitlines(keepends=True):
        if line.startswith(marker):
            out += [now] * bool(now.strip())
            now = b""
        now += line
    return out + [now] * bool(now.strip())


@pytest.mark.parametrize("how", [{}, {"write_checksum": True}, {"write_content_size": False}, {"level": 19}])
def test_headers_say_where_frames_are(tmp_path, how):
    rng = random.Random(1)
    pieces = [b"", b"a" * 500_000, rng.randbytes(300_000), b"x", b"\x50\x2a\x4d\x18\x05\x00\x00\x00abcde", rng.randbytes(70_000) + b"z" * 10]
    written(tmp_path / "f.zst", pieces, **how)
    data = (tmp_path / "f.zst").read_bytes()
    found = frames.frames(str(tmp_path / "f.zst"))
    assert [zstandard.ZstdDecompressor().decompressobj().decompress(data[a:b]) for a, b in found] == [p for p in pieces if p[:4] != b"\x50\x2a\x4d\x18"]
    assert found[-1][1] == len(data)


def test_broken_files_are_an_error(tmp_path):
    written(tmp_path / "f.zst", [b"abc" * 1000])
    data = (tmp_path / "f.zst").read_bytes()
    for bad, said in ((data[:-5] , "ends inside"), (data + b"junk", "no frame at"), (b"PK\x03\x04" + data, "no frame at")):
        (tmp_path / "g.zst").write_bytes(bad)
        if said == "ends inside":
            (tmp_path / "g.zst").write_bytes(bad[:6])
        with pytest.raises(ValueError, match=said):
            frames.frames(str(tmp_path / "g.zst"))


@pytest.mark.parametrize("marker", [b"[Event ", b""])
def test_records_at_every_cut(marker):
    """However a text is cut into partitions and chunks, each record comes once, from the partition with the line end before it."""
    rng = random.Random(2)
    for _ in range(300):
        text = b"".join(rng.choice([b"[Event x\n", b"\n", b"[Event ", b"1. e4 [Event 1-0\n", b"e5\n", b"[Eve", b"\xff\n"]) for _ in range(rng.randint(0, 14)))
        cuts = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(rng.randint(0, 4)))})
        got = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            chunk = rng.randint(1, 9)
            stream = [(text[i : min(i + chunk, b)], True) for i in range(a, b, chunk)] + [(text[i : i + chunk], False) for i in range(b, len(text), chunk)]
            got += frames.records(iter(stream), marker, a == 0)
        assert got == plain(text, marker), (text, cuts)


def test_one_file_is_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    games = [f'[Event "{i}"]\n\n' + "".join(rng.choice("abc \n") for _ in range(rng.randint(0, 3000))) + "\n" for i in range(800)]
    text = "".join(games).encode().replace(b"ab", b"a\xff")
    cuts = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(40))})
    written(tmp_path / "g.zst", [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    rows = frames.zstd(spark, str(tmp_path / "g.zst"), "[Event ", 20_000)
    assert rows.rdd.getNumPartitions() > 10
    got = listed.zst_games(spark, str(tmp_path / "g.zst"), 20_000).orderBy("local_id").collect()
    assert [r.local_id for r in got] == list(range(1, 801))
    assert [r.pgn for r in got] == [g.decode("utf-8", "replace") for g in plain(text, b"[Event ")]
    written(tmp_path / "one.zst", [text])
    assert listed.zst_games(spark, str(tmp_path / "one.zst")).count() == 800


def test_a_table_is_staged_once(spark, tmp_path):
    lines = "id,name\n" + "".join(f"{i},n{i}\n" for i in range(500))
    written(tmp_path / "t.csv.zst", [lines[:1000].encode(), lines[1000:].encode()])
    source, target = str(tmp_path / "t.csv.zst"), str(tmp_path / "out")
    for _ in range(2):
        assert sorted(map(tuple, frames.staged_table(spark, source, target, "id int, name string", 10).collect())) == [(i, f"n{i}") for i in range(500)]
        source = source if files.exists(spark, f"{target}/_SUCCESS") else "nowhere"
    assert frames.staged_table(spark, "nowhere", target, "id int, name string").count() == 500  # what is there is taken
    (tmp_path / "out" / "_SUCCESS").unlink()
    assert frames.staged_table(spark, str(tmp_path / "t.csv.zst"), target, "id int, name string").count() == 500  # what was not finished is not


def test_many_files_are_one_count(spark, tmp_path):
    """Files are written by as many tasks as shuffles have, each with a share of the rows, and numbered on across them."""
    df = spark.range(1000).selectExpr("id", """'[Event "' || id || '"]\n\n1. e4\n' as game""").repartition(3)
    dealt = frames.by_order(df, "id")
    sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= 8 and max(sizes) < 400
    path = f"file://{tmp_path}/games"
    frames.write_zstd(dealt, path, "game", 50)
    got = listed.zst_games(spark, path, 1, across=True).orderBy("local_id").collect()
    assert [(r.local_id, r.pgn) for r in got] == [(i + 1, f'[Event "{i}"]\n\n1. e4\n') for i in range(1000)]
    assert len({r.path for r in got}) >= 8
    assert listed.zst_games(spark, path).where("local_id = 1").count() == len({r.path for r in got})  # each file by itself
    for few in (1, 1000):  # ranges without rows are files without a header
        lines, path, target = df.where(f"id < {few}").selectExpr("id", "id || ',n' || id || '\n' as line"), f"file://{tmp_path}/csv{few}", f"file://{tmp_path}/staged{few}"
        frames.write_zstd(frames.by_order(lines, "id"), path, "line", 10, "id,name\n")
        assert sorted(map(tuple, frames.staged_table(spark, path, target, "id int, name string", 10).collect())) == [(i, f"n{i}") for i in range(few)]


def test_plans_write_by_many_tasks(spark):
    """No query deals all of a table to one task."""
    assert "repartition(1)" not in Path(streams.__file__).read_text()


def test_zip_members_are_streamed(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("t.csv", "pgn\n" + "".join(f'"game {i}\nmore"\n' for i in range(3000)))
    got = listed.zip_games(spark, str(tmp_path / "z.zip")).orderBy("local_id").collect()
    assert [(r.local_id, r.pgn) for r in got] == [(i + 1, f"game {i}\nmore") for i in range(3000)]
