"""Queries on records of games and puzzles: ratings, positions, formats and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from plystream.functions import parse
from plystream.plans.registry import query
from plystream.plans.sources import literals
from plystream.sources import games

RATED = "(values (1, '1500', ' 1320 '), (2, '1500?', '1200'), (3, '', '1200'), (4, '0', '900'), (5, null, '1'), (6, '-5', '7')) as t(i, a, b)"


@query("ratings_strict", f"select i from {RATED} where try_cast(trim(a) as int) > 0 and try_cast(trim(b) as int) > 0")
def ratings_strict(spark, sf):
    ok = lambda c: F.trim(c).try_cast("int") > 0
    return literals(spark, RATED).where(ok(F.col("a")) & ok(F.col("b"))).select("i")


FENS = """(values (1, '7k/8/8/8/8/8/8/K6R w'), (2, '7k/8/8/8/8/8/8/KN5b b'), (3, 'rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w'), (4, '8/8/8/8/8/8/8/K7 w'), (5, 'q6k/8/8/8/8/8/8/K6N b')) as t(i, fen)"""
B = "split_part(fen, ' ', 1)"
N = lambda kinds: f"length(regexp_replace({B}, '[^{kinds}]', '', 'g'))"
KINGS, DRAWN = f"({N('K')} = 1 and {N('k')} = 1)", f"({N('QqRrPp')} = 0 and {N('NB')} <= 1 and {N('nb')} <= 1)"
HEAVY = f"(case when split_part(fen, ' ', 2) = 'w' then {N('QR')} else {N('qr')} end > 0)"


@query("fen_kings_present", f"select i, {KINGS} as ok from {FENS}")
def fen_kings_present(spark, sf):
    return literals(spark, FENS).select("i", parse.kings_present(F.col("fen")).alias("ok"))


@query("fen_trivial_endgame", f"select i, {DRAWN} as ok from {FENS}")
def fen_trivial_endgame(spark, sf):
    return literals(spark, FENS).select("i", parse.trivially_drawn(F.col("fen")).alias("ok"))


@query("fen_heavy_piece", f"select i, {HEAVY} as ok from {FENS}")
def fen_heavy_piece(spark, sf):
    return literals(spark, FENS).select("i", parse.heavy_piece(F.col("fen")).alias("ok"))


@query("fen_piece_count", f"select i, {N('A-Za-z')} as n from {FENS}")
def fen_piece_count(spark, sf):
    return literals(spark, FENS).select("i", parse.pieces(F.col("fen"), "A-Za-z").alias("n"))


@query("fen_quality_filter", f"select i from {FENS} where {KINGS} and not {DRAWN} and {HEAVY} and {N('A-Za-z')} <= 20")
def fen_quality_filter(spark, sf):
    return literals(spark, FENS).where(parse.good_position(F.col("fen"), 20)).select("i")


@query("fen_node_features", f"""with e as (select i, split_part(fen, ' ', 2) = 'w' as white, {N('A-Z')} as w, {N('a-z')} as b from {FENS})
select i, case when white then w else b end as mover, case when white then b else w end as opponent from e""")
def fen_node_features(spark, sf):
    nodes = literals(spark, FENS).select("i", F.explode(parse.node_features(F.col("fen"))).alias("x"))
    return nodes.groupBy("i").agg(F.sum("x.mover").alias("mover"), F.sum("x.opponent").alias("opponent"))


@query("fen_mating_material", f"""with m as (select i, split_part(fen, ' ', 2) = 'w' as white, {N('P')} + 3 * {N('NB')} + 5 * {N('R')} + 9 * {N('Q')} as w, {N('p')} + 3 * {N('nb')} + 5 * {N('r')} + 9 * {N('q')} as b from {FENS})
select i from m where case when white then w >= 5 and w - b >= 2 else b >= 5 and b - w >= 2 end""")
def fen_mating_material(spark, sf):
    return literals(spark, FENS).where(parse.mating_material(F.col("fen"), 5, 2)).select("i")


WDL = "(values (1, '7k/8/8/8/8/8/8/K6R w - - 0 1', 2), (2, '7k/8/8/8/8/8/8/KN5b b - -', 0), (3, 'r3k2r/8/8/8/8/8/8/4K3 b kq -', -2), (4, '7k/8/8/8/8/8/8/K7 w', -1), (5, '7k/8/8/8/8/8/8/K6N b - -', null)) as t(i, fen, wdl)"


@query("tablebase_no_mate", f"select i, case when regexp_matches(split_part(fen, ' ', 3), '[KQkq]') then false else coalesce(wdl <= 0, false) end as none from {WDL}")
def tablebase_no_mate(spark, sf):
    return literals(spark, WDL).select("i", parse.tablebase_no_mate(F.col("fen"), F.col("wdl")).alias("none"))


@query("move_prompt", f"select i, 'Find the move.' || chr(10) || chr(10) || 'FEN: ' || fen || chr(10) || 'Best move (UCI):' as prompt from {FENS}")
def move_prompt(spark, sf):
    return literals(spark, FENS).select("i", parse.move_prompt(F.col("fen"), "Find the move.").alias("prompt"))


SAID = "(values (1, 'I play Nf3+, not O-O-O or exd8=Q#'), (2, 'Rook to e4: Re4'), (3, 'none'), (4, null), (5, 'Qh4xe1 then a1')) as t(i, s)"


@query("extract_san", f"select i, array_to_string(regexp_extract_all(s, '{parse.SAN}', 1), ' ') as moves from {SAID}")
def extract_san(spark, sf):
    return literals(spark, SAID).select("i", F.array_join(parse.san_candidates(F.col("s")), " ").alias("moves"))


MOVES = "(values (1, 'I play E2E4 now'), (2, 'a7a8q wins'), (3, 'no move: e9e4'), (4, null), (5, 'xe2e4 then d2d4')) as t(i, s)"


@query("extract_uci", rf"select i, nullif(regexp_extract(lower(s), '\b([a-h][1-8][a-h][1-8][qrbn]?)\b', 1), '') as uci from {MOVES}")
def extract_uci(spark, sf):
    return literals(spark, MOVES).select("i", parse.first_uci(F.col("s")).alias("uci"))


PUZZLES = "(values (1, 1400, 'mateIn1 short'), (2, null, 'endgame mateIn2'), (3, 1800, 'mateIn10 long'), (4, 900, 'crushing'), (5, 2100, 'mateIn2')) as t(i, rating, themes)"


@query("puzzle_counters", rf"""select count(*) as processed, count(*) filter (rating between 1000 and 2000) as rated, count(*) filter (regexp_matches(themes, '(^|\s)mateIn[12](\s|$)')) as themed,
count(*) filter (rating between 1000 and 2000 and regexp_matches(themes, '(^|\s)mateIn[12](\s|$)')) as accepted from {PUZZLES}""")
def puzzle_counters(spark, sf):
    rated, themed = F.col("rating").between(1000, 2000), parse.mate_theme(F.col("themes")).isin(1, 2)
    return literals(spark, PUZZLES).agg(F.count("*").alias("processed"), F.count_if(rated).alias("rated"), F.count_if(themed).alias("themed"), F.count_if(rated & themed).alias("accepted"))


HEADS = """(values (1, chr(10) || '  ' || chr(10) || '[Event "a"]'), (2, 'pgn,rules' || chr(10) || '[Event "a"]'), (3, ''), (4, '[Event "b"]')) as t(i, s)"""


@query("sniff_format", rf"select i, case when regexp_matches(s, '^\s*\[Event ') then 'pgn' else 'csv' end as format from {HEADS}")
def sniff_format(spark, sf):
    return literals(spark, HEADS).select("i", games.sniff(F.col("s")).alias("format"))


GAMES = "(values ('a', 1, 'x', 'Chess', 'TRUE'), ('a', 2, null, 'chess', 'true'), ('a', 3, 'y', 'bughouse', 'true'), ('a', 4, 'z', 'chess', 'true'), ('b', 1, 'v', 'chess', 'false'), ('b', 2, 'w', 'chess960', 'true')) as t(path, row, pgn, rules, rated)"


@query("holdout_csv_scan", f"select path, row, pgn, row_number() over (partition by path order by row) as local_id from {GAMES} where lower(rules) in ('chess', 'chess960') and lower(rated) = 'true' and pgn is not null")
def holdout_csv_scan(spark, sf):
    return games.numbered(literals(spark, GAMES).where(games.holdout_row(["chess", "chess960"])), "path", "row").select("path", "row", "pgn", "local_id")


@query("pgn_from_csv", f"select path, row, pgn from (select *, row_number() over (partition by path order by row) as n from {GAMES} where pgn is not null) where n > 1 and n <= 3")
def pgn_from_csv(spark, sf):
    """Nulls go first, then one row is skipped and two are kept of each file; rows keep their numbers, with gaps."""
    return games.numbered(literals(spark, GAMES).where("pgn is not null"), "path", "row").where("local_id > 1 and local_id <= 3").select("path", "row", "pgn")


@query("resume_offsets", f"select path, max(row) as done from {GAMES} group by path")
def resume_offsets(spark, sf):
    """How far each file has been taken: where the next run resumes."""
    return literals(spark, GAMES).groupBy("path").agg(F.max("row").alias("done"))
