"""Scalar functions on game text: clocks, time controls, ratings, moves, themes, positions. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(comment: Column, tag: str) -> Column:
    """Seconds of a [%tag H:MM:SS(.f)] note; null if there is none."""
    part = lambda i: F.regexp_extract(comment, rf"\[\s*%{tag}\s+(\d+):(\d+):(\d+(?:\.\d+)?)\s*\]", i)
    return F.when(part(1) != "", part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double"))


def time_control(c: Column) -> tuple[Column, Column]:
    """Base and increment of ``b+i`` or ``b``; 0 and 0 for anything else."""
    part = lambda i: F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d+)(?:\+(\d+))?$", i)
    return tuple(F.coalesce(F.nullif(part(i), F.lit("")).cast("bigint"), F.lit(0).cast("bigint")) for i in (1, 2))


def rating(c: Column) -> Column:
    """Permissive: a number, or the digits in the text."""
    return F.coalesce(F.trim(c).try_cast("bigint"), F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")).try_cast("bigint"))


def rating_strict(c: Column) -> Column:
    n = F.trim(c).try_cast("bigint")
    return F.when(n > 0, n)


def time_forfeit(termination: Column) -> Column:
    return F.contains(F.coalesce(termination, F.lit("")), F.lit("Time forfeit"))


def headers_eligible(result: Column, termination: Column, white: Column, black: Column, least: int | None = None, most: int | None = None,
                     decisive: tuple[str, ...] | None = ("1-0", "0-1"), forfeits: bool = False) -> Column:
    """A decisive result, no loss on time, the better rating at least ``least`` and the worse at most ``most``; without any
    rating the bounds play no part."""
    ok = F.lit(True) if decisive is None else F.coalesce(result, F.lit("")).isin(*decisive)
    if not forfeits:
        ok = ok & ~time_forfeit(termination)
    best, worst = F.greatest(white, black), F.least(white, black)
    if least is not None:
        ok = ok & (best.isNull() | (best >= least))
    return ok if most is None else ok & (worst.isNull() | (worst <= most))


def game_hard_eligible(game: Column, plies: Column, least: int, white: Column, black: Column) -> Column:
    """There is a game of ``least`` plies or more and both players have a rating above 0."""
    return game.isNotNull() & (plies >= least) & F.coalesce((white > 0) & (black > 0), F.lit(False))


def encode_move(src: Column, dst: Column, promotion: Column) -> Column:
    return (src * 64 + dst) * 5 + promotion


def decode_move(m: Column) -> tuple[Column, Column, Column]:
    q = F.floor(m / 5)
    return F.floor(q / 64), q % 64, m % 5


def first_uci(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(c), r"\b([a-h][1-8][a-h][1-8][qrbn]?)\b", 1), F.lit(""))


#: A move in algebraic notation: fixed by the format.
SAN = r"\b(O-O-O|O-O|[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?[+#]?)\b"


def san_candidates(c: Column) -> Column:
    """All that can be moves in algebraic notation, in order; null if there is no text."""
    return F.regexp_extract_all(c, F.lit(SAN), 1)


#: What a prompt says around a position.
BEFORE_POSITION, AFTER_POSITION = "\n\nFEN: ", "\nBest move (UCI):"


def move_prompt(fen: Column, instruction: str) -> Column:
    """A prompt that asks for the best move of a position: the instruction, the position, and the line to be completed."""
    return F.concat(F.lit(instruction + BEFORE_POSITION), fen, F.lit(AFTER_POSITION))


def mating_material(fen: Column, least: int, ahead: int) -> Column:
    """The side to move has ``least`` points of material, and ``ahead`` more than the other."""
    mine, other = (F.when(white_to_move(fen), material(fen, a)).otherwise(material(fen, not a)) for a in (True, False))
    return (mine >= least) & (mine - other >= ahead)


def tablebase_no_mate(fen: Column, wdl: Column) -> Column:
    """A tablebase says that the side to move does not win. It says nothing of positions with castling rights, or without a
    verdict."""
    rights = F.coalesce(F.get(F.split(fen, " "), F.lit(2)), F.lit("-"))
    return F.when(~rights.rlike("[KQkq]"), F.coalesce(wdl <= 0, F.lit(False))).otherwise(False)


def mate_theme(themes: Column) -> Column:
    """n of the first mateInN theme, 0 if none."""
    return F.coalesce(F.nullif(F.regexp_extract(themes, r"(?:^|\s)mateIn(\d+)(?=\s|$)", 1), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))


def board(fen: Column) -> Column:
    return F.substring_index(fen, " ", 1)


def white_to_move(fen: Column) -> Column:
    return F.split(fen, " ")[1] == "w"


def pieces(fen: Column, kinds: str) -> Column:
    """How many of these pieces stand on the board."""
    return F.char_length(F.regexp_replace(board(fen), f"[^{kinds}]", "")).cast("bigint")


def material(fen: Column, white: bool) -> Column:
    """Pawns 1, knights and bishops 3, rooks 5, queens 9."""
    values = {"p": 1, "n": 3, "b": 3, "r": 5, "q": 9}
    total = F.lit(0).cast("bigint")
    for k, v in values.items():
        total = total + pieces(fen, k.upper() if white else k) * v
    return total


def kings_present(fen: Column) -> Column:
    return (pieces(fen, "K") == 1) & (pieces(fen, "k") == 1)


def trivially_drawn(fen: Column) -> Column:
    """No queen, rook or pawn, and at most one minor piece on each side."""
    return (pieces(fen, "QqRrPp") == 0) & (pieces(fen, "NB") <= 1) & (pieces(fen, "nb") <= 1)


def sanitised_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_")


def split_games(text: Column) -> Column:
    """The games of a text as an array: a new one begins at each line that starts with ``[Event ``."""
    return F.filter(F.split(text, r"(?m)^(?=\[Event )"), lambda g: F.trim(g) != "")


def header(game: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(game, rf'(?m)^\[{name} "([^"]*)"\]', 1), F.lit(""))


def squares(fen: Column) -> Column:
    """The 64 squares as an array of one character each, a1 first, ``.`` where empty."""
    rows = board(fen)
    for n in range(1, 9):
        rows = F.regexp_replace(rows, str(n), "." * n)
    return F.filter(F.split(F.array_join(F.reverse(F.split(rows, "/")), ""), ""), lambda c: c != "")


def square_id(c: Column) -> Column:
    """0 for an empty square, else twice the kind (pawn 1 to king 6), plus 1, plus 1 for white."""
    kind = F.array_position(F.array(*map(F.lit, "pnbrqk")), F.lower(c)).cast("int")
    return F.when(kind > 0, kind * 2 + 1 + (c != F.lower(c)).cast("int")).otherwise(0)


def theme_token(themes: Column, wanted: list[int]) -> Column:
    """The first n of ``wanted`` whose mateInN is a whole theme; null if none is."""
    return F.coalesce(*[F.when(F.array_contains(F.split(themes, " "), f"mateIn{n}"), F.lit(n)) for n in wanted])


def heavy_piece(fen: Column) -> Column:
    """The side to move has a queen or a rook."""
    return F.when(white_to_move(fen), pieces(fen, "QR")).otherwise(pieces(fen, "qr")) > 0


def good_position(fen: Column, most: int) -> Column:
    """Both kings, no trivial draw, a heavy piece of the side to move, and at most ``most`` pieces."""
    return kings_present(fen) & ~trivially_drawn(fen) & heavy_piece(fen) & (pieces(fen, "A-Za-z") <= most)


def node_features(fen: Column) -> Column:
    """For each square, whether a piece of the mover or of the opponent stands there."""
    def of(c: Column) -> Column:
        taken, mine = c != ".", (c != F.lower(c)) == white_to_move(fen)
        return F.struct((taken & mine).cast("int").alias("mover"), (taken & ~mine).cast("int").alias("opponent"))

    return F.transform(squares(fen), of)
