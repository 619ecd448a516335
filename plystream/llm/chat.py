"""Chat formatting with typed content parts, in built-in functions only.

A conversation is a set of rows, one for each turn, with a role and an array of parts. Rendering visits the parts in
order: text is escaped and copied; an image, audio clip or document leaves a placeholder and an attachment record with
the number of tokens that the placeholder expands to. ``parse`` reads turns back from the output.

Template, for each turn: ``<|im_start|>`` role, new line, body, ``<|im_end|>`` and a new line. In bodies and roles ``<``,
any backslashes and ``|`` get one backslash more, so that no text can hold a control string; the step is reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Tokens that attachments expand to: pixels of an image patch's side, tokens for a second and for a page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 512


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    """As ``escape``, and new lines too, as the first one ends the role."""
    return escape(F.regexp_replace(F.regexp_replace(c, r"<(\\*)n>", r"<$1\\n>"), "\n", "<n>"))


def unescape_role(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unescape(c), "<n>", "\n"), r"<\\(\\*)n>", r"<$1n>")


def text_part(c: Column) -> Column:
    """One text as an array of parts."""
    null = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(F.lit("text").alias("type"), c.alias("text"), null("string").alias("ref"), null("int").alias("width"),
                            null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))


def _tokens(p: Column) -> Column:
    whole = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    image = F.ceil(whole(p["width"]) / PATCH) * F.ceil(whole(p["height"]) / PATCH)
    return (F.when(p["type"] == "image", image).when(p["type"] == "audio", F.ceil(whole(p["seconds"]) * PER_SECOND))
            .when(p["type"] == "document", whole(p["pages"]) * PER_PAGE).otherwise(0).cast("bigint"))


def _visit(p: Column) -> Column:
    """What a part leaves in the text. Unknown types are refused."""
    kind = p["type"]
    return (F.when(kind == "text", escape(F.coalesce(p["text"], F.lit(""))))
            .when(kind.isin("image", "audio", "document"), F.concat(F.lit("<|"), kind, F.lit("|>")))
            .otherwise(F.raise_error(F.concat(F.lit("unknown part type: "), F.coalesce(kind, F.lit("null")))).cast("string")))


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """Returns a row for each conversation: conv_id, formatted, loss (array of start and length in code points: the text
    parts of assistant turns), attachments (in the order of their placeholders: turn, type, ref, tokens),
    expanded_tokens, n_turns.

    Rows go by turn, null turns first; rows with equal turns by role, then by what they render to, so the result does
    not depend on row order; repeated rows are repeated turns. Null roles and texts count as empty, null parts as none,
    negative sizes as 0. Rows with a null conversation are one conversation. Extra columns are ignored; no rows give
    no rows. A conversation's output is one row, so it has to fit in a task; the work is linear in its turns and parts.
    """
    r = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                     F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts"))
    r = r.withColumn("pieces", F.transform("parts", _visit))
    r = r.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", F.array_join("pieces", ""), "parts")))
    # pieces of text, one a row, with the turn's head before them and its end after them
    frame = lambda text: F.struct(text.alias("text"), F.lit(None).cast(PART).alias("part"))
    said = F.transform(F.arrays_zip("pieces", "parts"), lambda x: F.struct(x["pieces"].alias("text"), x["parts"].alias("part")))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    r = r.select("conv_id", "n", "turn", "role", F.posexplode(F.concat(F.array(frame(head)), said, F.array(frame(F.lit(END))))).alias("at", "x"))
    size = F.char_length("x.text").cast("bigint")
    # a running sum over the conversation, in the order and the exchange of the turns
    ahead = F.coalesce(F.sum(size).over(Window.partitionBy("conv_id").orderBy("n", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    learnt = (F.col("role") == "assistant") & (F.col("x.part.type") == "text") & (size > 0)
    media = F.struct("turn", F.col("x.part.type").alias("type"), F.col("x.part.ref").alias("ref"), _tokens(F.col("x.part")).alias("tokens"))
    r = r.select("conv_id", F.struct("n", "at", "x.text", F.when(learnt, F.struct(ahead.alias("start"), size.alias("length"))).alias("loss"),
                                     F.when(F.col("x.part.type") != "text", media).alias("media")).alias("t"))
    g = r.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    kept = lambda name: F.transform(F.filter("t", lambda t: t[name].isNotNull()), lambda t: t[name])
    return g.select("conv_id", F.array_join(F.transform("t", lambda t: t["text"]), "").alias("formatted"), kept("loss").alias("loss"), kept("media").alias("attachments"),
                    F.aggregate(kept("media"), F.lit(0).cast("bigint"), lambda a, m: a + m["tokens"]).alias("expanded_tokens"),
                    F.element_at("t", -1)["n"].cast("bigint").alias("n_turns"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text): text is unescaped, placeholders stay."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: p != "")
    role = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substr(p, F.char_length(role(p)) + 2, F.char_length(p) - F.char_length(role(p)) - 1 - len(END))
    return F.transform(pieces, lambda p: F.struct(unescape_role(role(p)).alias("role"), unescape(body(p)).alias("text")))


def under_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order. Spans are cut from four bytes for each code point, so that none
    has to be counted to from the beginning."""
    cut = lambda w, s: F.decode(F.substring(w, (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int")), "UTF-32")
    wide = F.array(F.encode(formatted, "UTF-32"))
    return F.transform(wide, lambda w: F.array_join(F.transform(loss, lambda s: unescape(cut(w, s))), ""))[0]
