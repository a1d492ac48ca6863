"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. The text is read back by
a deterministic parser and compared with its source; what does not come back is
escaped, and compared again, until it is identical. Text that comes back anyway
stays as it is.

The escape puts one backslash between ``<`` and ``|`` (after those that are there),
the parser takes one away. In roles %, <, line ends are written as %25, %3C, %0A.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text, ok>>.

    ok is false for a turn that breaks the grammar; what stands before the first
    turn makes a turn of its own that isn't ok.
    """
    pieces = F.split(formatted, r"<\|im_start\|>", -1)

    def turn(piece: Column) -> Column:
        line, end = F.instr(piece, "\n"), F.instr(piece, END)
        size = F.length(piece)
        return F.struct(
            unescape_role(F.substring(piece, 1, line - 1)).alias("role"),
            unescape_text(F.substring(piece, line + 1, end - line - 1)).alias("text"),
            ((line > 0) & (end > line) & (F.substring(piece, end + len(END), size) == "\n")).alias("ok"),
        )

    def stray(piece: Column) -> Column:
        return F.struct(F.lit("").alias("role"), piece.alias("text"), F.lit(False).alias("ok"))

    turns = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
    return F.when(F.element_at(pieces, 1) == "", turns).otherwise(F.concat(F.array(stray(F.element_at(pieces, 1))), turns))


def _same(formatted: Column, role: Column, text: Column) -> Column:
    return parse(formatted) == F.array(F.struct(role.alias("role"), text.alias("text"), F.lit(True).alias("ok")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, turns (parsed back), mask, escaped_turns.

    `turns` has conv_id, turn, role, text; other columns are left out. turns: array<struct<role, text, ok>>,
    read back from formatted. mask: the assistants' texts in order, unescaped, with the place of each
    in formatted: array<struct<start, length, text>>, in code points. Turns stand by turn number, equal numbers by role,
    then text; repeated rows are repeated turns; nulls count as empty text or role, null conv_ids
    as one conversation; an empty table gives an empty one. A conversation that does not
    come back identical once everything is escaped ends the query with an error.
    """
    clean = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    role, text = F.col("role"), F.col("text")
    # Each turn on its own: as it is, else with its text escaped, else with its role escaped as well.
    tried = clean.withColumn("tried", F.when(_same(render_turn(role, text), role, text), 0)
                             .when(_same(render_turn(role, escape_text(text)), role, text), 1).otherwise(2))
    written = tried.select(
        "conv_id",
        F.struct(
            "turn", "role", "text",
            F.when(F.col("tried") == 2, escape_role(role)).otherwise(role).alias("as_role"),
            F.when(F.col("tried") > 0, escape_text(text)).otherwise(text).alias("as_text"),
            (F.col("tried") > 0).alias("escaped"),
        ).alias("t"),
    )
    one = written.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("source"))
    as_source = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.lit(True).alias("ok")))
    whole = lambda r, x: F.array_join(F.transform("source", lambda t: render_turn(r(t), x(t))), "")
    first = one.withColumn("formatted", whole(lambda t: t["as_role"], lambda t: t["as_text"]))
    # Then all turns together; if they don't come back, everything is escaped.
    again = first.withColumn("formatted", F.when(parse(F.col("formatted")) == as_source, F.col("formatted"))
                             .otherwise(whole(lambda t: escape_role(t["role"]), lambda t: escape_text(t["text"]))))
    back = again.withColumn("turns", parse(F.col("formatted")))
    checked = back.withColumn("turns", F.when(F.col("turns") == as_source, F.col("turns")).otherwise(
        F.raise_error(F.lit("a conversation does not come back from its formatted text"))))
    spans = F.aggregate(
        F.transform(F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, F.size("source")), lambda p: F.struct(
            F.instr(p, "\n").alias("line"), F.instr(p, END).alias("end"), F.length(p).alias("size"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["size"] + len(START)).alias("at"),
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + len(START) + p["line"]).alias("start"), (p["end"] - p["line"] - 1).alias("length")))).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    mask = F.transform(
        F.filter(F.arrays_zip(spans.alias("span"), F.col("turns").alias("turn")), lambda z: z["turn"]["role"] == "assistant"),
        lambda z: F.struct(z["span"]["start"].alias("start"), z["span"]["length"].alias("length"), z["turn"]["text"].alias("text")),
    )
    return checked.select(
        "conv_id", "formatted", "turns", mask.alias("mask"),
        F.size(F.filter("source", lambda t: t["escaped"])).alias("escaped_turns"),
    )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what format_conversations() read back."""
    said = F.array_join(F.transform("mask", lambda m: m["text"]), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("escaped_turns").cast("long").alias("escaped_turns"),
    )
