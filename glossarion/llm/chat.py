"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation::

    conversation := header turn*
    header       := "<|chat|>\\n" | "<|chat escaped|>\\n"
    turn         := "### " role ": " text "</turn>\\n"

Each conversation is rendered as it is, reparsed by ``parse_chat`` and compared
with its source. Where they differ the conflicting control strings are escaped (a
backslash before each) and the result is reparsed; where that still differs (say, a
text that ends in a backslash) every backslash, ``<``, ``#`` and ``:`` is escaped,
which leaves no control character inside a text at all and so always reads back.
The first level that reads back identically is the one that is kept.

Rows of one conversation are gathered, for one string is made of them. Defined
results: null role or text is the empty string; a null ``conv_id`` is a conversation
of its own; turns are ordered by turn (nulls first), then role, then text, so that
ties and repeated rows have one order; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN_HEADER = "<|chat|>\n"
ESCAPED_HEADER = "<|chat escaped|>\n"
TURN_OPEN, ROLE_END, TURN_CLOSE = "### ", ": ", "</turn>\n"
#: What the parser takes for control unless a backslash stands before it.
CONTROL = r"(?:</turn>|### |<\|chat)"
#: Full escapes; the backslash goes first when escaping and last when unescaping.
FULL = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
LOSS_ROLE = "assistant"


def _escape(x: Column, level: int) -> Column:
    if level == 1:
        return F.regexp_replace(x, rf"(\\*{CONTROL})", r"\\$1")
    if level == 2:
        for raw, escaped in FULL:
            x = F.replace(x, F.lit(raw), F.lit(escaped))
    return x


def _unescape(x: Column, full: bool) -> Column:
    if not full:
        return F.regexp_replace(x, rf"\\(\\*{CONTROL})", "$1")
    for raw, escaped in reversed(FULL):
        x = F.replace(x, F.lit(escaped), F.lit(raw))
    return x


def _header(level: int) -> str:
    return ESCAPED_HEADER if level == 2 else PLAIN_HEADER


def render_chat(turns: Column, level: int) -> Column:
    """One string from array<struct<role, text>>."""
    body = F.transform(
        turns,
        lambda t: F.concat(
            F.lit(TURN_OPEN), _escape(t["role"], level), F.lit(ROLE_END), _escape(t["text"], level), F.lit(TURN_CLOSE)
        ),
    )
    return F.concat(F.lit(_header(level)), F.array_join(body, ""))


def _parse(formatted: Column, full: bool) -> Column:
    header = ESCAPED_HEADER if full else PLAIN_HEADER
    body = F.substr(formatted, F.lit(len(header) + 1))
    # What stands before the first turn's mark is empty, as a turn always opens with one.
    pieces = F.split(F.substr(body, F.lit(len(TURN_OPEN) + 1)), rf"(?<!\\){TURN_OPEN}", -1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, ROLE_END, 1)
        rest = F.substr(piece, F.length(role) + len(ROLE_END) + 1)
        text = F.get(F.split(rest, r"(?<!\\)</turn>", 2), F.lit(0))
        return F.struct(_unescape(role, full).alias("role"), _unescape(text, full).alias("text"))

    return F.transform(pieces, turn)


def parse_chat(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, of a formatted conversation."""
    return F.when(F.startswith(formatted, F.lit(ESCAPED_HEADER)), _parse(formatted, True)).otherwise(
        _parse(formatted, False)
    )


def _loss_spans(turns: Column, level: int) -> Column:
    """array<struct<start, length>>, code points from 0, of the texts to learn from."""
    span = "array<struct<start:int,length:int>>"

    def step(acc: Column, t: Column) -> Column:
        text = F.length(_escape(t["text"], level))
        start = acc["at"] + len(TURN_OPEN) + F.length(_escape(t["role"], level)) + len(ROLE_END)
        own = F.when(
            t["role"] == LOSS_ROLE,
            F.array(F.struct(start.cast("int").alias("start"), text.cast("int").alias("length"))),
        ).otherwise(F.array().cast(span))
        return F.struct(
            (start + text + len(TURN_CLOSE)).cast("int").alias("at"), F.concat(acc["spans"], own).alias("spans")
        )

    zero = F.struct(F.lit(len(_header(level))).cast("int").alias("at"), F.array().cast(span).alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_chats(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, formatted, escape_level, loss_spans, source_turns: a row for each conversation."""
    grouped = (
        turns.select(
            F.col(conv_id).alias("conv_id"),
            F.struct(
                F.col(turn).alias("turn"),
                F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
            ).alias("t"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("ts"))
        .select(
            "conv_id",
            F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("src"),
        )
    )
    src = F.col("src")
    level = (
        F.when(_parse(render_chat(src, 0), False) == src, 0)
        .when(_parse(render_chat(src, 1), False) == src, 1)
        .otherwise(2)
    )
    levelled = grouped.select("conv_id", "src", level.alias("escape_level"))

    def by_level(make) -> Column:
        chosen = F.col("escape_level")
        return F.when(chosen == 0, make(0)).when(chosen == 1, make(1)).otherwise(make(2))

    return levelled.select(
        "conv_id",
        by_level(lambda n: render_chat(src, n)).alias("formatted"),
        "escape_level",
        by_level(lambda n: _loss_spans(src, n)).alias("loss_spans"),
        src.alias("source_turns"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted strings and loss masks say, beside whether that is the source."""
    full = F.startswith(F.col("formatted"), F.lit(ESCAPED_HEADER))
    texts = F.transform(
        "loss_spans", lambda s: F.substr(F.col("formatted"), s["start"] + 1, s["length"])
    )
    return formatted.select(
        "conv_id",
        F.length("formatted").alias("chars"),
        parse_chat(F.col("formatted")).alias("turns"),
        F.when(full, F.array_join(F.transform(texts, lambda x: _unescape(x, True)), ""))
        .otherwise(F.array_join(F.transform(texts, lambda x: _unescape(x, False)), ""))
        .alias("loss_text"),
        "escape_level",
        "source_turns",
    ).withColumn("round_trip", F.col("turns") == F.col("source_turns"))
