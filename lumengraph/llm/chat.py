"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation::

    conversation = { "### " role ": " text "</turn>\\n" }

The parser splits at the header mark ``### ``, the role ends at the first
``: `` and the text at the one ``</turn>\\n`` that closes the segment; then the
escapes of role and text are undone (``\\\\h`` is ``#``, ``\\\\l`` is ``<``,
``\\\\c`` is ``:`` and a doubled backslash one backslash).  A conversation is
rendered verbatim first and reparsed.  Turns that do not come back identical on
their own are escaped and the conversation is reparsed; if it still differs, all
its turns are escaped, after which none of the characters ``# < :`` is left in
them and the round trip holds for any content.

Everything is DataFrame expressions: no Python runs on the rows.

Defined results: null role or text counts as empty; turns are ordered by turn
number (nulls first), then role, then text, and repeated rows stay; a null
conversation id is a conversation of its own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, CLOSE = "### ", "</turn>\n"
_ESCAPES = (("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def _escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, code in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def _unescape(text: Column) -> Column:
    def codes(part: Column) -> Column:
        for raw, code in _ESCAPES:
            part = F.replace(part, F.lit(code), F.lit(raw))
        return part

    # doubled backslashes pair up from the left, so what lies between them holds only codes
    return F.concat_ws("\\", F.transform(F.split(text, r"\\\\"), codes))


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(": "), text, F.lit(CLOSE))


def _render(turns: Column, escaped) -> Column:
    """``escaped``: a function of a turn that tells whether it is escaped."""

    def one(t: Column) -> Column:
        return F.when(escaped(t), _turn(_escape(t["role"]), _escape(t["text"]))).otherwise(_turn(t["role"], t["text"]))

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation as array of ``role, text, body, lead``.

    ``body`` is the text as it stands in the output and ``lead`` the number of
    characters before it in its segment.  A segment outside the grammar gives a
    null role and text, which equals no source turn.
    """

    def one(segment: Column) -> Column:
        role = F.substring_index(segment, ": ", 1)
        lead = F.char_length(role) + 2
        size = F.char_length(segment) - lead - len(CLOSE)
        body = F.substring(segment, lead + 1, size)
        valid = segment.contains(": ") & segment.endswith(CLOSE) & (size >= 0) & ~body.contains("</turn>")
        return F.struct(
            F.when(valid, _unescape(role)).alias("role"), F.when(valid, _unescape(body)).alias("text"), F.when(valid, body).alias("body"), (lead + len(HEAD)).alias("lead")
        )

    # the text before the first header mark is empty
    return F.transform(F.filter(F.split(formatted, HEAD), lambda _, i: i > 0), one)


def _same(parsed: Column, turns: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == turns


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, turns, loss_spans, level``.

    ``turns`` is read back from ``formatted``.  ``loss_spans`` holds start and
    end (code points, end exclusive) of the texts of ``learn_role`` in
    ``formatted``.  ``level`` is 0 where nothing had to be escaped, 1 where some
    turns were, 2 where all were.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("source"))
    conv = conv.withColumn("source", F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))

    source = F.col("source")
    conv = conv.withColumn("verbatim", _render(source, lambda t: F.lit(False)))
    conv = conv.withColumn("plain", _same(parse(F.col("verbatim")), source))
    alone = lambda t: F.coalesce(_same(parse(_turn(t["role"], t["text"])), F.array(t)), F.lit(False))
    conv = conv.withColumn("some", F.when(~F.col("plain"), _render(source, lambda t: ~alone(t))))
    conv = conv.withColumn("mended", F.when(F.col("some").isNotNull(), _same(parse(F.col("some")), source)).otherwise(False))
    conv = conv.withColumn("level", F.when(F.col("plain"), 0).when(F.col("mended"), 1).otherwise(2))
    conv = conv.withColumn("formatted", F.when(F.col("level") == 0, F.col("verbatim")).when(F.col("level") == 1, F.col("some")).otherwise(_render(source, lambda t: F.lit(True))))
    conv = conv.select("conv_id", "level", "formatted").withColumn("parsed", parse(F.col("formatted")))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + t["lead"]
        end = start + F.char_length(t["body"])
        span = F.when(t["role"] == learn_role, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + len(CLOSE)).alias("at"), F.concat(state["spans"], span).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return conv.select(
        "conv_id",
        "formatted",
        F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
        F.aggregate("parsed", begin, step, lambda s: s["spans"]).alias("loss_spans"),
        "level",
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: _unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
