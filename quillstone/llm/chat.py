"""Chat formatting by event sourcing, in DataFrame functions alone.

A log has one event a row: conv_id, seq, message_id, kind, role, text. Kinds are message (opens one),
regenerate and edit (replace what it said so far) and delta (appends to it). Events are ordered by
(seq, kind in that order, role, text). A message's text is that of its last event that is no delta,
followed by the deltas after that; its place in the conversation is that of the event that opened it,
and its role the last one given. Events on a message that nothing opened open it themselves. Events of
any other kind, or of none, are no part of a message and are left out.

Folding is done per message, before the conversation is put together, so only what belongs to one
message or, last, to one rendered conversation meets in one row (an output value is one row's by
definition; nothing but its text is gathered there).

Template: each turn is "### role: text</turn>\\n". In roles and texts a backslash becomes \\b, # becomes
\\h, < becomes \\l and (in roles) : becomes \\c, so that no text can hold one of the marks, and reading
back is exact. The loss mask is a span (start, length in code points of the output) for each turn.

Cases: null role or text: empty; null conv_id: a conversation of its own; rows repeated with kind
message are messages of their own, each; an empty table gives no conversations; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("message", "regenerate", "edit", "delta")
TURN_END = "</turn>\n"
LOSS_ROLES = ("assistant",)


def escape(c: Column) -> Column:
    for a, b in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_text(c: Column) -> Column:
    for a, b in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    """Of either escape; the backslash itself comes last, so that nothing is read twice."""
    for a, b in (("\\c", ":"), ("\\l", "<"), ("\\h", "#"), ("\\b", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log of whole messages."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("seq"), F.col("turn").cast("string").alias("message_id"), F.lit("message").alias("kind"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """The log as final messages: conv_id, seq, role, text, with tie, which orders messages of one seq."""
    e = events.select(
        "conv_id", "message_id", "seq", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("rank"),
        F.coalesce("role", F.lit("")).alias("role"), F.col("role").isNotNull().alias("has_role"), F.coalesce("text", F.lit("")).alias("text"),
    ).where("rank > 0")
    order = Window.partitionBy("conv_id", "message_id").orderBy("seq", "rank", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("nth", F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).over(order))
    e = e.withColumn("at", F.struct("seq", "rank", "role", "text"))
    g = e.groupBy("conv_id", "message_id", "nth").agg(
        F.min("at").alias("opened"), F.max(F.when(F.col("rank") < 4, F.col("at"))).alias("reset"),
        F.max(F.when(F.col("has_role"), F.struct("seq", "rank", "role"))).alias("said_by"), F.sort_array(F.collect_list(F.when(F.col("rank") == 4, F.col("at")))).alias("deltas"),
    )
    after = F.transform(F.filter("deltas", lambda d: F.col("reset").isNull() | (d > F.col("reset"))), lambda d: d["text"])
    text = F.concat(F.coalesce("reset.text", F.lit("")), F.array_join(after, ""))
    return g.select("conv_id", F.col("opened.seq").alias("seq"), F.coalesce("said_by.role", F.lit("")).alias("role"), text.alias("text"), F.col("message_id").alias("tie"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """conv_id, formatted and spans: for each turn where it starts, where its text starts, how long that is, and whether it carries loss."""
    m = messages.withColumns({"head": F.concat(F.lit("### "), escape("role"), F.lit(": ")), "body": escape_text("text")})
    order = Window.partitionBy("conv_id").orderBy("seq", "tie", "role", "text")
    size = F.length("head") + F.length("body") + len(TURN_END)
    m = m.withColumns({"n": F.row_number().over(order), "end": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    start = F.col("end") - size
    turn = F.struct("n", F.concat("head", "body", F.lit(TURN_END)).alias("piece"), F.struct(start.alias("turn"), (start + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"), F.col("role").isin(*loss_roles).alias("loss")).alias("span"))
    g = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return g.select("conv_id", F.array_join(F.col("turns.piece"), "").alias("formatted"), F.col("turns.span").alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """render()'s rows with turns (role, text) parsed from the output, and loss_texts under its mask, unescaped."""
    pieces = F.split("formatted", TURN_END)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)  # the last turn's end is followed by nothing
    df = formatted.withColumn("_pieces", pieces)
    cut_at = lambda p: F.locate(": ", p)
    parse = lambda p: F.struct(unescape(p.substr(F.lit(5), cut_at(p) - 5)).alias("role"), unescape(p.substr(cut_at(p) + 2, F.length(p))).alias("text"))
    marked = F.filter(F.arrays_zip(F.col("_pieces").alias("piece"), F.col("spans").alias("span")), lambda x: x["span"]["loss"])
    under = F.transform(marked, lambda x: unescape(x["piece"].substr((x["span"]["start"] - x["span"]["turn"] + 1).cast("int"), x["span"]["length"].cast("int"))))
    return df.withColumns({"turns": F.transform("_pieces", parse), "loss_texts": under}).drop("_pieces")
