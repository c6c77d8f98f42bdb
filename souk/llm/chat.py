"""Chat formatting (6), in DataFrame functions only.

A log of events is the source of truth. Events of a conversation are ordered by
``seq`` and folded into final messages:

    message     begins message ``turn`` with a role and a text
    delta       appends its text to message ``turn``
    edit        replaces the text of message ``turn``
    regenerate  empties message ``turn`` and takes back all later ones so far

The messages are then rendered as ``<|role|>text<|end|>``, one a line. In roles
and texts ``<|`` and the escape sign itself are escaped, and ``|>`` in roles, so no
text can close its turn nor a role its head, and ``unescape`` gives back what was
written.

A rendered conversation is one value, so its messages meet in one task; what is held
there is bounded by the longest conversation, not by the table.

Edge cases: null texts and roles are empty; a null conversation id is a
conversation; events of equal ``seq`` are ordered by kind, role and text; repeated
turns are messages of their own, ordered by role and text; texts of any length stay
whole; an empty log gives no row; a message without any event but deltas has an
empty role; columns beside those named aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
ESCAPE = "␛"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(OPEN), F.lit(ESCAPE + "1"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(CLOSE), F.lit(ESCAPE + "2"))


def unescape(text: Column) -> Column:
    opened = F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit(OPEN)), F.lit(ESCAPE + "2"), F.lit(CLOSE))
    return F.replace(opened, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def events_of(conversations: DataFrame) -> DataFrame:
    """Turns as the log that a chat server would have written: conv_id, seq, kind,
    turn, role, text. Turns are numbered in the order of ``turn`` (then role and
    text). By a hash of conversation and number a turn comes whole, as two streamed
    deltas, as a draft that is edited, or as an attempt that is answered and then
    regenerated as deltas."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    head, tail = F.substr("text", F.lit(1), half), F.substr("text", half + 1)

    def event(kind: str, text: Column, after: int = 0, role: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.col("turn") + after).alias("turn"), (F.lit("") if role is None else role).alias("role"), text.alias("text"))

    role, empty = F.col("role"), F.lit("")
    streamed = [event("delta", head), event("delta", tail)]
    draft = F.concat(F.lit("draft: "), head)
    ways = [
        [event("message", F.col("text"), role=role)],
        [event("message", empty, role=role), *streamed],
        [event("message", draft, role=role), event("edit", F.col("text"))],
        [event("message", draft, role=role), event("message", F.lit("no, again"), 1, F.lit("user")), event("regenerate", empty), *streamed],
    ]
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(len(ways)))
    log = F.when(way == 0, F.array(*ways[0]))
    for i, events in enumerate(ways[1:], 1):
        log = log.when(way == i, F.array(*events))
    number = (F.col("turn") * 8 + F.col("at")).alias("seq")
    return turns.select("conv_id", "turn", F.posexplode(log).alias("at", "e")).select("conv_id", number, "e.kind", "e.turn", "e.role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, role, text, n_events. A window over the log,
    sorted by conversation, drops what was regenerated; then each message's events
    are folded in order."""
    by_seq = [F.col("seq"), F.col("kind"), F.col("role"), F.col("text")]
    later = Window.partitionBy("conv_id").orderBy(*(c.desc() for c in by_seq)).rowsBetween(Window.unboundedPreceding, -1)
    standing = events.select("conv_id", "seq", "kind", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    standing = standing.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later)).filter("cut is null or turn <= cut").drop("cut")
    event = F.struct("seq", "kind", "role", "text")
    grouped = standing.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(event)).alias("events"))
    start = F.struct(F.lit("").alias("role"), F.lit("").alias("text"))
    state = F.aggregate(
        "events",
        start,
        lambda done, e: F.struct(
            F.when(e["kind"] == "message", e["role"]).otherwise(done["role"]).alias("role"),
            F.when(e["kind"] == "delta", F.concat(done["text"], e["text"])).when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"]).alias("text"),
        ),
    )
    return grouped.select("conv_id", "turn", state.alias("m"), F.size("events").alias("n_events")).select("conv_id", "turn", "m.role", "m.text", "n_events")


def render(messages: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, formatted, loss_mask (array of start
    and length in characters, of the assistant's texts)."""
    marked = messages.select("conv_id", "turn", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(CLOSE)).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learn"))
    turns = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "head", "body", "learn"))).alias("turns"))
    piece = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n")))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda done, t: F.struct(
            (done["at"] + F.length(t["head"]) + F.length(t["body"]) + F.lit(len(END) + 1)).alias("at"),
            F.when(t["learn"], F.concat(done["spans"], F.array(F.struct((done["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(done["spans"]).alias("spans"),
        ),
    )
    return turns.select("conv_id", F.array_join(piece, "").alias("formatted"), spans["spans"].alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of role and text."""
    pieces = F.split(formatted, r"<\|end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)  # nothing stands after the last end
    return F.transform(pieces, lambda p: F.struct(unescape(F.substr(p, F.lit(3), F.locate(CLOSE, p, 3) - F.lit(3))).alias("role"), unescape(F.substr(p, F.locate(CLOSE, p, 3) + F.lit(2))).alias("text")))


def masked(formatted: Column, loss_mask: Column) -> Column:
    """All text under the mask, as it was written."""
    return F.array_join(F.transform(loss_mask, lambda s: unescape(F.substr(formatted, s["start"] + F.lit(1), s["length"]))), "")
