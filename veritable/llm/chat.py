"""Operator 6. Chat formatting from event logs, with DataFrame functions only.

A log has one row per event: conv_id, seq, event, turn, role, text.

* ``message``  opens a turn with its text (a later one for the same turn replaces it)
* ``delta``    adds streamed text to the turn's open version
* ``edit``     replaces the turn's text and drops what later turns had said before
* ``regenerate`` empties the turn for new deltas and drops what later turns had said before
* ``delete``   removes the turn

Events are ordered by seq within a conversation (ties: by event, turn, role, text). Windows
over a conversation fold them: an event counts if no later edit or regeneration of an
earlier turn dropped it, and if it is not older than its turn's newest opening. The folded
messages are rendered with turn markers; control strings inside roles and texts are escaped
reversibly, and the loss mask lists each assistant text's place in the result.

Null text or role counts as empty; an unknown event is an error. A turn of deltas alone is
a message. Events with null turn, seq or conv_id are ordered first like any other value, and
null conv_id forms one conversation. Extra columns are ignored; an empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, role, text."""
    known = F.col("event").isin("message", "delta", "edit", "regenerate", "delete")
    rows = events.select("conv_id", "seq", F.when(known, F.col("event")).otherwise(F.raise_error(F.concat(F.lit("unknown event "), F.coalesce("event", F.lit("null"))))).alias("event"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    line = Window.partitionBy("conv_id").orderBy("seq", "event", "turn", "role", "text")
    rows = rows.withColumn("at", F.row_number().over(line))
    resets = F.when(F.col("event").isin("edit", "regenerate"), F.col("at"))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    turn = Window.partitionBy("conv_id", "turn")
    alive = rows.withColumn("dropped", F.coalesce(F.max(resets).over(earlier), F.lit(0))).where("at > dropped")
    opened = F.max(F.when(F.col("event") != "delta", F.col("at"))).over(turn)
    live = alive.withColumn("opened", F.coalesce(opened, F.lit(0))).where("at >= opened")
    parts = F.array_sort(F.collect_list(F.struct("at", "event", "role", "text")))
    turns = live.groupBy("conv_id", "turn").agg(parts.alias("parts")).where(F.col("parts")[0]["event"] != "delete")
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return turns.select("conv_id", "turn", F.col("parts")[0]["role"].alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start, length; code points, from 0)."""
    role, body = _escape_role(F.col("role")), escape(F.col("text"))
    piece = F.concat(F.lit(OPEN), role, F.lit("\n"), body, F.lit(CLOSE + "\n"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.select("conv_id", "turn", "role", piece.alias("piece"), F.length(body).alias("size"), (F.length(role) + len(OPEN) + 1).alias("head"))
    rows = rows.withColumn("from", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.col("head"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "piece", "role", "from", "size")))
    spans = F.transform(F.filter("parts", lambda p: p["role"] == "assistant"), lambda p: F.struct(p["from"].alias("start"), p["size"].alias("length")))
    return rows.groupBy("conv_id").agg(parts.alias("parts")).select("conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The messages of a rendered conversation: array of (role, text), unescaped."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    turns = F.slice(pieces, F.lit(2), F.size(pieces))
    head = lambda t: F.substring_index(t, "\n", 1)
    body = lambda t: F.substr(t, F.length(head(t)) + 2, F.length(t) - F.length(head(t)) - 2 - len(CLOSE))
    return F.transform(turns, lambda t: F.struct(_unescape_role(head(t)).alias("role"), unescape(body(t)).alias("text")))


def digests(rendered: DataFrame) -> DataFrame:
    """What can be read back from the output: turns, their hash, and the text under the mask."""
    rows = rendered.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))), "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as the log that leads to them, in order of turn (ties: by role
    and text): a user's text is typed in two parts or, every third time, corrected by an edit;
    any other text is streamed in two deltas, every third time after a draft and its
    regeneration. Folding the log gives the turns again."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("at", F.row_number().over(order).cast("long"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substr("text", F.lit(1), half), F.substr("text", half + 1, F.length("text"))
    event = lambda name, text: F.struct(F.lit(name).alias("event"), text.alias("text"))
    third = F.col("at") % 3 == 0
    typed = F.when(third, F.array(event("message", first), event("edit", F.col("text")))).otherwise(F.array(event("message", first), event("delta", rest)))
    parts = F.array(event("message", F.lit("")), event("delta", first), event("delta", rest))
    again = F.array(event("message", rest), event("delta", F.lit(" draft")), event("regenerate", F.lit("")), event("delta", first), event("delta", rest))
    log = F.when(F.coalesce(F.col("role"), F.lit("")) == "user", typed).when(third, again).otherwise(parts)
    events = rows.select("conv_id", "at", "role", F.posexplode(log).alias("k", "e"))
    return events.select("conv_id", (F.col("at") * 8 + F.col("k")).alias("seq"), F.col("e.event").alias("event"), F.col("at").alias("turn"), "role", F.col("e.text").alias("text"))


def format_log(events: DataFrame) -> DataFrame:
    return render(fold(events))
