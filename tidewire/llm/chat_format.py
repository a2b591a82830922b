"""Chat formatting from event logs, by DataFrame functions alone.

A log holds one event a row: conversation, sequence number, message, kind, role, text.
`delta` appends its text to the message, `edit` puts its text in place of all before, and
`regenerate` starts the message anew from its own text (mostly empty).  Folding a
message therefore joins the texts from its last edit or regeneration on, in sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""Control strings begin with `<|`; inside texts that is written `<\|`, and `\` is doubled."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, msg, first_seq, role, text: the final messages of a log (conv_id, seq, msg, kind, role, text).

    Null texts and roles are empty.  Events of one message with equal numbers are taken in
    the order of kind and text, so repeated rows repeat their text.  The role is that of the
    message's first event.  An unknown kind counts as a delta; an empty log has no messages.
    """
    reset = F.coalesce(F.col("kind"), F.lit("delta")).isin("edit", "regenerate")
    rows = events.select("conv_id", "seq", "msg", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), reset.alias("reset"))
    found = rows.groupBy("conv_id", "msg").agg(
        F.min("seq").alias("first_seq"),
        F.min(F.struct("seq", "role")).getField("role").alias("role"),
        F.max(F.when(F.col("reset"), F.col("seq"))).alias("from_seq"),
        F.sort_array(F.collect_list(F.struct("seq", F.col("reset").cast("int").alias("after"), "kind", "text"))).alias("parts"),
    )
    # among equal numbers resets sort last, so an earlier delta of that number is dropped by its place
    start = F.coalesce(F.array_position(F.transform("parts", lambda p: (p.seq == F.col("from_seq")) & (p.after == 1)), True), F.lit(0))
    last = F.size(F.filter("parts", lambda p: (p.seq == F.col("from_seq")) & (p.after == 1)))
    first = F.when(start > 0, start + last - 1).otherwise(F.lit(1)).cast("int")
    kept = F.slice(F.col("parts"), first, F.size("parts"))
    return found.select("conv_id", "msg", "first_seq", "role", F.array_join(F.transform(kept, lambda p: p.text), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, segments (text, loss): the segments joined are `formatted`.

    Turns come in the order of first_seq, then msg.  One row holds one whole conversation, as
    a training example must.  Roles are URL-encoded, so that they can hold any text.
    """
    turn = F.struct("first_seq", "msg", "role", "text")
    rows = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def parts(t: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(START), F.url_encode(t.role), F.lit("\n"))
        return F.array(piece(head, F.lit(False)), piece(escape(t.text), t.role == loss_role), piece(F.lit(END + "\n"), F.lit(False)))

    rows = rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", parts)).alias("segments"))
    return rows.select("conv_id", "n_turns", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments")


def format_conversations(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Final messages of each conversation's log, rendered in one template with a loss mask."""
    return render(fold_events(events), loss_role)


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), read back from a formatted conversation."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.length(formatted))
    close = len(END) + 1

    def turn(piece: Column) -> Column:
        head = F.length(F.substring_index(piece, "\n", 1)) + 1
        body = F.substr(piece, head + 1, F.length(piece) - head - close)
        return F.struct(F.url_decode(F.substring_index(piece, "\n", 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")
