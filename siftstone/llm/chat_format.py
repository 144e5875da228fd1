"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context, and only its
reply is trainable. Contexts of one conversation are prefixes of each other, so the output holds the
formatted stream of a conversation once, a segment for each turn, and an example is a range of that
stream: its context is what stands before its reply. `examples` gives these ranges, one row for each
assistant turn, and what is trainable is read back through them; `expand` writes examples out in full.
Ranges keep the output in proportion to the input, where full contexts grow with the square of a
conversation.

Template: <|im_start|>ROLE newline TEXT<|im_end|> newline. In a text, a backslash goes between < and |
wherever only backslashes stand between them, so no control string can come from a text, and taking
one backslash away again gives the text back. In a role, backslash and newline are escaped.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINABLE = "assistant"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def format_turns(turns: DataFrame) -> DataFrame:
    """One row for each row of turns (conv_id, turn, role, text), in the order of turn, then role, then text.

    conv_id, position (0 on), segment (the formatted turn), seg_start (code points of the stream before
    it), and for an assistant turn its example number and the range [loss_start, loss_end) of its
    escaped text in the stream; context is [0, context_end). Null texts and roles are empty; a null
    turn comes first; rows with a null conv_id are one conversation. An empty table gives an empty table.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumns({"head": head, "body": escape_text(F.col("text"))})
    rows = rows.withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
    trainable = F.col("role") == TRAINABLE
    rows = rows.withColumns(
        {
            "position": F.row_number().over(order).cast("long") - 1,
            "seg_start": F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)).cast("long"),
            "number": F.coalesce(F.sum(trainable.cast("long")).over(before), F.lit(0)),
        }
    )
    loss_start = F.col("seg_start") + F.length("head")
    return rows.select(
        "conv_id",
        "position",
        "segment",
        "seg_start",
        F.when(trainable, F.col("number")).alias("example"),
        F.when(trainable, loss_start).alias("context_end"),
        F.when(trainable, loss_start).alias("loss_start"),
        F.when(trainable, loss_start + F.length("body")).alias("loss_end"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """One row for each assistant turn: conv_id, example, and its ranges in the stream, the context [0, context_end) and the loss mask [loss_start, loss_end)."""
    return formatted.filter("example is not null").select("conv_id", "example", "context_end", "loss_start", "loss_end")


def _along_streams(formatted: DataFrame, found: DataFrame) -> DataFrame:
    """Segments and examples as rows of one kind, dealt by conversation, each example right after the segment that its loss range begins in."""
    nothing = F.lit(None).cast("long")
    segments = formatted.select("conv_id", F.col("seg_start").alias("at"), "segment", nothing.alias("example"), nothing.alias("loss_end"))
    ranges = found.select("conv_id", F.col("loss_start").alias("at"), F.lit(None).cast("string").alias("segment"), "example", "loss_end")
    return segments.union(ranges).repartition("conv_id").sortWithinPartitions("conv_id", "at", F.col("example").asc_nulls_first())


def _reply(segment: str, start: int, loss_start: int, loss_end: int) -> str:
    """What the loss mask of an example covers in a segment that begins at start of its stream."""
    if not start <= loss_start <= loss_end <= start + len(segment):
        raise ValueError(f"loss range [{loss_start}, {loss_end}) leaves the segment at {start}")
    return segment[loss_start - start : loss_end - start]


def expand(formatted: DataFrame, batch_chars: int = 1 << 24) -> DataFrame:
    """Examples in full: conv_id, example, context and reply (escaped) of each assistant turn.

    Turns pass one after the other and the stream so far is the next context: no turns are paired. The
    output grows with the square of a conversation's turns; a task holds one context and a batch of
    examples of about batch_chars.
    """

    def write(batches):
        stream, now, first, start, segment = [], None, True, 0, ""
        done, size = [], 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "example", "context", "reply"])

        for batch in batches:
            for conv, at, text, example, end in zip(*(c.to_pylist() for c in batch.columns)):
                if first or conv != now:
                    stream, now, first = [], conv, False
                if text is not None:
                    stream.append(text)
                    start, segment = at, text
                    continue
                reply = _reply(segment, start, at, end)
                stream = ["".join(stream)]
                done.append((conv, example, stream[0][:at], reply))
                size += at + len(reply)
                if size >= batch_chars:
                    yield rows()
                    done, size = [], 0
        if done:
            yield rows()

    return _along_streams(formatted, examples(formatted)).mapInArrow(write, "conv_id long, example long, context string, reply string")


def read_turns(formatted: DataFrame) -> DataFrame:
    """The turns that the segments hold: conv_id, position, role, text."""
    inner = F.col("segment").substr(F.lit(len(START) + 1), F.length("segment") - (len(START) + len(END) + 1))
    role = F.substring_index(inner, "\n", 1)
    body = inner.substr(F.length(role) + 2, F.length(inner))
    return formatted.select("conv_id", "position", _unescape_role(role).alias("role"), unescape_text(body).alias("text"))


_ESCAPED = re.compile(r"<\\(\\*)\|")
_ESCAPED_ROLE = re.compile(r"\\(.)")


def _read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a segment, as read_turns has them."""
    role, _, body = segment[len(START) : -len(END) - 1].partition("\n")
    return _ESCAPED_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], role), _ESCAPED.sub(r"<\1|", body)


def conversation_digests(formatted: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row for each conversation, from its segments and examples alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    What is trainable comes from the examples (found, those of formatted if none are given), each read
    through its own loss range. Turns and examples pass one after the other through two running
    digests, so a task holds one batch of rows, whatever the length of a conversation.
    """

    def digest(batches):
        now, seen, state, start, segment = None, False, None, 0, ""

        def row():
            turns, loss, n, loss_chars, chars = state
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]), pa.array([loss_chars], pa.int64()), pa.array([loss.hexdigest()]), pa.array([chars], pa.int64())],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in batches:
            done = []
            for conv, at, text, example, end in zip(*(c.to_pylist() for c in batch.columns)):
                if not seen or conv != now:
                    if seen:
                        done.append(row())
                    now, seen, state = conv, True, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                if text is None:
                    reply = _ESCAPED.sub(r"<\1|", _reply(segment, start, at, end))
                    state[1].update(reply.encode())
                    state[3] += len(reply)
                    continue
                start, segment = at, text
                role, said = _read_turn(text)
                state[0].update(f"{role}\n{said}\n".encode())
                state[2] += 1
                state[4] += len(text)
            yield from done
        if seen:
            yield row()

    rows = _along_streams(formatted, examples(formatted) if found is None else found)
    return rows.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
