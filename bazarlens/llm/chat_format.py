"""Conversations as text segments with loss flags, by a state machine and a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is written and in which order roles may speak.

    ``turn`` lists the segments of a turn: literal text, ``{role}`` inside
    literal text, or the text of the turn alone as ``{text}``. ``order`` maps
    a state, the role that spoke last, to the roles that may speak next; the
    state before the first turn is the empty string. ``loss`` names the roles
    whose text is trained on.
    """

    turn: tuple[str, ...] = ("<|im_start|>{role}\n", "{text}", "<|im_end|>\n")
    loss: frozenset[str] = frozenset({"assistant"})
    order: dict = field(
        default_factory=lambda: {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user", "tool"}, "tool": {"assistant"}}
    )


MARK = re.compile(r"<(\\*)\|")
ESCAPED_MARK = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """Put one more backslash into whatever looks like the start of a control string."""
    return MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED_MARK.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def segments_of(role: str, text: str, template: Template) -> list[tuple[str, bool]]:
    """(segment, whether it counts for the loss) of one turn; only whole texts count."""
    return [(escape(text), role in template.loss) if part == "{text}" else (part.replace("{role}", escape_role(role)), False) for part in template.turn]


SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_turns(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn: conv_id, position (from 0), in_order, segments (text, loss).

    Turns of a conversation follow ``turn``, then role and text where that
    ties; nulls come first. A null text is empty; a null role is an empty one,
    which no state allows. ``in_order`` says whether the state machine allows
    the role after the one before it; a turn out of order is still written,
    and the machine goes on from its role. Rows with a null conv_id form a
    conversation. Repeated rows are turns each. Tasks stream through sorted
    rows, so the length of a conversation does not matter.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, position, started = "", None, 0, False
        for batch in batches:
            positions, allowed, segments = [], [], []
            for conv, role, body in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if not started or conv != current:
                    state, current, position, started = "", conv, 0, True
                positions.append(position)
                allowed.append(role in template.order.get(state, ()))
                segments.append([{"text": x, "loss": y} for x, y in segments_of(role, body, template)])
                state, position = role, position + 1
            yield pa.record_batch(
                [batch.column(0), pa.array(positions, pa.int64()), pa.array(allowed, pa.bool_()), pa.array(segments, SEGMENTS)],
                names=["conv_id", "position", "in_order", "segments"],
            )

    return rows.mapInArrow(run, "conv_id long, position long, in_order boolean, segments array<struct<text:string,loss:boolean>>")


def turn_pattern(template: Template) -> re.Pattern:
    """Reads one formatted turn."""
    parts = []
    for part in template.turn:
        if part == "{text}":
            parts.append("(?P<text>.*)")
        else:
            parts.append("(?P<role>.*?)".join(map(re.escape, part.split("{role}"))))
    return re.compile("".join(parts), re.S)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests per conversation from formatted turns, nothing but their segments being read.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of every
    turn), loss_chars and loss_sha256 (all text under the loss flags, with
    escapes taken back), formatted_chars, in_order (all turns).
    """
    pattern = turn_pattern(template)
    rows = formatted.select("conv_id", "position", "in_order", "segments").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        held = None
        done: list[list] = []

        def record(rows_: list[list]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in rows_], kind) for i, kind in enumerate(kinds)], names=names)

        def finish(x: list) -> list:
            return [x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5], x[6]]

        for batch in batches:
            for conv, ok, segments in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if held is None or held[0] != conv:
                    if held is not None:
                        done.append(finish(held))
                    held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                whole = "".join(s["text"] for s in segments)
                found = pattern.fullmatch(whole)
                held[1] += 1
                held[2].update(f"{unescape_role(found['role'])}\n{unescape(found['text'])}\n".encode())
                for s in segments:
                    if s["loss"]:
                        plain = unescape(s["text"])
                        held[3] += len(plain)
                        held[4].update(plain.encode())
                held[5] += len(whole)
                held[6] = held[6] and ok
            if done:
                yield record(done)
                done = []
        if held is not None:
            yield record([finish(held)])

    return rows.mapInArrow(run, schema)
