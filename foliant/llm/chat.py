"""Chat formatting by a finite-state machine over roles and a declarative template.

The machine's state is the role of the turn before. Each turn gives three segments: what opens it,
its text with control strings escaped, and what closes it; each segment says whether it counts for
the loss. Escaping puts one more backslash between `<` and `|`, so no text holds a control string,
and taking one away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ChatTemplate:
    """Opening and closing strings, roles under the loss, and the turns that may follow each role."""

    open_turn: str = "<|im_start|>"
    after_role: str = "\n"
    close_turn: str = "<|im_end|>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    next_roles: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool"}),
            "tool": frozenset({"assistant", "tool"}),
        }
    )
    last_roles: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self):
        if not (self.open_turn.startswith("<|") and self.close_turn.startswith("<|") and self.after_role == "\n"):
            raise ValueError("control strings begin with <| and a line end follows the role")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def format_conversations(
    turns: DataFrame,
    template: ChatTemplate | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Segments (conv_id, segment, text, loss, turn_ok, last) in order within partitions.

    turn_ok says whether the machine allows the turn after the one before, and for a conversation's
    last turn also whether it may end there; all turns are formatted either way. A null role or text
    counts as empty. Turns with one number go by role, then text; null numbers come first. Rows with
    a null conversation are one conversation. Rows are sorted, not gathered, so a conversation of any
    length passes through in constant memory. Other columns are not read.
    """
    template = template or ChatTemplate()
    src = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    fields = [
        src.schema["conv_id"],
        T.StructField("segment", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("loss", T.BooleanType()),
        T.StructField("turn_ok", T.BooleanType()),
        T.StructField("last", T.BooleanType()),
    ]
    kind = {"type": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        before: tuple | None = None  # a turn waits for the next one, which tells whether it is the last
        state, n = "", 0

        def emit(turn: tuple, last: bool) -> None:
            nonlocal state, n
            conv, role, text = turn
            ok = role in template.next_roles.get(state, ()) and (not last or role in template.last_roles)
            head = template.open_turn + _escape_role(role) + template.after_role
            for part, loss in ((head, False), (escape(text), role in template.loss_roles), (template.close_turn, False)):
                out.append((conv, n, part, loss, ok, False))
                n += 1
            if last:
                out[-1] = (*out[-1][:5], True)
            state, n = ("", 0) if last else (role, n)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [kind["type"], pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.name for f in fields])
            out.clear()
            return done

        for b in batches:
            kind["type"] = b.schema.field(0).type
            size = 0
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if before is not None:
                    emit(before, before[0] != conv)
                before = (conv, role, text)
                size += len(text)
                if size > 4_000_000:
                    yield flush()
                    size = 0
            if out:
                yield flush()
        if before is not None:
            emit(before, True)
            yield flush()

    ordered = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, T.StructType(fields))


def read_formatted(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation, parsed back from its segments, which come in order.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end of each turn), loss_chars and
    loss_sha256 (unescaped text under the loss mask), formatted_chars, valid (all turns in order).
    Turns are told by their control strings, not by the rows they came from.
    """
    template = template or ChatTemplate()
    fields = [
        segments.schema["conv_id"],
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("valid", T.BooleanType()),
    ]

    def utf8(text: str) -> bytes:
        return text.encode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = 0
        valid, held = True, ""
        for b in batches:
            out: list[tuple] = []
            for conv, text, under, ok, last in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
                chars += len(text)
                valid &= ok
                held += text
                if under:
                    plain = unescape(text)
                    loss_chars += len(plain)
                    loss.update(utf8(plain))
                while held.startswith(template.open_turn) and (end := held.find(template.close_turn)) >= 0:
                    role, body = held[len(template.open_turn) : end].split(template.after_role, 1)
                    turns.update(utf8(f"{_unescape_role(role)}\n{unescape(body)}\n"))
                    n += 1
                    held = held[end + len(template.close_turn) :]
                if last:
                    if held:
                        raise ValueError("text after the last turn")
                    out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n = loss_chars = chars = 0
                    valid = True
            types = [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.name for f in fields])

    return segments.mapInArrow(run, T.StructType(fields))
