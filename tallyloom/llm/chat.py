"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped


@dataclass(frozen=True)
class Template:
    """How a turn is written, which roles are learned from, and which role may follow which state."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    loss_roles: frozenset = frozenset({"assistant"})
    order: dict = field(default_factory=lambda: {
        "begin": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user", "tool": "tool"},
        "tool": {"tool": "tool", "assistant": "assistant"},
    })
    final: frozenset = frozenset({"assistant"})

    def step(self, state: str, role: str) -> str:
        return self.order.get(state, {}).get(role, "broken")


def escaped(text: str) -> str:
    """No control string survives: each `<|`, with any backslashes between, gets one backslash more."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turn_no, kind, text, loss, in_order: three segments for each turn (head, body, tail) in output order.

    Rows of a conversation are ordered by turn, then role and text. Concatenated text of a conversation is its formatted
    form; `loss` marks the bodies of the roles learned from; `in_order` is false from the first turn that the machine
    refuses. Null text or role: empty. A null conv_id is a conversation of its own; repeated rows are turns of their own;
    other columns are not read; an empty table gives no rows. Each task streams sorted rows and holds one batch.
    """
    t = template or Template()
    schema = pa.schema({"conv_id": pa.int64(), "turn_no": pa.int64(), "kind": pa.string(), "text": pa.string(), "loss": pa.bool_(), "in_order": pa.bool_()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, turn_no = object(), "begin", 0
        for batch in batches:
            rows = []
            for conv_id, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if conv_id != at:
                    at, state, turn_no = conv_id, "begin", 0
                state, turn_no = t.step(state, role), turn_no + 1
                good = state != "broken"
                rows.append((conv_id, turn_no, "head", f"{t.start}{escaped_role(role)}\n", False, good))
                rows.append((conv_id, turn_no, "body", escaped(text), role in t.loss_roles, good))
                rows.append((conv_id, turn_no, "tail", t.end, False, good))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return mapped(dealt, run, "conv_id long, turn_no long, kind string, text string, loss boolean, in_order boolean")


class _Reader:
    """Reads a formatted conversation back, a segment at a time, and digests it; it holds one turn."""

    def __init__(self, conv_id: int | None, template: Template):
        self.conv_id, self.t, self.state = conv_id, template, "begin"
        self.turns, self.loss_chars, self.chars, self.left = 0, 0, 0, ""
        self.all, self.loss = sha256(), sha256()

    def read(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if loss:
            plain = unescaped(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.left += text
        if self.left.endswith(self.t.end):  # only a tail: texts hold no control string
            role, _, body = self.left[len(self.t.start) : -len(self.t.end)].partition("\n")
            role, self.left = unescaped_role(role), ""
            self.all.update(f"{role}\n{unescaped(body)}\n".encode())
            self.turns, self.state = self.turns + 1, self.t.step(self.state, role)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.state in self.t.final


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation, read back from the segments' text and loss flags alone. `formatted` comes from
    `segments`, which leaves each conversation's segments together and in order in one partition: no further shuffle."""
    t = template or Template()
    schema = pa.schema({"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "valid": pa.bool_()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

        reader = None
        for batch in batches:
            rows = []
            for conv_id, text, loss in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "text", "loss")), strict=True):
                if reader is None or reader.conv_id != conv_id:
                    if reader:
                        rows.append(reader.row())
                    reader = _Reader(conv_id, t)
                reader.read(text, loss)
            yield made(rows)
        if reader:
            yield made([reader.row()])

    return mapped(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
