"""Chat formatting: a declarative template and a small state machine over roles.

A conversation is sorted by turn and streamed through a task: each turn gives three text segments (mark, text,
end mark) with a loss flag.  The machine follows the roles and marks the turns that break the order; every turn
is written all the same.  Control strings inside texts are escaped with a backslash, and so are backslashes, so
the output can be read back: ``read_back`` parses the joined segments and never sees the original rows.

Conversations are dealt out by id and sorted on disk.  Tasks hold one turn at a time, however long the
conversation is; its digests follow its order, so they are made in one task.

Defined cases: null text and null roles are empty; a null ``conv_id`` is one conversation; turns with equal or
null numbers are ordered nulls first, then by role and text, and all are kept; a role without a mark of its own
gets the general mark, never loss, and an invalid state; an empty table gives no rows; other columns are ignored.
"""

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
    opening: str = "### "
    naming: str = ": "
    ending: str = "</turn>"
    after: str = "\n"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset[str] = frozenset({"assistant"})
    #: From each state, the roles that may follow; the first state is "".
    order: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    final: frozenset[str] = frozenset({"assistant"})

    @property
    def control(self) -> list[str]:
        return [self.opening.strip(), self.ending]

    def escape(self, text: str, more: tuple[str, ...] = ()) -> str:
        return re.sub("|".join(map(re.escape, ["\\", *self.control, *more])), lambda m: "\\" + m[0], text)

    def unescape(self, text: str, more: tuple[str, ...] = ()) -> str:
        return re.sub(r"\\(" + "|".join(map(re.escape, ["\\", *self.control, *more])) + ")", r"\1", text)

    def mark(self, role: str) -> str:
        """The general mark is ``@`` and the escaped role."""
        return f"{self.opening}{self.names[role] if role in self.names else '@' + self.escape(role, (':',))}{self.naming}"

    def role(self, name: str) -> str:
        if name.startswith("@"):
            return self.unescape(name[1:], (":",))
        return {v: k for k, v in self.names.items()}[name]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of rows; a new one begins when the texts (column 2 on) exceed ``size``."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 64 + sum(len(x) for x in row if isinstance(x, str))
        if weight > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
_READ = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())]
    + [("formatted_chars", pa.int64()), ("valid", pa.bool_())]
)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(c.to_pylist() for c in part.columns))


def segments(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turn_no, kind, text, loss, valid) in writing order within each partition; turn_no counts from 0."""
    plain = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, state, number = object(), "", 0
            for conv, _, role, text in _rows(batches):
                if conv != now:
                    now, state, number = conv, "", 0
                valid = role in template.order.get(state, ())
                state = role
                loss = role in template.loss
                yield conv, number, "mark", template.mark(role), False, valid
                yield conv, number, "text", template.escape(text), loss, valid
                yield conv, number, "end", template.ending + template.after, False, valid
                number += 1

        return _batches(rows(), _SEGMENTS)

    return ordered.mapInArrow(write, "conv_id long, turn_no long, kind string, text string, loss boolean, valid boolean")


class _Reader:
    """Reads one conversation back from its formatted text and its loss mask, piece by piece."""

    def __init__(self, template: Template):
        t = self.template = template
        # Possessive runs: what a turn says can't be read in two ways, so nothing is kept for a second try.
        escaped, first = r"\\(?:" + "|".join(map(re.escape, ["\\", *t.control])), re.escape(t.ending[0])
        literal = rf"(?:[^\\{first}]++|{escaped})|(?!{re.escape(t.ending)}){first})*+"
        name = rf"((?:[^\\:]++|{escaped}|:))*+)"
        self.turn = re.compile(re.escape(t.opening) + name + re.escape(t.naming) + f"({literal})" + re.escape(t.ending + t.after), re.S)
        self.n_turns = self.loss_chars = self.chars = 0
        self.turns, self.loss, self.valid = hashlib.sha256(), hashlib.sha256(), True
        self.pending: list[str] = []
        self.last = ""

    def feed(self, text: str, loss: bool, valid: bool) -> None:
        self.chars += len(text)
        self.valid &= valid
        if loss:
            said = self.template.unescape(text)
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        self.pending.append(text)
        if text.endswith(self.template.after):  # a turn may end here
            self.parse()

    def parse(self) -> None:
        whole, begin = "".join(self.pending), 0
        while m := self.turn.match(whole, begin):
            self.last = self.template.role(m[1])
            self.turns.update(f"{self.last}\n{self.template.unescape(m[2])}\n".encode())
            self.n_turns += 1
            begin = m.end()
        self.pending = [whole[begin:]] if begin < len(whole) else []

    def done(self) -> tuple:
        self.parse()
        if self.pending:
            raise ValueError(f"formatted text doesn't end with a turn: {self.pending[0][:80]!r}")
        valid = self.valid and self.last in self.template.final
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid


def read_back(written: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, from the segments' texts and loss flags in the order of ``segments``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, reader = None, None
            for conv, text, loss, valid in _rows(batches):
                if reader is None or conv != now:
                    if reader:
                        yield now, *reader.done()
                    now, reader = conv, _Reader(template)
                reader.feed(text, loss, valid)
            if reader:
                yield now, *reader.done()

        return _batches(rows(), _READ)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    return written.select("conv_id", "text", "loss", "valid").mapInArrow(read, schema)


def formatted(written: DataFrame) -> DataFrame:
    """(conv_id, text, loss_spans): whole conversations, for conversations that fit into a row."""
    parts = F.sort_array(F.collect_list(F.struct("turn_no", F.when(F.col("kind") == "mark", 0).when(F.col("kind") == "text", 1).otherwise(2).alias("o"), "text", "loss")))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "")
    spans = F.aggregate(
        "p",
        F.expr("struct(0L as at, cast(array() as array<struct<start: bigint, end: bigint>>) as spans)"),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["text"])).alias("at"),
            F.when(x["loss"], F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.length(x["text"])).alias("end"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )["spans"]
    return written.groupBy("conv_id").agg(parts.alias("p")).select("conv_id", text.alias("text"), spans.alias("loss_spans"))
