"""Conversations as training text: a compiled template marks turns and what a model is to generate.

The turns of a conversation are dealt by conversation and sorted by turn within partitions; a task
renders them one after the other as they come, so a conversation of any number of turns is never held whole.
What is written is a table of pieces: whole strings of a conversation up to some length, with the spans of
generated text in code points. Most conversations are one piece. A conversation is one stream, for its digest
is; all other conversations of its task wait for a very long one.

Control strings inside texts are escaped, reversibly: a backslash is doubled, and `\\-` comes after the
first character of every control string, at overlapping places too. No control string has a backslash, so
none is left in the text or made by it.

`read_back` takes the pieces apart again: turns by the control strings, and the generated text by the
spans alone.

Defined results:
* A null text or role is an empty one. Roles besides system, user and assistant are written out.
* Turns go by `turn`, null first; ties by role, then text, as text. Rows that repeat are turns that repeat.
* All rows with a null conv_id are one conversation.
* Empty texts are turns with empty text. Very long texts come whole, in one piece.
* An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.templates import BEGIN, END, Template
from plumbline.plans.storage import scratch_path

#: Fixed values of the format. CONTROLS never stand in an escaped text.
CONTROLS = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/TEXT]",
)
TEMPLATE = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'system' %}<<SYS>>{{ m.text | guard }}<</SYS>>"
    "{% elif m.role == 'user' %}[INST]{{ m.text | guard }}[/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ m.role | guard }}[TEXT]{{ m.text | guard }}[/TEXT]"
    "{% endif %}{% endfor %}"
)
#: Code points after which a piece ends.
PIECE = 1 << 20

PIECES = (
    "conv_id bigint, piece bigint, last boolean, text string, "
    "generated array<struct<first:bigint,end:bigint>>"
)
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_PIECES = pa.schema(
    [("conv_id", pa.int64()), ("piece", pa.int64()), ("last", pa.bool_()), ("text", pa.string()),
     ("generated", _SPANS)]
)
SUMMARY = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint"
)
_SUMMARY = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_BEFORE_CONTROL = re.compile(f"(?=(?:{_CONTROL.pattern}))(.)", re.DOTALL)
_ESCAPED = re.compile(r"\\([\\-])")


def guard(text: str) -> str:
    """The text without control strings, from which `unguard` makes it again."""
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _BEFORE_CONTROL.sub(r"\1\\-", text)


def unguard(text: str) -> str:
    return _ESCAPED.sub(lambda m: "" if m[1] == "-" else "\\", text) if "\\" in text else text


def pieces_of(parts: Iterable[str | int], limit: int = PIECE) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Text and generated spans of pieces; a string that the template yields is never cut."""
    held: list[str] = []
    spans: list[tuple[int, int]] = []
    size, begun = 0, None
    for part in parts:
        if part == BEGIN:
            begun = size
        elif part == END:
            spans.append((begun, size))
            begun = None
        else:
            if size and size + len(part) > limit:
                if begun is not None:
                    spans.append((begun, size))
                yield "".join(held), spans
                held, spans, size = [], [], 0
                begun = None if begun is None else 0
            held.append(part)
            size += len(part)
    yield "".join(held), spans


def format_conversations(
    conversations: DataFrame, template: str = TEMPLATE, piece: int = PIECE
) -> DataFrame:
    """The pieces of every conversation (conv_id, turn, role, text) under `template`."""
    Template(template, {"guard": guard})  # a wrong template fails here, not in a task
    turns = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        F.coalesce(conversations["role"], F.lit("")).alias("role"),
        F.coalesce(conversations["text"], F.lit("")).alias("text"),
    )
    in_order = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Template(template, {"guard": guard})
        rows = (row for batch in batches for row in batch.select(["conv_id", "role", "text"]).to_pylist())

        def all_pieces() -> Iterator[tuple]:
            for name, messages in groupby(rows, itemgetter("conv_id")):
                number, ready = 0, None
                for text, spans in pieces_of(made.render(messages), piece):
                    if ready is not None:
                        yield name, number - 1, False, *ready
                    ready, number = (text, spans), number + 1
                yield name, number - 1, True, *ready

        return _batches(all_pieces(), _PIECES, lambda row: len(row[3]))

    return in_order.mapInArrow(render, PIECES)


def _batches(
    rows: Iterable[tuple], schema: pa.Schema, size: Callable[[tuple], int], limit: int = 4 * PIECE
) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        held.append(row)
        total += size(row) + 100
        if total > limit:
            yield _batch(held, schema)
            held, total = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(_as_structs(c) if f.name == "generated" else c, f.type) for c, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _as_structs(column: tuple) -> list[list[dict[str, int]]]:
    return [[{"first": a, "end": b} for a, b in spans] for spans in column]


class TurnReader:
    """Takes the pieces of one conversation and yields its turns as (role, text)."""

    _OPENING = {"<<SYS>>": "system", "[INST]": "user", "[ROLE]": None}
    _CLOSING = {"<</SYS>>": "system", "[/INST]": "user", "</s>": "assistant", "[/TEXT]": None}

    def __init__(self) -> None:
        self.held: list[str] = []
        self.role = ""

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        at = 0
        for found in _CONTROL.finditer(text):
            self.held.append(text[at : found.start()])
            at = found.end()
            mark = found[0]
            if mark == "[TEXT]":
                self.role = unguard("".join(self.held))
            elif mark in self._CLOSING:
                yield self._CLOSING[mark] or self.role, unguard("".join(self.held))
            self.held = []
        self.held.append(text[at:])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in batch.to_pylist())

    def each() -> Iterator[tuple]:
        for (name, _), pieces in groupby(_numbered(rows), itemgetter(0)):
            reader, turns, n_turns = TurnReader(), sha256(), 0
            loss, loss_chars, chars = sha256(), 0, 0
            for _, row in pieces:
                text = row["text"]
                chars += len(text)
                for role, said in reader.turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n_turns += 1
                for span in row["generated"]:
                    said = unguard(text[span["first"] : span["end"]])
                    loss.update(said.encode())
                    loss_chars += len(said)
            yield name, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    return _batches(each(), _SUMMARY, lambda row: 200)


def _numbered(rows: Iterable[dict]) -> Iterator[tuple[tuple, dict]]:
    """Each piece with its conversation's name and place: piece 0 begins another."""
    place = -1
    for row in rows:
        place += row["piece"] == 0
        yield (row["conv_id"], place), row


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the pieces.

    Only conversations of several pieces are brought together.
    """
    alone = (F.col("piece") == 0) & F.col("last")
    several = pieces.filter(~alone).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return pieces.filter(alone).mapInArrow(_summaries, SUMMARY).unionByName(
        several.mapInArrow(_summaries, SUMMARY)
    )


def format_and_read(
    conversations: DataFrame, path: str | None = None, template: str = TEMPLATE, piece: int = PIECE
) -> DataFrame:
    """Write the formatted conversations (to the shared folder if no path is given), read them back."""
    spark = conversations.sparkSession
    path = path or scratch_path(spark, "chat")
    format_conversations(conversations, template, piece).write.parquet(path)
    return read_back(spark.read.schema(PIECES).parquet(path))
