"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and only that reply is trained on. Turns behind the last reply, or a
conversation without one, end in an example with no target, so that the output
holds every turn.

A turn is ``<|im_start|>role``, a line end, its text, ``<|im_end|>`` and a line
end. Inside roles and texts a backslash is doubled and ``<|`` is written as
``<\\|``, so that no text can end its turn; a line end in a role is ``\\n``.

Turns are ordered by ``turn``, then role and text, nulls first. A null role or
text is empty. Repeated rows are turns of their own. Turns without ``conv_id``
are one conversation without id. Other columns are not read.

A task streams through its conversations turn by turn. What it holds is the
formatted conversation that it is in, which each example contains as far as
its reply: the text of an example is as long as the conversation, by the
method, and is bounded by the size of a string and not of a group.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET_ROLE = "assistant"
FLUSH_CHARS = 1 << 20


def escaped(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if role else text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda found: "\n" if found[1] == "n" else found[1], text)


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    turns = []
    place = 0
    while place < len(text):
        role_end = text.index("\n", place)
        end = text.index(END, role_end + 1)
        turns.append((unescaped(text[place + len(START) : role_end]), unescaped(text[role_end + 1 : end])))
        place = end + len(END)
    return turns


def examples(rows: Iterable[tuple]) -> Iterator[tuple]:
    """``(conv_id, example, text, loss_start, loss_end)`` of ordered rows ``(conv_id, role, text)``; an empty mask is null."""
    current, prefix, number, waiting = object(), "", 0, False
    for conv_id, role, text in rows:
        if conv_id != current:
            if waiting:
                yield current, number, prefix, None, None
            current, prefix, number = conv_id, "", 0
        head = f"{START}{escaped(role or '', role=True)}\n"
        body = escaped(text or "")
        begin = len(prefix) + len(head)
        prefix = f"{prefix}{head}{body}{END}"
        waiting = role != TARGET_ROLE
        if not waiting:
            yield current, number, prefix, begin, begin + len(body)
            number += 1
    if waiting:
        yield current, number, prefix, None, None


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield tuple(batch.column(name)[row].as_py() for name in names)


def _expanded(schema: pa.Schema):
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for row in examples(_rows(batches, ("conv_id", "role", "text"))):
            held.append(row)
            chars += len(row[2])
            if chars >= FLUSH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                held, chars = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    return expand


def expanded(conversations: DataFrame) -> DataFrame:
    """One row ``conv_id, example, text, loss_start, loss_end`` for each example, a conversation's in order and together.

    The mask counts code points. It is null where nothing is trained on.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turns = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
    turns = turns.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    arrow = pa.schema(
        [
            ("conv_id", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]),
            ("example", pa.int64()),
            ("text", pa.string()),
            ("loss_start", pa.int64()),
            ("loss_end", pa.int64()),
        ]
    )
    return turns.mapInArrow(_expanded(arrow), f"conv_id {kind}, example bigint, text string, loss_start bigint, loss_end bigint")


def read_back(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Digests of each conversation from its examples ``(conv_id, text, loss_start, loss_end)``, the longest last."""
    current, last = object(), None
    chars = loss_chars = 0
    loss = hashlib.sha256()

    def done() -> tuple:
        digest, turns = hashlib.sha256(), parsed(last)
        for role, text in turns:
            digest.update(f"{role}\n{text}\n".encode())
        return current, len(turns), digest.hexdigest(), loss_chars, loss.hexdigest(), chars

    for conv_id, text, begin, end in rows:
        if conv_id != current:
            if last is not None:
                yield done()
            current, chars, loss_chars, loss = conv_id, 0, 0, hashlib.sha256()
        last = text
        chars += len(text)
        if begin is not None:
            reply = unescaped(text[begin:end])
            loss_chars += len(reply)
            loss.update(reply.encode())
    if last is not None:
        yield done()


DIGESTS = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _digested(kind: pa.DataType):
    types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], ["conv_id", *DIGESTS])

        for row in read_back(_rows(batches, ("conv_id", "text", "loss_start", "loss_end"))):
            held.append(row)
            if len(held) == 1000:
                yield batch()
                held = []
        if held:
            yield batch()

    return digest


def digests(found: DataFrame) -> DataFrame:
    """What the examples of ``expanded`` say about each conversation; rows are read in their order, without a shuffle."""
    kind = found.schema["conv_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return found.select("conv_id", "text", "loss_start", "loss_end").mapInArrow(_digested(arrow), schema)


def extra_conversation(conversations: DataFrame) -> DataFrame:
    """Conversation -1, whose two texts are made of control strings."""
    text = f"{END.strip()}{START}assistant ok"
    rows = [(-1, 0, "user", text), (-1, 1, "assistant", text)]
    return conversations.sparkSession.createDataFrame(rows, conversations.select("conv_id", "turn", "role", "text").schema)
