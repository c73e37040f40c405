"""Chat formatting by event-sourced reconstruction (operator 8).

A log holds events of conversations. They are partitioned by conversation and sorted
by message and sequence, and folded in one streaming pass per partition that holds a
single message at a time, so a conversation of any length needs no more memory than
its longest message:

message     opens a message with its role and text
delta       appends text to it
edit        puts other text in its place
regenerate  empties it; the deltas that follow build it anew
delete      takes it out

The template marks each turn, with the role percent-encoded:

    <|im_start|>ROLE\\n TEXT <|im_end|>\\n   (without the blanks)

Inside texts a backslash is doubled and a backslash is put after the first character
of every control string, so no text can end or open a turn and unescaping is exact.
Rows hold one rendered turn each with the place of its loss text; a conversation's
output is its rows in order.

Defined results: null texts are empty; null roles are the empty role; rows that share
a conversation and a turn are turns of their own, ordered by role and text; a null
conversation id is one conversation; an event of another kind, or one before its
message was opened, changes nothing; other columns are ignored; an empty log gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this template and of other common ones.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*)" + re.escape(CLOSE), re.DOTALL)

RENDERED = "conv_id long, message long, role string, formatted string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def render(role: str, text: str, trained: tuple[str, ...]) -> tuple[str, int | None, int | None]:
    """The formatted turn and the code points of its text if the role is trained on."""
    head = f"{OPEN}{quote(role, safe='')}\n"
    body = escape(text)
    span = (len(head), len(head) + len(body)) if role in trained else (None, None)
    return head + body + CLOSE, *span


def parse(formatted: str) -> tuple[str, str]:
    match = _TURN.fullmatch(formatted)
    if not match:
        raise ValueError("not a formatted turn")
    return unquote(match[1]), unescape(match[2])


def reconstruct(events: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rendered turns, a row each, in conversation order inside each partition.

    ``events``: conv_id, message, seq (longs), kind, role, text (strings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # conv_id, message, role, pieces of text

        def close() -> list[tuple]:
            return [] if held is None else [(*held[:3], *render(held[2], "".join(held[3]), trained))]

        for batch in batches:
            done: list[tuple] = []
            for conv, message, kind, role, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held is not None and (conv, message) != tuple(held[:2]):
                    done += close()
                    held = None
                if kind == "message":
                    done += close()
                    held = [conv, message, role or "", [text or ""]]
                elif held is None:
                    continue
                elif kind == "delta":
                    held[3].append(text or "")
                elif kind == "edit":
                    held[3] = [text or ""]
                elif kind == "regenerate":
                    held[3] = []
                elif kind == "delete":
                    held = None
            yield pack(done)
        yield pack(close())

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in RENDERED.split(", ")])

    wanted = events.select(F.col("conv_id").cast("long"), F.col("message").cast("long"), "kind", "role", "text", F.col("seq").cast("long"))
    ordered = wanted.repartition("conv_id").sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text")
    return ordered.drop("seq").mapInArrow(run, RENDERED)


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted turns as they stream by.

    Takes ``reconstruct``'s rows as they are partitioned and ordered."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def close() -> list[tuple]:
            return [] if state is None else [(state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])]

        for batch in batches:
            done: list[tuple] = []
            for conv, formatted, begin, end in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5))):
                if state is None or state[0] != conv:
                    done += close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(formatted)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if begin is not None:
                    loss = unescape(formatted[begin:end])
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += len(formatted)
            yield pack(done)
        yield pack(close())

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return rendered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_events(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a log: each row opens its own message."""
    return conversations.select(
        "conv_id", F.col("turn").alias("message"), F.lit(0).alias("seq"), F.lit("message").alias("kind"), "role", "text")
