"""Chat formatting with a template that is only called, never looked into.

A template is a function from a list of turns to a string.  The turns of each
conversation are rendered as successive prefixes; consecutive outputs are compared:
what the longer one has beyond the shorter one is the turn's piece.  A common ending,
such as a closing mark, is left out of pieces and kept apart.  Where the shorter output
is not a prefix of the longer one even so, the template has rewritten history and the
turn is marked.  One more rendering with a probe in place of the text shows where the
text stands inside the piece, and so the loss mask.

Prefixes are whole, so that every turn is compared with all of its conversation before
it; its turns are held while it is worked on, and n turns take about n * n renderings of
a turn (the output of the last prefix is kept, not made again).  A template may say how
many turns before a turn its rendering depends on (``memory``).  Prefixes then begin that
many turns back, which keeps the work linear and a task's memory at a few turns; each
turn is also rendered with one turn more in front, and one whose piece changes by that
is marked.  ``MARKED``, which op12 uses, does not say so.

Turns are dealt by conversation and sorted within their task (a sort that spills), then
read as a stream: a conversation is never a group in memory.  Digests over all of a
conversation's text are taken in order, which is one stream per conversation by nature.

Ties of conv_id and turn go by role and text, nulls first; repeated rows are turns of
their own.  Null roles and texts are empty, null turns come first, rows with a null
conv_id are one conversation.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBES = "\ue000\ue001\uf8ff"
TURNS = "conv_id long, position long, role string, piece string, start long, text_start long, text_chars long, loss boolean, rewritten boolean, closing string"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class Template:
    """``render`` turns dicts of role and text into the output, ``read`` yields (role, text) of complete turns with what is left
    of the output, ``unescape`` gives a text under the mask back; ``memory``: turns that a turn's rendering looks back at, None for all."""

    render: Callable[[list[dict]], str]
    read: Callable[[str], tuple[list[tuple[str, str]], str]]
    unescape: Callable[[str], str]
    memory: int | None = None


# The marks of the template; inside texts a backslash goes between "<" and "|", one more where there are some already.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_MARK, _MARKED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.S)


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render_marked(turns: list[dict]) -> str:
    return "".join(f"{OPEN}{_role_out(t['role'])}\n{escape(t['text'])}{CLOSE}\n" for t in turns)


def read_marked(output: str) -> tuple[list[tuple[str, str]], str]:
    found, end = [], 0
    while m := _TURN.match(output, end):
        found.append((_role_in(m[1]), unescape(m[2])))
        end = m.end()
    return found, output[end:]


MARKED = Template(render_marked, read_marked, unescape)


@dataclass(frozen=True)
class Placed:
    """A turn's piece of the output, where the text stands in it (-1: nowhere, or not once), the output's ending, whether history was
    rewritten, and the whole output."""

    piece: str
    text_at: int
    text_chars: int
    closing: str
    rewritten: bool
    output: str


def place(render: Callable[[list[dict]], str], before: list[dict], turn: dict, short: str | None = None) -> Placed:
    """Compares the outputs of a prefix with and without its last turn; ``short`` is the one without where it is known."""
    if short is None:
        short = render(before) if before else ""
    long = render([*before, turn])
    shared = len(short) if long.startswith(short) else len(os.path.commonprefix([short, long]))
    closing = short[shared:]
    if not before:  # the turn put after itself shows how outputs end
        twice = render([turn, turn])
        same = len(os.path.commonprefix([long, twice]))
        closing = long[same:] if same and twice.endswith(long[same:]) else ""
    rewritten = not long.endswith(closing)
    if rewritten:
        closing = ""
    body = len(long) - len(closing)
    rewritten |= body < shared
    probe = next((p for p in PROBES if p not in long), None)
    text_at, text_chars = -1, 0
    if probe:
        probed = render([*before, {**turn, "text": probe}])
        head, mark, tail = probed.partition(probe)
        if mark and probe not in tail and long.startswith(head) and long.endswith(tail) and len(head) >= shared and len(long) >= len(head) + len(tail):
            text_at, text_chars = len(head) - shared, len(long) - len(head) - len(tail)
    return Placed(long[shared:body], text_at, text_chars, closing, rewritten, long)


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows with whether each begins a new group of its first column."""
    last: object = _sorted_rows
    for batch in batches:
        for row in batch.to_pylist():
            key = next(iter(row.values()))
            yield key != last, row
            last = key


def _batched(rows: Iterator[tuple], schema: pa.Schema, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of rows of about ``limit`` characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in text.split(", ")])


def formatted_turns(rows: DataFrame, template: Template = MARKED, trained: str = "assistant") -> DataFrame:
    """One row per turn of (conv_id, turn, role, text), in the order of conversation and turn within each task: position, role, piece, start
    (code points of the output before it), text_start and text_chars (the text's place in the output, null where the template does not
    show it once), loss (texts of ``trained`` turns), rewritten, and the closing of the output up to this turn."""
    memory = template.memory

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        before: list[dict] = []
        position, start, output = 0, 0, None
        for new, row in _sorted_rows(batches):
            if new:
                before, position, start, output = [], 0, 0, None
            turn = {"role": row["role"] or "", "text": row["text"] or ""}
            context = before if memory is None else before[len(before) - memory:] if memory else []
            p = place(template.render, context, turn, output if memory is None else None)
            output = p.output
            if memory is not None and position > memory:
                wider = place(template.render, before[-memory - 1:], turn)
                rewritten = p.rewritten or wider.rewritten or wider.piece != p.piece
            else:
                rewritten = p.rewritten
            shown = p.text_at >= 0
            yield (row["conv_id"], position, turn["role"], p.piece, start, start + p.text_at if shown else None, p.text_chars if shown else None,
                   shown and turn["role"] == trained, rewritten, p.closing)
            start, position = start + len(p.piece), position + 1
            before.append(turn)
            if memory is not None:
                before = before[-memory - 1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(turns(batches), _schema(TURNS))

    named = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return named.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(run, TURNS)


def read_back(turns: DataFrame, template: Template = MARKED) -> DataFrame:
    """Digests per conversation, read from the pieces and loss spans of ``formatted_turns``: the output is parsed for turns, the spans are unescaped."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, closing = None, ""
        state: list | None = None
        for new, row in _sorted_rows(batches):
            if new and state:
                yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4] + len(closing)
            if new:
                conv, state, rest = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0], ""
            piece, closing = row["piece"], row["closing"]
            found, rest = template.read(rest + piece)
            for role, text in found:
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            state[4] += len(piece)
            if row["loss"]:
                at = row["text_start"] - row["start"]
                text = template.unescape(piece[at:at + row["text_chars"]])
                state[2] += len(text)
                state[3].update(text.encode())
        if state:
            yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4] + len(closing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(digests(batches), _schema(READ))

    return turns.select("conv_id", "piece", "start", "text_start", "text_chars", "loss", "closing").mapInArrow(run, READ)
