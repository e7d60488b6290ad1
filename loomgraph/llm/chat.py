r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
its context and only the reply's text lies under the loss mask.  A turn is
written as ``### role: text </turn>`` and a line end; inside roles and texts a
backslash precedes each ``\``, ``#``, ``<`` (and ``:`` in roles), so no text
can pose as a mark, and dropping the backslashes gives the text back.

Turns behind the last reply, and conversations without one, become a last row
without a loss, so that nothing of a conversation is lost.  An example repeats
its whole context, so a conversation of n turns gives text in the order of
n * n; a task holds one conversation's text at a time and hands examples, with
or without a reply, on in batches of bounded size.

Defined results: null texts and roles are empty; turns are ordered by turn,
then role, then text, nulls first; repeated rows are turns of their own; a
null conversation id is one conversation; an empty table gives no examples;
further columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import whole

EXAMPLES = "conv_id long, example long, text string, loss_start long, loss_end long, turns long, last boolean"
_END = " </turn>\n"
_TEXT = str.maketrans({c: "\\" + c for c in "\\#<"})
_ROLE = str.maketrans({c: "\\" + c for c in "\\#<:"})
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_BATCH = 8_000_000


def head(role: str) -> str:
    return f"### {role.translate(_ROLE)}: "


def escape(text: str) -> str:
    return text.translate(_TEXT)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out = []
    for part in formatted.split(_END)[:-1]:
        m = _HEAD.match(part)
        out.append((unescape(m[1]), unescape(part[m.end() :])))
    return out


def expand(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One row per example: its text, the span of characters under the loss mask (null: none), its number of turns, and whether no other example begins with its turns."""

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        nothing = object()
        conv: object = nothing
        prefix, n, example, behind, reply = [], 0, 0, [], None

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 3, pa.bool_()], strict=True)], [x.split()[0] for x in EXAMPLES.split(", ")])

        def ended() -> list[tuple]:
            """The conversation's last reply, and what lies behind it."""
            rest = [(conv, example, "".join(behind), None, None, len(behind), True)] if behind else []
            return [(*reply, True), *rest] if reply else rest

        for batch in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fresh: list[tuple] = []
                if conv_id != conv or conv is nothing:
                    fresh = ended()
                    conv, prefix, n, example, behind, reply = conv_id, [], 0, 0, [], None
                start = head(role)
                body = escape(text)
                turn = start + body + _END
                n += 1
                prefix.append(turn)
                behind.append(turn)
                if role == target_role:
                    if reply:
                        fresh.append((*reply, False))
                    prefix = ["".join(prefix)]
                    end = len(prefix[0]) - len(_END)
                    reply = (conv, example, prefix[0], end - len(body), end, n)
                    example, behind = example + 1, []
                out += fresh
                size += sum(len(x[2]) for x in fresh)
                if size > _BATCH:
                    yield flush()
                    out, size = [], 0
        out += ended()
        if out:
            yield flush()

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn"), whole("role").alias("role"), whole("text").alias("text"))
    # One conversation lies in one task, in order, and streams through it.
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(examples, EXAMPLES)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


_READ = "conv_id long, example long, chars long, target string, turns string"


def read_back(examples: DataFrame) -> DataFrame:
    """A row per conversation, from the formatted examples alone: digests of its turns and of what is trained on.

    Each example is read where it lies; only its reply, and the turns of those
    that no other repeats, are moved.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, targets, turns = [], [], []
            for text, start, end, last in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                chars.append(len(text))
                targets.append(None if start is None else unescape(text[start:end]))
                turns.append(text if last else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chars, pa.int64()), pa.array(targets, pa.string()), pa.array(turns, pa.string())], [x.split()[0] for x in _READ.split(", ")])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        conv: object = nothing
        turns, loss, loss_chars, chars, out = [], hashlib.sha256(), 0, 0, []

        def close() -> None:
            found = hashlib.sha256()
            parsed = parse("".join(turns))
            for role, text in parsed:
                found.update(f"{role}\n{text}\n".encode())
            out.append((conv, len(parsed), found.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for batch in batches:
            for conv_id, n, target, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv is nothing or conv_id != conv:
                    if conv is not nothing:
                        close()
                    conv, turns, loss, loss_chars, chars = conv_id, [], hashlib.sha256(), 0, 0
                chars += n
                if target is not None:
                    loss.update(target.encode())
                    loss_chars += len(target)
                if said is not None:  # the last reply with all before it, then what lies behind it
                    turns.append(said)
            if len(out) > 10_000:
                yield _digests(out)
                out = []
        if conv is not nothing:
            close()
        if out:
            yield _digests(out)

    read = examples.select("conv_id", "example", "text", "loss_start", "loss_end", "last").mapInArrow(parts, _READ)
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return ordered.select("conv_id", "chars", "target", "turns").mapInArrow(digests, DIGESTS)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
