"""Chat formatting by incremental rendering of a black-box template, and reading it back.

A template is any function of a list of turns (role, text) that returns a
text.  It is never looked into: the first turns, one more each time, are
rendered, and what an output has more than the one before is the span of the
turn that came last.  If an output doesn't begin with the one before, the
template rewrites history (as some do that shorten earlier turns): the first
turn at which it does is given out, and neither spans nor a loss mask, for a
place in one output then means nothing in the next.  Where a turn's own text
lies within its span is found alike, by rendering the turn with two probe
texts: what their outputs have in common at both ends is the frame around
the text.

The template `marked` writes <|im_start|>role, newline, text, <|im_end|>,
newline.  Control strings within texts are escaped by one backslash more
behind their <, so no text can end its turn or begin another, and taken back
when read.  Percent signs and newlines of roles are written as %25 and %0A.

How it scales: one shuffle by conversation, sorted by turn; a task holds one
conversation at a time, which is also one row of the result.  Rendering every
prefix costs the square of a conversation's turns (probing a template that
may look at all of them can't be done for less); 400 turns take milliseconds.

Defined cases: null texts and roles are empty; turns are sorted with nulls
first, rows of the same turn by role and text, all of them kept; rows without
conv_id are one conversation; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNT = ("assistant",)
#: Two texts that have no character in common at either end.
PROBES = ("\x02a\x03", "\x04b\x05")

#: Formatted conversations go back to Spark in batches of about so many characters.
BATCH_CHARS = 1 << 20

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

SPAN = "struct<role: string, begin: int, end: int, text_begin: int, text_end: int, loss: boolean>"
FORMATTED = f"conv_id bigint, n_turns bigint, formatted string, spans array<{SPAN}>, rewritten_at int"
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewritten_at int"


def escape(text: str) -> str:
    if "|" not in text:
        return text
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def marked(turns: list[Turn]) -> str:
    name = lambda role: escape(role.replace("%", "%25").replace("\n", "%0A"))
    return "".join(f"{START}{name(role)}\n{escape(text)}{END}" for role, text in turns)


def turns_of(formatted: str) -> list[Turn]:
    """The turns that `marked` wrote."""
    found = []
    for part in formatted.split(START)[1:]:
        role, text = part.removesuffix(END).split("\n", 1)
        found.append((unescape(role).replace("%0A", "\n").replace("%25", "%"), unescape(text)))
    return found


def _frame(template: Template, before: list[Turn], role: str, begin: int) -> tuple[int, int]:
    """Characters before and behind the text in the span of a turn that comes after `before`."""
    a, b = (template([*before, (role, p)])[begin:] for p in PROBES)
    head = len(os.path.commonprefix([a, b]))
    tail = len(os.path.commonprefix([a[head:][::-1], b[head:][::-1]]))
    return head, tail


def render(turns: list[Turn], template: Template, learnt: tuple[str, ...] = LEARNT):
    """(text, spans, first turn at which earlier output was rewritten or None) of a conversation."""
    text, spans = template([]), []
    for i, (role, _) in enumerate(turns):
        longer = template(turns[: i + 1])
        if not longer.startswith(text):
            return template(turns), [], i
        begin, end = len(text), len(longer)
        loss = role in learnt
        head, tail = _frame(template, turns[:i], role, begin) if loss else (0, 0)
        spans.append((role, begin, end, min(begin + head, end), max(end - tail, min(begin + head, end)), loss))
        text = longer
    return text, spans, None


def _conversations(batches):
    """(conv_id, turns) of rows sorted by conversation, across batches."""
    key, turns = None, []
    for batch in batches:
        for *now, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if now != key and turns:
                yield key[0], turns
                turns = []
            key = now
            turns.append((role, text))
    if turns:
        yield key[0], turns


def _rendered(batches, template: Template, learnt: tuple[str, ...]):
    names = ("role", "begin", "end", "text_begin", "text_end", "loss")
    span = pa.struct([("role", pa.string()), *[(n, pa.int32()) for n in names[1:5]], ("loss", pa.bool_())])
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "formatted": pa.string(), "spans": pa.list_(span), "rewritten_at": pa.int32()}

    def batch_of(rows):
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    rows, held = [], 0
    for conv, turns in _conversations(batches):
        text, spans, rewritten = render(turns, template, learnt)
        rows.append((conv, len(turns), text, [dict(zip(names, s, strict=True)) for s in spans], rewritten))
        held += len(text)
        if held > BATCH_CHARS:
            yield batch_of(rows)
            rows, held = [], 0
    yield batch_of(rows)


def format_chats(chats: DataFrame, template: Template = marked, learnt: tuple[str, ...] = LEARNT) -> DataFrame:
    """(conv_id, n_turns, formatted, spans, rewritten_at) of the conversations in chats (conv_id, turn, role, text).

    spans holds each turn's place in formatted, that of its text, and whether
    it is learnt from; places are code points.  Where rewritten_at is not
    null, the template changed earlier output at that turn (from 0) and there
    are no spans.
    """
    rows = chats.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")],
    )
    order = ["conv_id", "turn", "role", "text"]
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")
    return sorted_rows.mapInArrow(partial(_rendered, template=template, learnt=learnt), FORMATTED)


def _read(batches):
    digest = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            formatted = row["formatted"]
            turns = turns_of(formatted)
            loss = [unescape(formatted[s["text_begin"] : s["text_end"]]) for s in row["spans"] if s["loss"]]
            out.append({
                "conv_id": row["conv_id"], "n_turns": len(turns),
                "turns_sha256": digest(x for role, text in turns for x in (role, "\n", text, "\n")),
                "loss_chars": sum(map(len, loss)), "loss_sha256": digest(loss),
                "formatted_chars": len(formatted), "rewritten_at": row["rewritten_at"],
            })
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
        names = [f.split()[0] for f in READ.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds, strict=True)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """What texts written by `marked` hold: their turns and the text under the loss mask, unescaped, as counts and digests."""
    return formatted.mapInArrow(_read, READ)
