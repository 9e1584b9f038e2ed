"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string.  A conversation's successive
turn prefixes are rendered; what each adds to the one before is that turn's span.  A render that
doesn't start with the one before rewrites history: then spans can't be told, the row says so and
nothing lies under the loss mask.

The loss mask covers the content of assistant turns.  Within a turn's span the content is located
by rendering, too: the span of the same turn with an empty text gives what stands before and behind;
where that leaves it open, one with a text of one character that occurs in neither settles it.

Rows are dealt by conversation and sorted, and stream through the worker: one conversation is in
memory at a time.  Every prefix is rendered, which is quadratic in the turns.  Only a template that declares
``turn_local = True``, that is, that renders each turn by itself, is rendered in blocks (see ``locate``).

Defined cases: null text or role is empty; rows with a null conv_id form one conversation; rows of
one turn number are ordered by role, then text, and repeated rows are repeated turns; a null turn
comes first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Span = tuple[str, int, int, int, int]
BLOCK = 128
SCHEMA = "conv_id long, n_turns long, formatted string, spans array<struct<role:string,start:long,stop:long,loss_start:long,loss_stop:long>>, rewrites_history boolean"
#: Escaped in texts and roles, so that no control string of the template can occur there.
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
LETTERS = {"\\": "\\", "l": "<", "h": "#", "c": ":"}


def escape(text: str) -> str:
    for raw, out in ESCAPES:
        text = text.replace(raw, out)
    return text


def unescape(text: str) -> str:
    head, *rest = text.split("\\")
    out, k = [head], 0
    while k < len(rest):
        part = rest[k]
        if part:
            out.append(LETTERS[part[0]] + part[1:])
        else:  # an escaped backslash: what follows it is plain
            k += 1
            out.append("\\" + rest[k])
        k += 1
    return "".join(out)


def plain_template(turns: Turns) -> str:
    return "".join(f"### {escape(role)}: {escape(text)} </turn>\n" for role, text in turns)


plain_template.turn_local = True


def parse(formatted: str) -> Turns:
    """The turns of ``plain_template``'s output."""
    out = []
    for block in formatted.split(" </turn>\n")[:-1]:
        role, _, text = block.removeprefix("### ").partition(": ")
        out.append((unescape(role), unescape(text)))
    return out


def _steps(context: Turns, turns: Turns, template: Callable[[Turns], str]) -> tuple[str, list[Span]] | None:
    """What ``turns`` add to the render of ``context``, and their spans in that; None if one of them rewrites it."""
    base = before = template(context) if context else ""
    spans = []
    for k, (role, text) in enumerate(turns):
        now = template([*context, *turns[: k + 1]])
        if not now.startswith(before):
            return None
        empty = template([*context, *turns[:k], (role, "")])
        start, stop = len(before) - len(base), len(now) - len(base)
        inner = (start, start)
        if text and empty.startswith(before):
            own, bare = now[len(before) :], empty[len(before) :]
            same = next((i for i, (a, b) in enumerate(zip(own, bare, strict=False)) if a != b), min(len(own), len(bare)))
            head = min(same, len(bare))
            # the longest head that still leaves the bare tail at the end
            while head and not own.endswith(bare[head:]):
                head -= 1
            if head and own.endswith(bare[head - 1 :]):  # the text begins as what stands behind it: a text that shares nothing with that tells
                mark = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in bare)
                told = template([*context, *turns[:k], (role, mark)])[len(before) :].find(mark)
                if 0 <= told < head and own.endswith(bare[told:]):
                    head = told
            inner = (start + head, stop - (len(bare) - head))
        spans.append((role, start, stop, *inner))
        before = now
    return before[len(base) :], spans


def locate(turns: Turns, template: Callable[[Turns], str], block: int = BLOCK) -> tuple[str, list[Span], bool]:
    """(whole output, (role, start, stop, content start, content stop) per turn, rewrites history).

    With a template that is ``turn_local``, behind the first ``block`` turns, a block's turns are rendered after the one turn before them, and the result is held against
    the render of the whole prefix at the block's end; where it differs, the block is done over with whole prefixes."""
    before, spans = "", []
    if not getattr(template, "turn_local", False):
        block = max(1, len(turns))
    for s in range(0, len(turns), block):
        part = turns[s : s + block]
        whole = template(turns[: s + len(part)])
        got = _steps(turns[max(0, s - 1) : s], part, template)
        if s and (got is None or before + got[0] != whole):
            got = _steps(turns[:s], part, template)
        if got is None or before + got[0] != whole:
            return template(turns), [], True
        spans += [(role, *(len(before) + x for x in at)) for role, *at in got[1]]
        before = whole
    return before, spans, False


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Turns]]:
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for conv, group in groupby(rows, key=lambda r: r[0]):
        yield conv, [(role, text) for _, role, text in group]


def format_chats(turns: DataFrame, template: Callable[[Turns], str] = plain_template, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``SCHEMA``."""
    ordered = (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    )

    def run(batches):
        out, size = [], 0
        for conv, chat in _conversations(batches):
            text, spans, rewrites = locate(chat, template)
            keep = [{"role": r, "start": a, "stop": b, "loss_start": c if r == loss_role else a, "loss_stop": d if r == loss_role else a} for r, a, b, c, d in spans]
            out.append({"conv_id": conv, "n_turns": len(chat), "formatted": text, "spans": keep, "rewrites_history": rewrites})
            size += len(text)
            if len(out) >= 2000 or size > 1 << 23:
                yield pa.RecordBatch.from_pylist(out, schema=ARROW)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return ordered.mapInArrow(run, SCHEMA)


_SPAN = pa.struct([("role", pa.string()), *((n, pa.int64()) for n in ("start", "stop", "loss_start", "loss_stop"))])
ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(_SPAN)), ("rewrites_history", pa.bool_())])
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"


def digests(formatted: DataFrame) -> DataFrame:
    """Hashes of what is read back from ``format_chats``' output by ``parse`` and the loss mask."""

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_pylist():
                text = row["formatted"]
                back = parse(text)
                loss = "".join(unescape(text[s["loss_start"] : s["loss_stop"]]) for s in row["spans"])
                turns = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in back).encode()).hexdigest()
                out.append((row["conv_id"], len(back), turns, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), row["rewrites_history"]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _DIGEST_TYPES, strict=True)] if out else [pa.array([], t) for t in _DIGEST_TYPES], names=_DIGEST_NAMES)

    return formatted.mapInArrow(run, DIGEST)


_DIGEST_NAMES = [x.split()[0] for x in DIGEST.split(", ")]
_DIGEST_TYPES = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in DIGEST.split(", ")]
