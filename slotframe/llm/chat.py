"""Chat formatting with typed content parts.

A turn is a list of typed parts (text, image, audio, document).  A visitor walks
the parts in order: text is escaped and copied, every other part becomes a
placeholder ``<|kind:n|>`` numbered within its conversation, an attachment
reference is recorded under that number and the token count the part expands to
is added up.  Turns are wrapped in control strings; a backslash before every
control character that a text holds makes the wrapping reversible.

Defined cases: a null text or part list is empty text; null turns come first, ties
of one turn are ordered by role and text, and repeated rows stay repeated turns; a
null conversation id is a conversation of its own; a null role is an empty one.  A
conversation is streamed turn by turn, in a bounded amount of memory apart from one
turn, so one that holds a third of all rows is slow but fits: its digests are over its turns in
order, which no two tasks can share.  An empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings. None can occur in an escaped text, for each holds "<|".
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
PART_TYPE = "struct<kind:string,text:string,ref:string,n_tokens:bigint>"
PARTS_TYPE = f"array<{PART_TYPE}>"
_ESCAPE = re.compile(r"[\\<]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_BODY = re.compile(r"\\(.)|<\|(?:image|audio|document):\d+\|>", re.S)


def escape(text: str) -> str:
    r"""Backslash before every backslash and "<": the result holds no "<|" but after a backslash."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


@dataclass
class PartVisitor:
    """Flattens parts; numbers, references and token counts run on over the turns of a conversation."""

    refs: list[tuple[int, str, str, int]] = field(default_factory=list)
    tokens: int = 0
    count: int = 0

    def visit(self, parts: Iterable[dict] | None) -> str:
        return "".join(getattr(self, f"visit_{p.get('kind') or 'text'}", self.visit_unknown)(p) for p in parts or () if p)

    def visit_text(self, p: dict) -> str:
        return escape(p.get("text") or "")

    def _attach(self, kind: str, p: dict) -> str:
        self.count += 1
        n = int(p.get("n_tokens") or 0)
        self.tokens += n
        self.refs.append((self.count, kind, p.get("ref") or "", n))
        return f"<|{kind}:{self.count}|>"

    def visit_image(self, p: dict) -> str:
        return self._attach("image", p)

    def visit_audio(self, p: dict) -> str:
        return self._attach("audio", p)

    def visit_document(self, p: dict) -> str:
        return self._attach("document", p)

    def visit_unknown(self, p: dict) -> str:
        raise ValueError(f"unknown part kind {p.get('kind')!r}")


def format_turn(role: str | None, parts: Iterable[dict] | None, visitor: PartVisitor) -> tuple[str, tuple[int, int]]:
    """The wrapped turn and the span of it that the loss mask covers (empty unless an assistant speaks)."""
    head = TURN + escape(role or "") + BODY
    body = visitor.visit(parts)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return head + body + END, span


_TURN_RE = re.compile(r"<\|turn\|>((?:[^\\<]++|\\.)*+)<\|body\|>((?:[^\\<]++|\\.|<\|(?:image|audio|document):\d++\|>)*+)<\|end\|>\n", re.S)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, body still escaped) of each turn; an error if anything lies between or behind."""
    at = 0
    for m in _TURN_RE.finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        yield unescape(m[1]), m[2]
    if at != len(formatted):
        raise ValueError(f"unreadable turn at character {at}")


def body_text(body: str) -> str:
    """The text of a formatted body without its placeholders."""
    return _BODY.sub(lambda m: m[1] or "", body)


def text_parts(text: Column) -> Column:
    """One text part for a plain text column."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("n_tokens"))).cast(PARTS_TYPE)


FORMATTED = "conv_id bigint, pos bigint, role string, formatted string, loss_start bigint, loss_end bigint, refs array<struct<n:bigint,kind:string,ref:string,n_tokens:bigint>>, attached_tokens bigint"


def format_conversations(rows: DataFrame, conv="conv_id", turn="turn", role="role", parts="parts") -> DataFrame:
    """One row a turn, in order: the formatted turn, its loss span, its references and token count.

    Conversations are dealt out by id and sorted by turn inside a partition; Python streams over them.
    ``formatted`` of a conversation's rows, joined by nothing in the order of ``pos``, is the conversation.
    """
    p = F.col(parts)
    tie = F.transform(p, lambda x: F.coalesce(x["text"], F.lit("")))
    ordered = (
        rows.select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.col(role).cast("string").alias("role"), p.cast(PARTS_TYPE).alias("parts"), F.array_join(tie, "\n").alias("tie"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "tie")
        .drop("tie")
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("refs", pa.list_(pa.struct([("n", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int64())]))), ("attached_tokens", pa.int64())])
        now, visitor, pos = object(), PartVisitor(), 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["conv_id"] != now:
                    now, visitor, pos = r["conv_id"], PartVisitor(), 0
                visitor.refs, visitor.tokens = [], 0
                text, (a, b) = format_turn(r["role"], r["parts"], visitor)
                refs = [dict(zip(("n", "kind", "ref", "n_tokens"), x, strict=True)) for x in visitor.refs]
                out.append({"conv_id": now, "pos": pos, "role": r["role"], "formatted": text, "loss_start": a, "loss_end": b, "refs": refs, "attached_tokens": visitor.tokens})
                pos += 1
            yield pa.RecordBatch.from_pylist(out, schema)

    return ordered.mapInArrow(stream, FORMATTED)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, attached_tokens bigint"


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: one row a conversation with digests of its turns and of its loss text.

    Takes what :func:`format_conversations` returns, whose partitions hold whole conversations in order.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("attached_tokens", pa.int64())])
        state: list = []

        def close() -> dict:
            conv, n, turns, loss_n, loss, size, tokens = state
            return dict(zip(schema.names, (conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), size, tokens), strict=True))

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["pos"] == 0:
                    if state:
                        out.append(close())
                    state[:] = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                text = r["formatted"]
                for role, body in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{body_text(body)}\n".encode())
                masked = body_text(text[r["loss_start"] : r["loss_end"]])
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5] += len(text)
                state[6] += r["attached_tokens"]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if state:
            yield pa.RecordBatch.from_pylist([close()], schema)

    return formatted.mapInArrow(stream, DIGEST)
