"""Chat logs as events, folded into final messages and rendered for training.

Windows over a conversation's events find what later edits and regenerations leave of it; the rest is read in order
from sorted partitions and folded as a stream: deltas extend the open message, and a finished message is
rendered at once, so no conversation is held as a whole. Rendering marks turns, escapes
what looks like a mark, and records which characters carry loss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinarium.llm.tables import arrow_rows

# The template.
HEAD, TAIL = "### ", "</turn>\n"
LEARNED = "assistant"

#: Characters after which a part of a rendered conversation ends.
PART = 1 << 20
EVENT_COLUMNS = ("conv_id", "seq", "kind", "turn", "role", "text")
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RENDERED_TYPES = {"conv_id": pa.int64(), "part": pa.int64(), "formatted": pa.string(), "loss": SPANS}
DIGEST_TYPES = {
    "conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(),
    "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(),
}
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)
RENDERED = "conv_id bigint, part bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"

_PLAIN = {r"\\": "\\", r"\h": "#", r"\l": "<", r"\n": "\n", r"\c": ":"}
_CODE = re.compile(r"\\[\\hlnc]")
_TURN = re.compile(r"### ([^\n:]*): (.*?)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """``text`` without anything that reads as a mark: no ``###`` and no ``</turn>`` is left in it."""
    return re.sub(r"#(?=##)", r"\\h", re.sub(r"<(?=/turn>)", r"\\l", text.replace("\\", "\\\\")))


def escape_role(role: str) -> str:
    """A role on one line, without colons and marks of its own."""
    return escape(role).replace("\n", "\\n").replace(":", "\\c")


def unescape(text: str) -> str:
    return _CODE.sub(lambda m: _PLAIN[m.group()], text)


def as_events(conversations: DataFrame) -> DataFrame:
    """Stored messages (``conv_id, turn, role, text``) as events: one ``message`` each, in the order of turns."""
    return conversations.select(
        "conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.col("turn").alias("turn"), "role", "text"
    )


def surviving(events: DataFrame) -> DataFrame:
    """The events that later ones leave: ``message``, ``delta`` and ``edit`` rows of the final messages.

    ``regenerate`` drops what came before it at its turn and later turns; ``edit`` replaces what its turn held. A
    delta or edit without a role has that of its turn. Order: ``seq``, nulls first; ties by turn, role, kind and text.
    Events without a turn are not dropped.
    """
    order = ("seq", "turn", "role", "kind", "text")
    later = W.partitionBy("conv_id").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    own = W.partitionBy("conv_id", "turn").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    cut = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later.rowsBetween(W.unboundedPreceding, -1))
    alive = (
        events.select(*EVENT_COLUMNS)
        .withColumn("_cut", cut)
        .filter("(_cut IS NULL OR turn IS NULL OR turn < _cut) AND NOT kind <=> 'regenerate'")
    )
    edited = F.max(F.col("kind") == "edit").over(own.rowsBetween(1, W.unboundedFollowing))
    earlier = F.last("role", ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1))
    role = F.when(F.col("kind").isin("delta", "edit"), F.coalesce("role", earlier)).otherwise(F.col("role"))
    return (
        alive.withColumn("_role", role)
        .withColumn("_edited", F.coalesce(edited, F.lit(False)) & F.col("turn").isNotNull())
        .filter("NOT _edited")
        .select("conv_id", "seq", "kind", "turn", F.col("_role").alias("role"), "text")
    )


def fold(events: Iterator[tuple]) -> Iterator[tuple[str, str]]:
    """Final ``role, text`` of one conversation's surviving events, given by turn."""
    turn, role, parts = None, "", []
    for _, _, kind, at, by, text in events:
        if kind not in ("message", "delta", "edit"):
            raise ValueError(f"unknown event {kind!r}")
        if parts and not (kind == "delta" and at == turn and by in (None, role)):
            yield role, "".join(parts)
            parts = []
        if not parts:
            turn, role = at, by or ""
        parts.append(text or "")
    if parts:
        yield role, "".join(parts)


def render(messages: Iterator[tuple[str, str]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Parts of a rendered conversation, cut between turns, and the loss spans within each."""
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in messages:
        head, body = f"{HEAD}{escape_role(role)}: ", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + TAIL)
        at += len(out[-1])
        if at >= PART:
            yield "".join(out), spans
            out, spans, at = [], [], 0
    if out:
        yield "".join(out), spans


def render_conversations(events: DataFrame) -> DataFrame:
    """``conv_id, part, formatted, loss`` of every conversation, parts in order within a partition.

    ``events``: ``conv_id, seq, kind, turn, role, text`` with kinds ``message``, ``delta``, ``edit`` and ``regenerate``; others
    are errors, null is ``message``. Messages come by turn (null first), then ``seq``. Null roles and texts are
    empty, events with a null ``conv_id`` form one conversation, repeated rows are repeated messages.
    ``loss`` holds the spans of assistant texts in ``formatted``, in code points.
    """
    known = events.withColumn("kind", F.coalesce("kind", F.lit("message")))
    ordered = (
        surviving(known)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "seq", "role", "kind", "text")
    )

    def format_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in arrow_rows(batch, *EVENT_COLUMNS))
        held: list[tuple] = []
        size = 0
        for conv_id, own in groupby(rows, key=lambda row: row[0]):
            for part, (formatted, spans) in enumerate(render(fold(own))):
                held.append((conv_id, part, formatted, [{"start": a, "end": b} for a, b in spans]))
                size += len(formatted)
                if size >= PART:
                    yield _batch(held, RENDERED_TYPES)
                    held, size = [], 0
        if held:
            yield _batch(held, RENDERED_TYPES)

    return ordered.mapInArrow(format_, RENDERED)


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], [*types])


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn of a rendered part."""
    for m in _TURN.finditer(formatted):
        yield unescape(m[1]), unescape(m[2])


def digests(rendered: DataFrame) -> DataFrame:
    """What can be read back from rendered conversations, part after part as they lie in their partitions.

    ``conv_id, n_turns, turns_sha256`` (role, line feed, text, line feed per turn), ``loss_chars, loss_sha256`` (of the unescaped text under
    the loss spans) and ``formatted_chars``.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in arrow_rows(batch, "conv_id", "part", "formatted", "loss"))
        out = []
        for conv_id, parts in groupby(rows, key=lambda row: row[0]):
            turns, loss, n_turns, n_loss, n_chars = sha256(), sha256(), 0, 0, 0
            for _, _, formatted, spans in parts:
                n_chars += len(formatted)
                for role, text in read_back(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    n_turns += 1
                for span in spans:
                    learned = unescape(formatted[span["start"] : span["end"]])
                    loss.update(learned.encode())
                    n_loss += len(learned)
            out.append((conv_id, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars))
            if len(out) >= 5000:
                yield _batch(out, DIGEST_TYPES)
                out = []
        if out:
            yield _batch(out, DIGEST_TYPES)

    return rendered.mapInArrow(digest, DIGESTS)
