"""Chat formatting by event-sourced reconstruction.

Logs are partitioned by conversation and sorted by sequence inside their partition. One pass streams over a
partition and folds each message's events (message, delta, edit, regenerate) into its final text, which it
renders at once. A conversation is never gathered: its rendering leaves in segments of whole turns.

Template::

    <|turn|>role<|text|>text<|end|>

Inside roles and texts ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so no marker can stand in them.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import pick

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
SEGMENT_CHARS = 1 << 18
BODY = r"([^<\\]*(?:(?:\\.|<(?!\|))[^<\\]*)*)"
PARSE = re.compile(rf"<\|turn\|>{BODY}<\|text\|>{BODY}<\|end\|>", re.S)
FORMATTED = "conv_id long, segment long, formatted string, loss array<struct<begin:long,end:long>>"
LOSS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def fold(kind: str | None, text: str, current: str) -> str:
    """A message's text after an event. An unknown kind fails rather than being passed over."""
    if kind == "delta":
        return current + text
    if kind in ("edit", "message", None):
        return text
    if kind == "regenerate":
        return text
    raise ValueError(f"unknown kind of event: {kind}")


class Segments:
    """Collects rendered turns of one conversation after another."""

    def __init__(self, trained: str):
        self.trained, self.rows, self.conv, self.segment = trained, [], None, 0
        self.parts, self.length, self.loss = [], 0, []

    def turn(self, conv, role: str, text: str) -> None:
        if self.parts and (conv != self.conv or self.length >= SEGMENT_CHARS):
            self.close()
        if conv != self.conv:
            self.conv, self.segment = conv, 0
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == self.trained:
            self.loss.append({"begin": self.length + len(head), "end": self.length + len(head) + len(body)})
        self.parts += (head, body, END)
        self.length += len(head) + len(body) + len(END)

    def close(self) -> None:
        if self.parts:
            self.rows.append((self.conv, self.segment, "".join(self.parts), self.loss))
            self.parts, self.length, self.loss, self.segment = [], 0, [], self.segment + 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        c = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], LOSS)], names=["conv_id", "segment", "formatted", "loss"])


def _render(trained: str):
    def run(batches):
        out, key, role, text, open_ = Segments(trained), None, "", "", False
        conversation, cut, begun = None, None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for conv, turn, kind, r, t, seq in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)):
                    kind, r, t = kind or "message", r or "", t or ""
                    if cut is not None and conv != conversation:
                        cut = None
                    conversation = conv
                    # What followed a turn goes when that turn is generated anew, unless it came after that.
                    if cut is not None and turn != begun and (seq is None or seq < cut):
                        continue
                    if kind == "regenerate" and seq is not None and (cut is None or seq > cut):
                        cut, begun = seq, turn
                    if not open_ or (conv, turn) != key or kind == "message":
                        if open_:
                            out.turn(key[0], role, text)
                        key, role, text, open_ = (conv, turn), r, "", True
                    text = fold(kind, t, text)
                if out.rows:
                    yield out.batch()
        if open_:
            out.turn(key[0], role, text)
        out.close()
        yield out.batch()

    return run


def chat_format(events: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Format the conversations of ``events`` (conv_id, turn, role, text; optionally kind and seq).

    An event's kind is ``message`` (begins a turn; also when null or without that column), ``delta`` (appends
    to the turn's text), ``edit`` (replaces it) or ``regenerate`` (replaces it, and takes away the events of later
    turns whose seq is lower or null: they answered what is gone). Events of a turn are folded in the order of seq;
    without it, or on ties, in the order of kind, role, text, nulls first.

    Returns rows (conv_id, segment, formatted, loss), a conversation's segments in order: whole turns of about
    SEGMENT_CHARS characters together, and the places (code points of the segment) of the trained role's
    texts, escapes included. Concatenated segments are the formatted conversation.

    A null role or text counts as empty; a null conv_id is a conversation of its own; null turns come first.
    Repeated message rows are turns of their own. An empty table gives an empty result; other columns are
    ignored. Memory is bounded by one turn and one segment, also for a conversation of a third of all rows.
    """
    have = events.columns
    names = [c for c in ("conv_id", "turn", "role", "text", "kind", "seq") if c in have]
    e = pick(events, *names)
    e = e.select("conv_id", "turn", (F.col("kind") if "kind" in have else F.lit("message")).alias("kind"), "role", "text", (F.col("seq") if "seq" in have else F.lit(0)).cast("long").alias("seq"))
    ordered = e.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
    return ordered.select("conv_id", "turn", "kind", "role", "text", "seq").mapInArrow(_render(trained_role), FORMATTED)


class Reader:
    """Digests of one conversation, read back from its segments."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, loss) -> None:
        at = 0
        for m in PARSE.finditer(formatted):
            if m.start() != at:
                raise ValueError("the text does not parse")
            at = m.end()
            self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            self.n += 1
        if at != len(formatted):
            raise ValueError("the text does not parse")
        for span in loss:
            text = unescape(formatted[span["begin"] : span["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)


def _read_back(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    conv, reader = None, None
    for batch in batches:
        rows = []
        for c, s, text, loss in zip(*(x.to_pylist() for x in batch.columns)):
            if reader is None or s == 0:
                if reader is not None:
                    rows.append((conv, reader.n, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))
                conv, reader = c, Reader()
            reader.add(text, loss)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
    if reader is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), *[pa.array([x]) for x in (reader.n, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars)]], names=names)


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, parsed from ``chat_format``'s rows in their own order.

    A text that does not parse fails. Loss texts are what lies under the loss spans, unescaped.
    """
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
