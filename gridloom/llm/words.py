"""Words of many texts at once, as numpy arrays over an Arrow column's UTF-8 bytes.

A text is never cut. A batch is taken in slices of whole texts of about SLICE_BYTES, which bounds the
temporary arrays (some forty bytes for each byte of text); one longer text makes a slice of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def class_table(separators) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, lower-case a-z and everything beyond ASCII.
ALNUM = class_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: [^\x20\x09-\x0D]+ : runs without ASCII white space.
SPACED = class_table([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base
    with np.errstate(over="ignore"):
        while done < n:
            m = min(done, n - done)
            out[done : done + m] = out[:m] * step
            done += m
            step = step * step
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def join_hash(parts: list[np.ndarray]) -> np.ndarray:
    """An order-sensitive hash of several hash columns."""
    h = np.full(len(parts[0]), 0x243F6A8885A308D3, np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + p)
    return h


class Slice:
    """Whole texts: raw and lower-cased bytes, and each text's first and last offset."""

    def __init__(self, batch: pa.RecordBatch, raw: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.batch, self.raw, self.start, self.end = batch, raw, start, end
        self.rows = len(start)
        self.low = LOWER[raw]

    def words(self, table: np.ndarray) -> Words:
        return Words(self, table)


class Words:
    """start, end: byte offsets of each word; doc: its row in the slice; first: each row's first word's number."""

    _powers: dict[str, np.ndarray] = {}

    def __init__(self, part: Slice, table: np.ndarray):
        low, n = part.low, len(part.low)
        inside = table[low]
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        begins = part.start[part.start < n]
        head[begins] = inside[begins]
        tail = inside.copy()
        tail[:-1] &= ~inside[1:]
        ends = part.end[(part.end > 0)] - 1
        tail[ends] = inside[ends]
        self.start, self.end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, part.start)
        self.count = np.searchsorted(self.start, part.end) - self.first
        self.doc = np.repeat(np.arange(part.rows), self.count)
        self.part, self._hash = part, None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            low = self.part.low
            if len(Words._powers.get("up", ())) < len(low) + 1:
                size = max(len(low) + 1, SLICE_BYTES * 2)
                Words._powers = {"up": powers(size, BASE), "down": powers(size, INVERSE)}
            with np.errstate(over="ignore"):
                total = np.zeros(len(low) + 1, np.uint64)
                np.cumsum((low.astype(np.uint64) + np.uint64(1)) * Words._powers["up"][: len(low)], out=total[1:])
                self._hash = mix((total[self.end] - total[self.start]) * Words._powers["down"][self.start])
        return self._hash

    def position(self) -> np.ndarray:
        """Each word's number in its own text."""
        return np.arange(len(self.start)) - np.repeat(self.first, self.count)

    def run(self, n: int) -> np.ndarray:
        """Numbers of the words that begin n words of one text."""
        at = np.arange(len(self.start) - n + 1) if len(self.start) >= n else np.zeros(0, np.int64)
        return at[self.doc[at] == self.doc[at + n - 1]]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Slices of ``batch``; a null text counts as empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    rows = len(texts)
    if not rows:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + rows + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        low, high = int(offsets[at]), int(offsets[to])
        yield Slice(batch.slice(at, to - at), data[low:high], (offsets[at:to] - low).astype(np.int64), (offsets[at + 1 : to + 1] - low).astype(np.int64))
        at = to


def hash_of(words: list[str], table: np.ndarray = ALNUM) -> list[np.uint64]:
    """The hashes that Words gives to these words."""
    batch = pa.record_batch([pa.array([" ".join(words)], pa.string())], ["text"])
    found = next(slices(batch)).words(table)
    if len(found.start) != len(words):
        raise ValueError(f"not one word each: {words}")
    return list(found.hash)


def phrase_words(text: str) -> list[str]:
    """ALNUM words of a short literal, lower-cased."""
    batch = pa.record_batch([pa.array([text], pa.string())], ["text"])
    part = next(slices(batch))
    w = part.words(ALNUM)
    low = part.low.tobytes()
    return [low[s:e].decode() for s, e in zip(w.start, w.end)]
