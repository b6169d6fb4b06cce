"""Byte-level BPE as a sentencepiece model that is written directly from a vocabulary of ranks.

A vocabulary file has one token a line: base64 of its bytes, a blank, its rank. Each of the 256 bytes is given a
character of its own, so that a token becomes a piece of text. A piece's score is its negative rank: sentencepiece
joins the neighbours whose piece scores highest, the leftmost of equal ones, which is the order of merges that ranks
stand for. The normaliser is the identity. Nothing is trained; the model is a message of some 1 MB, serialised by
the driver and sent to the tasks once.

A text is split into pre-tokens by a pattern; each is encoded alone. Tokens that merges do not rebuild from their
own bytes (a vocabulary may have some) are looked up as wholes, since a pre-token that is a token is that token.
Decoding maps each id's piece back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import pick, worker_cache

#: The character of byte b is chr(FIRST_CHAR + b): letters, none of which means anything to sentencepiece.
FIRST_CHAR = 0x100
#: Scores are 32-bit floats, which tell ranks below this apart.
MOST_RANKS = 1 << 24
#: Pre-tokens that a worker remembers, the longest of them, and the pre-tokens of a text that are held at a time.
CACHE_WORDS, CACHE_CHARS, HELD = 200_000, 64, 1 << 16
ENCODED = "doc_id long, ids binary"


def _number(n: int) -> bytes:
    """A protocol buffer's variable-length integer."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _bytes(field: int, data: bytes) -> bytes:
    return _number(field << 3 | 2) + _number(len(data)) + data


def _int(field: int, value: int) -> bytes:
    return _number(field << 3) + _number(value)


def spell(data: bytes) -> str:
    """Bytes as characters, one each."""
    return data.decode("latin-1").translate(SPELLING)


SPELLING = {b: FIRST_CHAR + b for b in range(256)}
UNSPELLING = {c: b for b, c in SPELLING.items()}


def serialise(tokens: list[bytes], ranks: list[int]) -> bytes:
    """A sentencepiece model of ``tokens`` by rising rank: field numbers are those of its published message format."""
    pieces = [_bytes(1, spell(t).encode()) + _number(2 << 3 | 5) + struct.pack("<f", -r) + _int(3, 1) for t, r in zip(tokens, ranks)]
    pieces.append(_bytes(1, b"<unk>") + _int(3, 2))  # the format asks for one; no byte leads to it
    trainer = _int(3, 2)  # BPE
    normaliser = _bytes(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0)  # no prefix, blanks kept as they are
    return b"".join(_bytes(1, p) for p in pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


@dataclass
class Vocabulary:
    """The model, each piece's rank (which is its id), wholes that merges do not rebuild, and the pattern of pre-tokens."""

    model: bytes
    ranks: np.ndarray
    wholes: dict[bytes, int]
    pattern: str

    @staticmethod
    def read(path: str, pattern: str) -> Vocabulary:
        """The vocabulary of a rank file on the driver. Each byte must be a token, and ranks must differ."""
        with open(path, "rb") as f:
            rank = {base64.b64decode(token): int(r) for token, r in map(bytes.split, f)}
        tokens = sorted(rank, key=rank.get)
        ranks = [rank[t] for t in tokens]
        if any(bytes([b]) not in rank for b in range(256)) or len(set(ranks)) < len(ranks) or not 0 <= ranks[0] <= ranks[-1] < MOST_RANKS:
            raise ValueError("not a vocabulary of all bytes with different ranks")
        out = Vocabulary(serialise(tokens, ranks), np.array(ranks, "<u4"), {}, pattern)
        processor = out.processor()
        for at in range(0, len(tokens), HELD):
            some = tokens[at : at + HELD]
            out.wholes |= {t: rank[t] for t, ids in zip(some, processor.encode([spell(t) for t in some])) if len(ids) > 1}
        return out

    def processor(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)


class Codec:
    """A worker's processor, what it remembers of pre-tokens, and the bytes of every id."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.v, self.processor = vocabulary, vocabulary.processor()
        self.find = regex.compile(vocabulary.pattern).finditer
        self.known: dict[str, bytes] = {}
        self.spelled = {int(r): self.processor.id_to_piece(k).translate(UNSPELLING).encode("latin-1") for k, r in enumerate(vocabulary.ranks)}

    @staticmethod
    def of(vocabulary: Vocabulary) -> Codec:
        cache, name = worker_cache(), hashlib.sha256(vocabulary.model + vocabulary.pattern.encode()).digest()
        if name not in cache:
            cache[name] = Codec(vocabulary)
        return cache[name]

    def words(self, words: list[str]) -> bytes:
        """The ids of pre-tokens, as little-endian 32-bit numbers."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list({w for w in words if w not in self.known})
        coded = self.processor.encode([spell(w.encode()) for w in new], num_threads=1) if new else []
        here = {w: self.v.ranks[ids].tobytes() for w, ids in zip(new, coded)}
        if self.v.wholes:
            here |= {w: struct.pack("<I", self.v.wholes[b]) for w in new if (b := w.encode()) in self.v.wholes}
        out = b"".join([self.known.get(w) or here[w] for w in words])
        self.known.update((w, b) for w, b in here.items() if len(w) <= CACHE_CHARS)
        return out

    def encode(self, text: str) -> bytes:
        found, parts = (m[0] for m in self.find(text)), []
        while words := list(itertools.islice(found, HELD)):
            parts.append(self.words(words))
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4")
        return b"".join([b"".join(map(self.spelled.__getitem__, numbers[at : at + HELD].tolist())) for at in range(0, len(numbers), HELD)])


def _encode(shipped):
    def run(batches):
        codec = Codec.of(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [codec.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _decode(shipped):
    def run(batches):
        codec = Codec.of(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [None if x is None else codec.decode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(data, pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


def bpe_encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode whole texts of ``docs`` (doc_id, text) by the rank file at ``path``: rows (doc_id, ids).

    ``ids`` are little-endian unsigned 32-bit numbers, without special tokens. A null or empty text has none; any
    length is encoded whole; repeated rows are encoded each; a null doc_id stays null; an empty table gives an empty
    result; other columns are ignored. One narrow pass; a task holds a batch, and one text's ids.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path, pattern))
    return pick(docs, "doc_id", "text").mapInArrow(_encode(shipped), ENCODED)


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Bytes of the ids of ``encoded`` (doc_id, ids as bpe_encode gives them): rows (doc_id, ids, decoded).

    Null ids stay null, empty ones decode to no bytes. An id that the vocabulary lacks fails.
    """
    shipped = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(path, pattern))
    return pick(encoded, "doc_id", "ids").mapInArrow(_decode(shipped), ENCODED + ", decoded binary")


def bpe_digest(decoded: DataFrame) -> DataFrame:
    """Counts and digests of decoded rows."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
