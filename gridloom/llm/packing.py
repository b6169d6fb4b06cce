"""Sequence packing by non-negative least squares over a length histogram.

1. One pass tokenises every text and stores its ids (two bytes each) with running counts of its own task, so
   that every later rank and offset is a prefix sum over tasks instead of a global sort.
2. A document's whole windows stand alone. What remains of it, 1 to window-1 tokens, falls into a length
   class of window/64 tokens. Shallow combinations of up to four classes whose smallest members fill a window
   are enumerated, and non-negative least squares solves how often each is used to reproduce the histogram
   (64 numbers, whatever the input's size). Counts are rounded, and limited by what the classes hold.
3. Members are dealt to combinations by their rank in their class. A combination's total is at least a
   window; its longest member stands last and is cut there.
4. Residuals (what no combination takes, and cut ends) are packed greedily in the order of the corpus, cut
   at window borders. The one window that this leaves incomplete is split at powers of two.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import give_back, pick, stored, worker_cache

CLASSES = 64
DEPTH = 4
CACHE_WORDS = 200_000

# Characters for which the vocabulary's normaliser is str.lower() plus white space, and for which letters,
# digits and the rest are told apart by the plain pattern below. Other texts go through the tokenizer itself.
UNSAFE = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ¡¿«»“”‘’–—…€]")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


class Encoder(dict):
    """word -> its ids as little-endian 16-bit bytes, by the tokenizer, remembered for CACHE_WORDS words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # Texts with one of the vocabulary's added tokens in them go through the tokenizer itself.
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Byte-level vocabularies spell a byte that does not print as the next free character from 256 on.
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.spelling = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids must fit in 16 bits")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            # What came first is what comes often.
            for old in list(itertools.islice(self, CACHE_WORDS // 4, None)):
                del self[old]
        # One piece of the pattern is one input of the model, with its bytes as the vocabulary spells them.
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.spelling)
        out = self[word] = np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], "<u2").tobytes()
        return out

    def text(self, text: str) -> bytes:
        low = text.lower()
        if UNSAFE.search(text) or not unicodedata.is_normalized("NFC", text) or any(t in low for t in self.added):
            return self.whole(text)
        return b"".join(map(self.__getitem__, PIECES.findall(low)))


def _tokenise(path: str, end_id: int, window: int):
    unit = window // CLASSES

    def run(batches):
        cache = worker_cache()
        if path not in cache:
            cache[path] = Encoder(path)
        encode = cache[path].text
        task = TaskContext.get().partitionId()
        end = np.array([end_id], "<u2").tobytes()
        pos = whole = 0
        ranks = [0] * CLASSES
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encode(t or "") + end for t in part.column(1).to_pylist()]
                n = [len(x) // 2 for x in ids]
                kind, rank, before = [], [], []
                for x in n:
                    before.append(whole)
                    whole += x // window
                    k = (x % window - 1) // unit if x % window else None
                    kind.append(k)
                    rank.append(ranks[k] if k is not None else None)
                    if k is not None:
                        ranks[k] += 1
                m = len(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([task] * m, pa.int32()), pa.array(range(pos, pos + m), pa.int64()), pa.array(n, pa.int64()), pa.array(before, pa.int64()), pa.array(kind, pa.int32()), pa.array(rank, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "task", "pos", "n", "whole_before", "kind", "rank", "ids"],
                )
                pos += m
        give_back()

    return run


def combinations(units: int = CLASSES, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Ascending tuples of at most ``depth`` positive numbers that sum to ``units``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, least: int) -> None:
        if head and least <= left < units and len(head) < depth:
            out.append((*head, left))
        if len(head) < depth - 1:
            for x in range(least, left // 2 + 1):
                grow((*head, x), left - x, x)

    grow((), units, 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lawson and Hanson's active set method: x >= 0 with least |a x - b|."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(6 * a.shape[0]):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tolerance:
            break
        active[j] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (s[active] > 0).all():
                break
            low = active & (s <= 0)
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = np.maximum(x + step * (s - x), 0)
            active &= x > tolerance * 1e-3
            if not active.any():
                break
        x = s if active.any() else x
    return np.maximum(x, 0)


def plan(histogram: np.ndarray) -> tuple[list[tuple], int]:
    """Rows (kind, from_rank, to_rank, copies, sequence, slot) that deal class members to sequences; their number.

    Members of ``kind`` whose rank is in [from_rank, to_rank) belong to the same combination, ``copies`` to
    each of its sequences, which begin at number ``sequence``; ``slot`` is the place of the first copy.
    """
    usable = [c for c in combinations() if all(histogram[k] for k in c)]
    if not usable:
        return [], 0
    a = np.zeros((CLASSES, len(usable)))
    for j, c in enumerate(usable):
        for k in c:
            a[k, j] += 1
    x = nnls(a, histogram.astype(float))
    left, taken, rows, sequence = histogram.astype(np.int64).copy(), np.zeros(CLASSES, np.int64), [], 0
    for j in np.argsort(-x, kind="stable"):
        need = a[:, j].astype(np.int64)
        count = min(int(x[j] + 0.5), *(int(left[k] // need[k]) for k in np.flatnonzero(need)))
        if count <= 0:
            continue
        slot = 0
        for k in np.flatnonzero(need):
            rows.append((int(k), int(taken[k]), int(taken[k] + count * need[k]), int(need[k]), sequence, slot))
            slot += int(need[k])
        taken += count * need
        left -= count * need
        sequence += count
    return rows, sequence


def _checksums(batches):
    """(doc_id, n, ids, pieces) -> a row for each piece with the checksum of its ids."""
    for batch in batches:
        doc, n, ids, pieces = (batch.column(i) for i in range(4))
        flat = pieces.flatten()
        parents = np.repeat(np.arange(batch.num_rows), np.diff(pieces.offsets.to_numpy()) if batch.num_rows else [])
        start, length, sequence, offset = (flat.field(k) for k in range(4))
        crc = np.zeros(len(flat), np.int64)
        before, wide = -1, None
        for i, (p, s, m) in enumerate(zip(parents.tolist(), start.to_pylist(), length.to_pylist())):
            if p != before:
                before, wide = p, np.frombuffer(ids[p].as_buffer(), "<u2").astype("<u4")
            crc[i] = zlib.crc32(wide[s : s + m].tobytes())
        take = pa.array(parents)
        yield pa.RecordBatch.from_arrays([doc.take(take), start, length, pa.array(crc), n.take(take), sequence, offset], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``window`` tokens.

    A document is its ids followed by ``end_id``; a text's ids are what the tokenizer gives without special
    tokens added, so an added token spelled out in a text is its own id. Returns one row per piece: doc_id, start (its document's ids
    before it), length, ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset.
    Each id lies in exactly one piece and a sequence's pieces follow each other without gaps. Every sequence
    is full except those, at most log2(window), that end the corpus; their lengths are powers of two.

    A null or empty text is one token, ``end_id``. Repeated rows are packed each on its own; a null doc_id
    stays null; an empty table gives an empty result; other columns are ignored.
    """
    if window % CLASSES or window & (window - 1):
        raise ValueError(f"the window must be a power of two of at least {CLASSES}")
    spark = docs.sparkSession
    unit = window // CLASSES
    kept = stored(pick(docs, "doc_id", "text").mapInArrow(_tokenise(tokenizer_path, end_id, window), "doc_id long, task int, pos long, n long, whole_before long, kind int, rank long, ids binary"))
    light = kept.select("doc_id", "task", "pos", "n", "whole_before", "kind", "rank")
    rest = F.pmod(F.col("n"), F.lit(window))

    # Prefix sums over tasks: a row for each task, or for each task and class.
    by_task = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    wholes = light.groupBy("task").agg(F.sum(F.floor(F.col("n") / window)).alias("w"))
    whole_base = wholes.select("task", F.coalesce(F.sum("w").over(by_task), F.lit(0)).alias("whole_base"))
    per_class = light.where(F.col("kind").isNotNull()).groupBy("task", "kind").agg(F.count(F.lit(1)).alias("c"))
    class_base = per_class.select("task", "kind", F.coalesce(F.sum("c").over(Window.partitionBy("kind").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("class_base"))
    histogram = np.zeros(CLASSES, np.int64)
    for kind, c in per_class.groupBy("kind").agg(F.sum("c")).collect():  # at most CLASSES rows
        histogram[kind] = c
    n_whole = wholes.agg(F.sum("w")).first()[0] or 0
    dealt, n_dealt = plan(histogram)

    whole = light.where(F.col("n") >= window).join(whole_base, "task").select(
        "task", "pos", F.posexplode(F.sequence(F.lit(0), F.floor(F.col("n") / window) - 1)).alias("k", "x"), "whole_base", "whole_before"
    ).select("task", "pos", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), (F.col("whole_base") + F.col("whole_before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    items = light.where(F.col("kind").isNotNull()).join(class_base, ["task", "kind"]).select(
        "task", "pos", "kind", (F.col("n") - rest).alias("start"), rest.alias("length"), (F.col("class_base") + F.col("rank")).alias("rank")
    )
    table = spark.createDataFrame(dealt, "kind int, low long, high long, copies long, sequence long, slot long")
    items = items.join(F.broadcast(table), (items.kind == table.kind) & items.rank.between(table.low, table.high - 1), "left").select(
        "task", "pos", "start", "length",
        (F.lit(n_whole) + F.col("sequence") + F.floor((F.col("rank") - F.col("low")) / F.col("copies"))).alias("sequence_id"),
        (F.col("slot") + F.pmod(F.col("rank") - F.col("low"), F.col("copies"))).alias("slot"),
    )
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = items.where(F.col("sequence_id").isNotNull()).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    placed = stored(placed.select("task", "pos", "start", "length", "sequence_id", "offset", F.least("length", F.lit(window) - F.col("offset")).alias("fits")))
    combined = placed.select("task", "pos", "start", F.col("fits").alias("length"), "sequence_id", "offset")
    residual = items.where(F.col("sequence_id").isNull()).select("task", "pos", "start", "length").unionByName(
        placed.where(F.col("fits") < F.col("length")).select("task", "pos", (F.col("start") + F.col("fits")).alias("start"), (F.col("length") - F.col("fits")).alias("length"))
    )
    run = Window.partitionBy("task").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    residual = stored(residual.withColumn("before", F.coalesce(F.sum("length").over(run), F.lit(0))))
    sums = residual.groupBy("task").agg(F.sum("length").alias("s"))
    bases = sums.select("task", F.coalesce(F.sum("s").over(by_task), F.lit(0)).alias("base"))
    total = sums.agg(F.sum("s")).first()[0] or 0
    full, left = divmod(total, window)
    borders, at = [], full * window
    for bit in reversed(range(window.bit_length())):
        if left >> bit & 1:
            borders.append((at, at + (1 << bit), full + len(borders)))
            at += 1 << bit
    segment = lambda a, b, i: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), i.cast("long").alias("i"))
    row = residual.join(bases, "task").select("task", "pos", "start", "length", (F.col("base") + F.col("before")).alias("at"))
    to = F.col("at") + F.col("length")
    windows = F.transform(F.sequence(F.floor(F.col("at") / window), F.floor((to - 1) / window)), lambda i: segment(i * window, (i + 1) * window, i))
    ends = F.array(*[segment(F.lit(a), F.lit(b), F.lit(i)) for a, b, i in borders]) if borders else F.expr("cast(array() as array<struct<a:bigint,b:bigint,i:bigint>>)")
    cut = F.concat(F.filter(windows, lambda s: s.i < full), F.filter(ends, lambda s: (s.a < to) & (s.b > F.col("at"))))
    greedy = row.select("task", "pos", "start", "at", to.alias("to"), F.explode(cut).alias("s")).select(
        "task", "pos", (F.col("start") + F.greatest("s.a", "at") - F.col("at")).alias("start"), (F.least("s.b", "to") - F.greatest("s.a", "at")).alias("length"),
        (F.lit(n_whole + n_dealt) + F.col("s.i")).alias("sequence_id"), (F.greatest("s.a", "at") - F.col("s.a")).alias("offset"),
    )
    pieces = whole.unionByName(combined).unionByName(greedy).groupBy("task", "pos").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    joined = kept.select("task", "pos", "doc_id", "n", "ids").join(pieces, ["task", "pos"])
    return joined.select("doc_id", "n", "ids", "pieces").mapInArrow(_checksums, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
