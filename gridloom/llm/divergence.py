"""Source divergence: how far the sources of a language lie apart in their words, counted exactly behind a sketch.

1. A first pass adds every document's distinct terms to a count-min sketch of document frequencies, one a task. Sketches
   are merged block of cells by block, in a tree. Cells saturate at the least frequency asked for, since more is not
   needed, and what is left of a cell is one bit: whether it got there. A count-min estimate never falls short, so a
   term with a cell that did not get there is impossible.
2. A second pass counts the terms that are possible, exactly, per task first; only these are shuffled. Terms that are
   frequent enough in their language are kept.
3. Shares are whole numbers: 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)). Sources are compared pair by pair
   only on terms that both have. A term that one source has, or none, costs what depends on counts alone, so these are
   added up from each source's histogram of counts.

Terms are strings throughout, never hashes; a hash chooses a term's cells only.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import give_back, maybe_broadcast, pick, stored
from gridloom.llm.words import class_table, join_hash, slices

#: [^\x00-\x40\x5B-\x60\x7B-\x7F]+ of lower-cased text: letters a-z and everything beyond ASCII.
LETTERS = class_table([*range(0x00, 0x61), *range(0x7B, 0x80)])
#: A kept term is in so many documents of its language.
LEAST_DOCS = 30
SCALE, PRIOR = 1_000_000_000, 5
#: Rows of the sketch; cells of a row are a power of two between these, some for each document. The bits of all cells
#: are at most DEPTH * 2**MOST_BITS / 8 bytes, 8 MB, which the driver holds and every task gets.
DEPTH, LEAST_BITS, MOST_BITS, CELLS_PER_DOC = 4, 16, 24, 16
#: Cells that travel and are merged together, and sketches that are merged at a time.
BLOCK, FAN_IN = 1 << 16, 64
#: Bytes of text that are worked on at a time, and rows of counts that a task holds before it sends their sums.
SLICE = 1 << 19
HELD_ROWS = 1 << 18
COUNTS = "lang string, source string, term string, docs long, n long"
TOP_TERMS = 50


class Terms:
    """The terms of a slice: exact strings, each place's number in ``names``, and its row."""

    def __init__(self, part):
        w = part.words(LETTERS)
        self.doc, size = w.doc, w.end - w.start
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        # The bytes inside words, one after the other.
        data = part.low[LETTERS[part.low]]
        places = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        coded = places.dictionary_encode()
        self.names, self.code = coded.dictionary, coded.indices.to_numpy()
        # The hash of each name is that of its first place.
        first = np.zeros(len(self.names), np.int64)
        first[self.code[::-1]] = np.arange(len(self.code))[::-1]
        self.hash = w.hash[first]


def _groups(*columns) -> tuple[np.ndarray, pa.Table]:
    """Rows' group numbers and the groups' values."""
    codes, names = np.zeros(len(columns[0]), np.int64), []
    for c in columns:
        d = c.dictionary_encode()
        codes, _ = codes * max(len(d.dictionary), 1) + d.indices.to_numpy(), names.append(d)
    _, first, code = np.unique(codes, return_index=True, return_inverse=True)
    return code, [c.take(pa.array(first)) for c in columns]


def cells(lang: np.ndarray, term: np.ndarray, bits: int) -> np.ndarray:
    """A cell in each of DEPTH rows, from the hashes of languages and terms: DEPTH x n numbers of all cells."""
    out = [join_hash([lang, term, np.full(len(term), k, np.uint64)]) >> np.uint64(64 - bits) for k in range(DEPTH)]
    return np.stack(out).astype(np.int64) + (np.arange(DEPTH, dtype=np.int64) << bits)[:, None]


def _text_hash(values: pa.Array) -> np.ndarray:
    """Hashes of few short strings, the same in every worker."""
    return np.array([zlib.crc32(b := v.encode()) << 32 | zlib.adler32(b) for v in values.to_pylist()], np.uint64)


def _sketch(bits: int, least: int):
    """(lang, text) -> this task's cells that are not zero, block by block; counts stop at ``least``."""

    def run(batches):
        sketch = np.zeros(DEPTH << bits, np.uint8)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                t = Terms(part)
                if not len(t.code):
                    continue
                group, (lang,) = _groups(part.batch.column(0))
                pair = np.unique(t.doc * len(t.names) + t.code)  # a document's distinct terms
                kind, docs = np.unique(group[pair // len(t.names)] * len(t.names) + pair % len(t.names), return_counts=True)
                at = cells(_text_hash(lang)[kind // len(t.names)], t.hash[kind % len(t.names)], bits)
                for row in at:
                    where, place = np.unique(row, return_inverse=True)
                    more = np.bincount(place, docs).astype(np.int64)
                    sketch[where] = np.minimum(sketch[where] + more, least)
        number, blocks = TaskContext.get().partitionId(), sketch.reshape(-1, min(BLOCK, 1 << bits))
        for k in np.flatnonzero(blocks.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([number], pa.int32()), pa.array([blocks[k].tobytes()], pa.binary())], names=["block", "part", "cells"])
        give_back()

    return run


def _added(least: int):
    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table.column("cells")[0].as_py()), np.int64)
        for x in table.column("cells"):
            total += np.frombuffer(x.as_py(), np.uint8)
        out = pa.table({"block": table.column("block")[:1], "part": table.column("part")[:1], "cells": pa.array([np.minimum(total, least).astype(np.uint8).tobytes()], pa.binary())})
        give_back()
        return out

    return run


def possible_cells(docs: DataFrame, least: int, bits: int, tasks: int) -> np.ndarray:
    """One bit a cell: whether the merged sketch of all documents (lang, text), made by some ``tasks``, reached ``least`` there."""
    parts = docs.select("lang", "text").mapInArrow(_sketch(bits, least), "block int, part int, cells binary")
    while tasks > FAN_IN:
        parts = parts.withColumn("part", (F.col("part") / FAN_IN).cast("int")).groupBy("block", "part").applyInArrow(_added(least), "block int, part int, cells binary")
        tasks = -(-tasks // FAN_IN)
    parts = parts.groupBy("block").applyInArrow(_added(least), "block int, part int, cells binary")
    out = np.zeros((DEPTH << bits) // 8, np.uint8)
    size = min(BLOCK, 1 << bits) // 8
    reached = parts.select("block", "cells").mapInArrow(_reached(least), "block int, bits binary")
    for r in reached.collect():  # one bit a cell, MOST_BITS bound it
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def _reached(least: int):
    def run(batches):
        for batch in batches:
            packed = [np.packbits(np.frombuffer(x.as_py(), np.uint8) >= least).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["block", "bits"])

    return run


def _sums(held: list) -> list[pa.RecordBatch]:
    t = pa.Table.from_batches(held).group_by(["lang", "source", "term"]).aggregate([("docs", "sum"), ("n", "sum")])
    return t.select(["lang", "source", "term", "docs_sum", "n_sum"]).rename_columns(["lang", "source", "term", "docs", "n"]).combine_chunks().to_batches()


def _count(shipped, bits: int):
    """(lang, source, text) -> this task's documents and occurrences of the terms that are possible."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                t = Terms(part)
                if not len(t.code):
                    continue
                langs, (lang,) = _groups(part.batch.column(0))
                group, (l, s) = _groups(part.batch.column(0), part.batch.column(1))
                number = len(t.names)
                kind, place = np.unique(langs[t.doc] * number + t.code, return_inverse=True)
                at = cells(_text_hash(lang)[kind // number], t.hash[kind % number], bits)
                may = (shipped.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(0)
                some = np.flatnonzero(may[place])
                doc, code = t.doc[some], t.code[some]
                kind, n = np.unique(group[doc] * number + code, return_counts=True)
                pair = np.unique(doc * number + code)
                docs = np.bincount(np.searchsorted(kind, group[pair // number] * number + pair % number), minlength=len(kind))
                g, name = pa.array(kind // number), t.names.take(pa.array(kind % number)).cast(pa.string())
                held.append(pa.RecordBatch.from_arrays([l.take(g), s.take(g), name, pa.array(docs.astype(np.int64)), pa.array(n)], names=["lang", "source", "term", "docs", "n"]))
                size += len(kind)
                if size > HELD_ROWS:
                    held = _sums(held)
                    size = sum(b.num_rows for b in held)
                    if size > HELD_ROWS // 2:
                        yield from held
                        held, size = [], 0
                    give_back()
        if held:
            yield from _sums(held)
        give_back()

    return run


def source_terms(docs: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(counts, groups) of ``docs`` (text, lang, source; nulls read as empty).

    counts: (lang, source, term, n) of the terms in at least ``least`` documents of their language, n occurrences in
    the source. groups: every (lang, source) that occurs.
    """
    d = pick(docs, "lang", "source", "text").fillna("")
    groups = stored(d.select("lang", "source", F.spark_partition_id().alias("task")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"), F.max("task").alias("task")))
    rows, last = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("task"), F.lit(0))).first()
    bits = max(LEAST_BITS, min(MOST_BITS, (rows * CELLS_PER_DOC).bit_length()))
    shipped = d.sparkSession.sparkContext.broadcast(possible_cells(d, least, bits, last + 1))
    counts = stored(d.mapInArrow(_count(shipped, bits), COUNTS).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term")
    return counts.join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), groups.select("lang", "source")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exactly; 1 where there are no terms."""
    wide = lambda c: c.cast("decimal(27,0)")
    n, total, terms = (c.cast("long") for c in (n, total, terms))
    scaled, whole = wide(n + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + PRIOR * terms)
    return F.coalesce(F.call_function("div", scaled, F.nullif(whole, F.lit(0).cast("decimal(27,0)"))), F.lit(0).cast("long")) + 1


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """How far every (lang, source) group of ``docs`` (text, lang, source) lies from the others, and by which terms.

    Rows (lang, source, part, item, value, rank). Part ``pair``: item is another source of the language, value the sum
    of differences of their shares over all kept terms. Part ``term``: item is a term of the group with a larger share
    there than in the language, value the difference; the ``top`` largest. Rank 1 is the largest value, ties by item.

    Null text, lang and source read as ''. A group without terms has equal shares for all; a language without kept
    terms has pairs of value 0. Repeated rows count each; an empty table gives an empty result; other columns are
    ignored. Pairs of sources are the result's own size; what is joined for them is a language's sources on one term.
    """
    counts, groups = source_terms(docs, least)
    counts = stored(counts)
    by_lang = counts.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("all_n"))
    by_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    zero = F.lit(0).cast("long")
    # v: kept terms of the language; p0: the share of a term that the group lacks.
    of = stored(
        groups.join(by_lang, "lang", "left").join(by_group, ["lang", "source"], "left").select("lang", "source", F.coalesce("v", zero).alias("v"), F.coalesce("all_n", zero).alias("all_n"), F.coalesce("group_n", zero).alias("group_n"))
        .withColumn("p0", share(zero, F.col("group_n"), F.col("v")))
    )
    have = counts.join(maybe_broadcast(of, 128), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("group_n"), F.col("v")))
    # Groups of one language, in both orders.
    a, b = of.alias("a"), of.alias("b")
    pairs = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source")))
    pairs = pairs.select(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.col("a.v").alias("v"), F.col("a.p0").alias("p0"), F.col("b.p0").alias("q0"))
    base = pairs.select("lang", "source", "item", (F.col("v") * F.abs(F.col("p0") - F.col("q0"))).alias("value"))
    # What a group's terms cost beyond that where the other lacks them: by how often the group has them.
    often = have.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    alone = pairs.join(often, ["lang", "source"]).select("lang", "source", "item", (F.col("terms") * (F.abs(F.col("p") - F.col("q0")) - F.abs(F.col("p0") - F.col("q0")))).alias("value"))
    # And where both have them: once, for the smaller source.
    x, y = have.alias("x"), have.alias("y")
    both = x.join(y, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.term") == F.col("y.term")) & (F.col("x.source") < F.col("y.source")))
    gap = lambda i, j: F.abs(F.col(i) - F.col(j))
    common = both.groupBy(F.col("x.lang").alias("lang"), F.col("x.source").alias("source"), F.col("y.source").alias("item")).agg(F.sum(gap("x.p", "y.p") - gap("x.p", "y.p0") - gap("x.p0", "y.p") + gap("x.p0", "y.p0")).alias("value"))
    turned = lambda d: d.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    summed = base.unionByName(alone).unionByName(turned(alone)).unionByName(common).unionByName(turned(common)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    ahead = have.join(of_lang, ["lang", "term"]).withColumn("q", share(F.col("lang_n"), F.col("all_n"), F.col("v"))).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), order.alias("rank"))
    return ranked(summed, "pair").unionByName(ranked(ahead, "term").where(F.col("rank") <= top))
