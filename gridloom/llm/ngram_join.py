"""N-gram Jaccard join by PartEnum signatures.

Two sets with Jaccard similarity of at least ``t`` differ in at most (1-t)/(1+t) * (|r|+|s|) elements. Sizes
are cut into bands; in a band the bound is a number k. The feature domain is hashed into n1 parts, each of
them into n2 smaller ones. Of n1 parts one holds at most k2 = (k+1)/n1 - 1 (rounded up) of the differences,
so some choice of n2 - k2 of its smaller parts is identical in both sets: each set emits a signature for
every such choice, and similar sets share at least one. A set that may pair with the next band's sizes emits
that band's signatures too. n1 and n2 are chosen for each band so that a signature rests on enough elements.

Where no choice of n1 and n2 gives enough elements, as at low thresholds, empty parts would be shared by sets
that have nothing in common. There a set of a elements, which differs from any partner in at most
a * (1-t)/t of them, counts its choices of two elements or more: each difference spoils a known number of
choices, so if there are more than can be spoilt, one of them is identical in both sets, and the set emits
those alone. A set with too few of them emits all that are not empty, and if these are too few as well, all.

A signature's sharers are a bucket. Its smallest set is held against every other one: by size, and by a sketch
of both, counts of elements in a few parts of the domain. The counts' differences are a lower bound of the
elements that two sets do not share, so what this refuses is not similar. A bucket of three or more in which a
pair was refused is searched through, again by sizes and sketches, and in blocks if it is large; all that is kept
of it is enough pairs to connect what could be similar. Groups of sets connected so are compared by their
elements: pairs that share a signature, and are not joined by a chain of links already, are counted exactly. A
group's elements are moved once, in blocks; blocks meet only where the first pass left sets unlinked, and those
in which all are linked to each other do not meet again. Links alone make the components.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import column_of, components, give_back, maybe_broadcast, numbered, pick, skew_safe_join, stored
from gridloom.llm.words import SPACED, join_hash, mix, slices

#: Bands widen by this factor: wider bands make more signatures a set, narrower ones more sets of two bands.
BAND_STEPS = 3
#: A signature rests on so many elements on average, where the band's sizes allow it.
LEAST_ELEMENTS = 8
#: Elements of the sets in one block of a large group, and sets in one block of a large bucket.
BLOCK_ELEMENTS, BLOCK_SETS = 50_000, 2_000
#: A sketch counts the elements of at least so many parts, and of one part for every SKETCH_SHARE elements.
SKETCH_PARTS, SKETCH_SHARE = 64, 8
#: Sets that a task remembers in order to send the signatures of equal ones once.
SEEN_SETS = 1 << 20
#: What names a class of equal sets.
SET_COLUMNS = ("set_a", "set_b", "n_shingles")


class Bands:
    """Size bands and their PartEnum parameters (k, n1, n2, k2) for a threshold given as a fraction."""

    def __init__(self, threshold: Fraction):
        self.t = threshold
        self.ratio = float(1 / threshold) ** BAND_STEPS
        self._first: list[int] = [1]
        self._params: dict[int, tuple[int, int, int, bool]] = {}

    def first(self, band: int) -> int:
        """The smallest size in a band."""
        while len(self._first) <= band:
            self._first.append(max(self._first[-1] + 1, math.ceil(self._first[-1] * self.ratio)))
        return self._first[band]

    def of(self, size: int) -> list[int]:
        """The band of a size, and the next one if a set of that band may be similar enough."""
        self.first(1)
        while self._first[-1] <= size:
            self.first(len(self._first))
        band = int(np.searchsorted(self._first, size, side="right")) - 1
        return [band, band + 1] if size >= self.t * self.first(band + 1) else [band]

    def load(self) -> float:
        """The most elements a part may hold on average if parts of two or more are to outnumber the differences."""
        fits = [x / 10 for x in range(10, 80) if 1 - math.exp(-x / 10) * (1 + x / 10) > 1.03 * x / 10 * float((1 - self.t) / self.t)]
        return max(fits, default=1.0)

    def params(self, band: int) -> tuple[int, int, int, bool]:
        """(n1, n2, k2) of a band, and whether its sets leave out choices of few elements."""
        if band not in self._params:
            most, least = self.first(band + 1) - 1, math.ceil(self.first(band) * self.t)
            k = math.floor(2 * most * (1 - self.t) / (1 + self.t))
            best = None
            for k2, n2 in ((0, 1), (1, 2), (1, 3), (2, 4), (2, 5), (3, 6)):
                n1 = math.ceil((k + 1) / (k2 + 1))
                signatures = n1 * math.comb(n2, n2 - k2)
                elements = least / n1 * (n2 - k2) / n2
                cost = (max(0.0, min(LEAST_ELEMENTS, least / 2) - elements), signatures)
                if best is None or cost < best[0]:
                    best = (cost, (n1, n2, k2, False))
            if best[0][0] > LEAST_ELEMENTS / 2:
                spoilt = math.floor(most * (1 - self.t) / self.t)
                best = (best[0], (math.ceil(max(most / self.load(), spoilt + 1) / 2), 2, 1, True))
            self._params[band] = best[1]
        return self._params[band]


def choices(n2: int, keep: int) -> list[int]:
    """Bit masks of the ``keep``-element subsets of n2 parts."""
    return [m for m in range(1 << n2) if m.bit_count() == keep]


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """PartEnum signatures of a set given as distinct 64-bit hashes."""
    out = []
    with np.errstate(over="ignore"):
        for band in bands.of(len(elements)):
            n1, n2, k2, sparse = bands.params(band)
            spread = mix(elements + np.uint64(0x51ED27 + band))
            part = ((spread >> np.uint64(32)) * np.uint64(n1 * n2)) >> np.uint64(32)
            sums = np.zeros(n1 * n2, np.uint64)
            np.add.at(sums, part.astype(np.int64), mix(elements))
            counts = np.bincount(part.astype(np.int64), minlength=n1 * n2).astype(np.uint64)
            cells = mix(sums + counts * np.uint64(0x9E3779B97F4A7C15)).reshape(n1, n2)
            base = np.arange(n1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(band + 1)
            masks = choices(n2, n2 - k2)
            least = _least(counts.reshape(n1, n2), masks, math.floor(len(elements) * (1 - bands.t) / bands.t)) if sparse else 0
            for m in masks:
                h = base + np.uint64(m << 40)
                for j in range(n2):
                    if m >> j & 1:
                        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + cells[:, j])
                h = mix(h)
                if least:
                    h = h[sum(counts.reshape(n1, n2)[:, j] for j in range(n2) if m >> j & 1) >= least]
                out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _least(counts: np.ndarray, masks: list[int], differences: int) -> int:
    """The elements, at most two, below which a choice may be left out: what is kept outnumbers what can be spoilt."""
    n2 = counts.shape[1]
    held = np.stack([sum(counts[:, j] for j in range(n2) if m >> j & 1) for m in masks])
    spoils = sum(m & 1 for m in masks)  # the choices that one part is in
    return next((c for c in (2, 1) if (held >= c).sum() > differences * spoils), 0)


def sets_of(part, n: int):
    """For each text of a slice its distinct shingle hashes, sorted: (values, first, count)."""
    w = part.words(SPACED)
    h = w.hash
    at = w.run(n)
    values, doc = join_hash([h[at + k] for k in range(n)]), w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            own = h[w.first[d] : w.first[d] + w.count[d]]
            extra[i] = join_hash([own[k : k + 1] for k in range(len(own))])[0] ^ np.uint64(len(own))
        values, doc = np.concatenate([values, extra]), np.concatenate([doc, short])
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[fresh], doc[fresh]
    count = np.bincount(doc, minlength=part.rows)
    return values, np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64) if part.rows else count, count


def _set_hashes(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[pa.Array]:
    """Two independent 64-bit hashes of each set."""
    out = []
    with np.errstate(over="ignore"):
        for salt in (1, 0x5DEECE66D):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(salt)), dtype=np.uint64)])
            out.append(pa.array((total[first + count] - total[first]).view(np.int64)))
    return out


def sketch(elements: np.ndarray) -> np.ndarray:
    """Counts, modulo 256, of a set's elements in parts of the domain; a power of two of them."""
    parts = max(SKETCH_PARTS, 1 << int(len(elements) // SKETCH_SHARE).bit_length())
    with np.errstate(over="ignore"):
        at = mix(elements ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - parts.bit_length() + 1)
    return np.bincount(at.astype(np.int64), minlength=parts).astype(np.uint8)


def folded(counts: np.ndarray, parts: int) -> np.ndarray:
    """A sketch brought to fewer parts."""
    while len(counts) > parts:
        counts = counts[0::2] + counts[1::2]
    return counts


def may_link(counts: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Which of ``others`` (rows of sketches of as many parts) can be similar enough by size and sketch."""
    up, down = threshold.numerator, threshold.denominator
    fits = up * np.maximum(sizes, size) <= down * np.minimum(sizes, size)
    at = np.flatnonzero(fits)
    # Differences modulo 256 are at most the true ones.
    apart = np.abs((others[at] - counts).view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
    fits[at] = apart * (down + up) <= (sizes[at] + size) * (down - up)
    return fits


def _digest(n: int, bands: Bands):
    """(doc_id, text, others) -> doc_id, others, n_shingles, two hashes of the set, the row's number, the set's signatures and sketch.

    A set that the task has seen has none of its own.
    """

    def run(batches):
        number, seen = TaskContext.get().partitionId() << 33, set()
        for batch in batches:
            for part in slices(batch):
                values, first, count = sets_of(part, n)
                hashes = _set_hashes(values, first, count)
                found, sketches = [], []
                for f, c, key in zip(first, count, zip(hashes[0].to_pylist(), hashes[1].to_pylist(), count.tolist())):
                    if not c or key in seen:
                        found.append(np.zeros(0, np.uint64))
                        sketches.append(None)
                        continue
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(key)
                    found.append(signatures(values[f : f + c], bands))
                    sketches.append(sketch(values[f : f + c]).tobytes())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = pa.array(np.concatenate(found).view(np.int64))
                nodes = pa.array(np.arange(number, number + part.rows))
                number += part.rows
                columns = [pa.array(count.astype(np.int64)), *hashes, nodes, pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.batch.column(0), *part.batch.columns[2:], *columns], names=["doc_id", *part.batch.schema.names[2:], "n_shingles", "set_a", "set_b", "node", "signatures", "sketch"])
        give_back()

    return run


def _content(n: int):
    """(doc_id, text) -> n_shingles, two hashes of the set, its elements as bytes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                values, first, count = sets_of(part, n)
                yield pa.RecordBatch.from_arrays([pa.array(count.astype(np.int64)), *_set_hashes(values, first, count), pa.array([values[f : f + c].tobytes() for f, c in zip(first, count)], pa.binary())], names=["n_shingles", "set_a", "set_b", "elements"])

    return run


def _judged(threshold: Fraction):
    """(u, v, sizes and sketches of both) -> u, v, whether they can be similar."""

    def run(batches):
        for batch in batches:
            ok = []
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                parts = min(len(x), len(y))
                ok.append(bool(may_link(folded(x, parts), a, folded(y, parts)[None, :], np.array([b]), threshold)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["u", "v", "ok"])

    return run


def connected(nodes: np.ndarray, sizes: np.ndarray, sketches: list[bytes], side: np.ndarray, threshold: Fraction) -> list[tuple]:
    """Pairs that connect all sets that can be similar; with two sides, only pairs of both."""
    counts = [np.frombuffer(x, np.uint8) for x in sketches]
    parts = min(len(c) for c in counts)
    table = np.stack([folded(c, parts) for c in counts])
    two, left, out = bool(side.any()), np.arange(len(nodes)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            met = may_link(table[i], int(sizes[i]), table[left], sizes[left], threshold)
            if two:
                met &= side[left] != side[i]
            out += [(nodes[i], nodes[j]) for j in left[met]]
            queue += left[met].tolist()
            left = left[~met]
    return out


def _searched(threshold: Fraction):
    """Rows (s, low, high, block, node, size, sketch), those of one bucket and pair of blocks together -> u, v."""

    def found(rows):
        block = np.array([r[1] for r in rows])
        pairs = connected(np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), [r[4] for r in rows], (block != block[0]).astype(int), threshold)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

    def run(batches):
        held = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for s, low, high, *rest in zip(*columns):
                if held and held[0][0] != (s, low, high):
                    yield found(held)
                    held = []
                held.append(((s, low, high), *rest))
        if held:
            yield found(held)

    return run


def linked(nodes: list, sets: list, side: list, threshold: Fraction) -> list[tuple]:
    """A spanning forest of the links between sets that share a signature.

    ``side``: 0 and 1 where two different blocks meet (pairs inside one block are another task's work), else 0.
    """
    up, down = threshold.numerator, threshold.denominator
    bands, side = Bands(threshold), np.array(side)
    size = np.array([len(s) for s in sets], np.int64)
    if not size.sum():
        return []
    owner = np.repeat(np.arange(len(sets)), size)
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    counts = [sketch(s) for s in sets]
    parts = min(len(c) for c in counts)
    table = np.stack([folded(c, parts) for c in counts])
    # Postings: the sets of each signature, in their order.
    signed = [signatures(s, bands) for s in sets]
    posted, key = np.repeat(np.arange(len(sets)), [len(x) for x in signed]), np.concatenate(signed)
    order = np.lexsort((posted, key))
    posted, key = posted[order], key[order]
    start = np.searchsorted(key, key)
    entries = np.argsort(posted, kind="stable")
    ends = np.cumsum(np.bincount(posted, minlength=len(sets)))
    component, held, out = np.arange(len(sets)), np.zeros(len(element), bool), []
    for i in range(len(sets)):
        own = entries[ends[i - 1] if i else 0 : ends[i]]
        met = [posted[a:b] for a, b in zip(start[own], own) if b > a]
        if not met:
            continue
        met = np.unique(np.concatenate(met))
        met = met[component[met] != component[i]]
        if side.any():
            met = met[side[met] != side[i]]
        met = met[may_link(table[i], int(size[i]), table[met], size[met], threshold)]
        if not len(met):
            continue
        mine = element[first[i] : first[i] + size[i]]
        held[mine] = True
        while len(met):
            j, met = met[0], met[1:]
            both = int(held[element[first[j] : first[j] + size[j]]].sum())
            if down * both >= up * (int(size[i]) + int(size[j]) - both):
                component[component == component[j]] = component[i]
                out.append((nodes[i], nodes[j]))
                met = met[component[met] != component[i]]
        held[mine] = False
    return out


def _compare(threshold: Fraction):
    def run(key, table):
        nodes = table.column("node").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("elements").to_pylist()]
        block = table.column("block").to_pylist()
        found = linked(nodes, sets, [int(b != block[0]) for b in block], threshold)
        return pa.table({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    return run


def ngram_join(docs: DataFrame, n: int = 3, threshold: Fraction = Fraction(9, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose sets of ``n``-word shingles have a Jaccard similarity of at least ``threshold``.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer than ``n`` words has its whole
    sequence as its one element. Returns one row per row of ``docs``: doc_id, n_shingles, component_id (the
    smallest doc_id reachable by links, its own included).

    Exact: a pair that is similar enough shares a signature, and neither size nor sketch refuses it, so it is in
    one group, where only pairs that are joined by a chain of links already are not compared. A null or
    wordless text is linked with nothing. Repeated rows and equal sets are linked. A row with a null doc_id links others, but gives no component its name; alone,
    its component_id is null. Empty tables give empty results; other columns are ignored.
    """
    rows, classes = _joined(pick(docs, id_col, text_col).toDF("doc_id", "text"), [], n, threshold)
    named, total = _named(classes)
    out = skew_safe_join(rows, named.drop("root"), list(SET_COLUMNS), "members", total, "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, with all its columns: that with the smallest id, one only if rows repeat it.

    Rows whose texts have no words belong to no component and all stay, null texts too. Of a component without
    ids one row stays. An empty table gives an empty result; columns pass through whatever their names, and of two
    with the name of an input the first is read.
    """
    plain = numbered(docs)
    whole = [F.struct(*plain.columns)]
    mark = [F.xxhash64(*whole, F.lit(1)).alias("ra"), F.xxhash64(F.lit(2), *whole).alias("rb")]
    base = plain.select(F.col(column_of(docs, id_col)).alias("doc_id"), F.col(column_of(docs, text_col)).alias("text"), *mark)
    rows, classes = _joined(base, ["ra", "rb"], n, threshold)
    named, total = _named(classes)
    members = stored(skew_safe_join(rows, named.drop("component_id"), list(SET_COLUMNS), "members", total, "inner").select("root", "doc_id", "ra", "rb"))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "ra", "rb")
    kept = members.groupBy("root").agg(F.min_by(F.struct("ra", "rb"), first).alias("kept"), F.count(F.lit(1)).alias("n_rows"))
    judged = skew_safe_join(members, kept.where("n_rows > 1"), ["root"], "n_rows", total, "inner")
    stays = (F.col("ra") == F.col("kept.ra")) & (F.col("rb") == F.col("kept.rb"))
    # A row that stays may be there several times, alike in every column.
    fate = stored(judged.select("ra", "rb", F.when(stays, 1).otherwise(0).alias("stays")).groupBy("ra", "rb").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("times")))
    marked = plain.withColumns({"ra": mark[0], "rb": mark[1]})
    gone = maybe_broadcast(fate.where("stays = 0 or times > 1").select("ra", "rb"), 16)
    again = maybe_broadcast(fate.where("stays = 1 and times > 1").select("ra", "rb"), 16)
    once = marked.join(gone, ["ra", "rb"], "left_anti")
    single = marked.join(again, ["ra", "rb"], "left_semi").dropDuplicates(["ra", "rb"])
    return once.unionByName(single).select(*plain.columns).toDF(*docs.columns)


def _joined(base: DataFrame, others: list[str], n: int, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """Rows of ``base`` (doc_id, text, others) with the names of their sets; classes of equal sets with their component's root."""
    bands = Bands(threshold)
    schema = "n_shingles long, set_a long, set_b long, node long, signatures array<long>, sketch binary"
    head = ", ".join(["doc_id long", *[f"{c} long" for c in others]])
    signed = stored(base.select("doc_id", "text", *others).mapInArrow(_digest(n, bands), f"{head}, {schema}"))
    rows = signed.select("doc_id", *SET_COLUMNS, *others)
    classes = stored(signed.where(F.col("n_shingles") > 0).groupBy(*SET_COLUMNS).agg(F.min("node").alias("node"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("members")))
    total = max(signed.count(), 1)
    found = components(_links(base, signed, classes, _groups(signed, threshold), n, threshold, total))
    return rows, stored(classes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))


def _named(classes: DataFrame) -> tuple[DataFrame, int]:
    """Each class with its component's name, the smallest doc_id; and how many rows there are in all."""
    total = classes.agg(F.sum("members")).first()[0] or 1
    names = classes.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n_nodes"))
    named = skew_safe_join(classes, names, ["root"], "n_nodes", total, "inner")
    return stored(named.select(*SET_COLUMNS, "members", "component_id", "root")), total


def _groups(signed: DataFrame, threshold: Fraction) -> DataFrame:
    """(node, root): sets connected by pairs that share a signature and can be similar by size and sketch."""
    entries = signed.where(F.col("sketch").isNotNull()).select("node", F.explode("signatures").alias("s"))
    buckets = stored(entries.groupBy("s").agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("sharers")).where(F.col("sharers") > 1))
    total = max(buckets.agg(F.coalesce(F.sum("sharers"), F.lit(0))).first()[0], 1)
    shared = stored(skew_safe_join(entries.select("s", F.col("node").alias("v")), buckets, ["s"], "sharers", total, "inner"))
    light = signed.where(F.col("sketch").isNotNull()).select("node", F.col("n_shingles").alias("size"), "sketch")
    of = lambda c: light.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("sketch").alias(f"{c}_sketch"))
    pairs = stored(shared.where(F.col("u") != F.col("v")).select("u", "v").distinct())
    # The smallest set of many buckets is in many pairs.
    firsts = of("u").join(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n_pairs")), "u")
    both = skew_safe_join(pairs, firsts, ["u"], "n_pairs", max(pairs.count(), 1), "inner").join(of("v"), "v").select("u", "v", "u_size", "v_size", "u_sketch", "v_sketch")
    judged = stored(both.mapInArrow(_judged(threshold), "u long, v long, ok boolean"))
    # Buckets of three or more in which the smallest set cannot be similar to another one.
    several = shared.where(F.col("sharers") > 2)
    unsettled = several.join(judged.where(~F.col("ok")).select("u", "v"), ["u", "v"], "left_semi").select("s").distinct()
    blocks = F.ceil(F.col("sharers") / BLOCK_SETS).cast("int")
    members = several.join(unsettled, "s", "left_semi").select("s", F.col("v").alias("node"), blocks.alias("blocks"), F.pmod(F.xxhash64("v"), blocks).cast("int").alias("block"))
    jobs = members.select("s", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("s", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node")
    work = jobs.join(light, "node").select("s", "low", "high", "block", "node", "size", "sketch")
    work = work.repartition("s", "low", "high").sortWithinPartitions("s", "low", "high")
    edges = judged.where("ok").select("u", "v").unionByName(work.mapInArrow(_searched(threshold), "u long, v long"))
    return stored(components(edges))


def _links(base: DataFrame, signed: DataFrame, classes: DataFrame, groups: DataFrame, n: int, threshold: Fraction, total: int) -> DataFrame:
    """Links (u, v) between the nodes of ``classes`` that suffice to join what is linked."""
    keys = list(SET_COLUMNS)
    roots = groups.join(signed.select("node", *keys), "node").groupBy(*keys).agg(F.min("root").alias("root"))
    wanted = stored(roots.join(classes, keys).select(*keys, "node", "root", "first_id"))
    sizes = wanted.groupBy("root").agg(F.sum("n_shingles").alias("elements"), F.count(F.lit(1)).alias("n_nodes"), F.min("node").alias("pivot")).where(F.col("n_nodes") > 1)
    sizes = sizes.withColumn("blocks", F.ceil(F.col("elements") / BLOCK_ELEMENTS).cast("int"))
    placed = skew_safe_join(wanted, sizes, ["root"], "n_nodes", total, "inner")
    placed = stored(placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    # First every block by itself, with one set of the group that all its blocks have.
    every = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    inside = placed.select(*keys, "node", "root", "first_id", F.lit(0).alias("block"), F.explode(every).alias("low")).withColumn("high", F.col("low"))
    first = stored(_compared(base, inside, n, threshold))
    large = stored(placed.where(F.col("blocks") > 1))
    if large.isEmpty():
        return first
    # Then blocks of what is not linked to a group's largest part yet, with each other and with that part's blocks.
    return first.unionByName(_compared(base, _meetings(large, first, total), n, threshold))


def _compared(base: DataFrame, jobs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """Links inside jobs (set columns, node, first_id, root, low, high, block), found on the sets' elements."""
    # Texts are read again by id; a repeated id brings other sets along, which meet no job.
    ids = maybe_broadcast(jobs.select(F.coalesce("first_id", F.lit(0)).alias("k"), F.col("first_id").isNull().alias("z")).distinct(), 16)
    texts = base.withColumns({"k": F.coalesce("doc_id", F.lit(0)), "z": F.col("doc_id").isNull()}).join(ids, ["k", "z"], "left_semi").select("doc_id", "text")
    contents = texts.mapInArrow(_content(n), "n_shingles long, set_a long, set_b long, elements binary")
    work = contents.join(jobs.drop("first_id"), list(SET_COLUMNS)).select("root", "low", "high", "node", "block", "elements")
    return work.groupBy("root", "low", "high").applyInArrow(_compare(threshold), "u long, v long")


def _meetings(large: DataFrame, first: DataFrame, total: int) -> DataFrame:
    """Jobs between the blocks of groups of several blocks, as far as ``first`` has not linked them.

    The blocks of a group's largest part of linked sets come first (0, 1, ...) and do not meet each other.
    """
    keys = list(SET_COLUMNS)
    parts = components(first).select("node", F.col("root").alias("part"))
    nodes = stored(large.select(*keys, "node", "root", "first_id").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")))
    sizes = nodes.groupBy("root", "part").agg(F.sum("n_shingles").alias("elements"), F.count(F.lit(1)).alias("n_nodes"))
    groups = sizes.groupBy("root").agg(F.max_by("part", F.struct("elements", "part")).alias("main"), F.max("elements").alias("most"), F.sum("elements").alias("elements"), F.sum("n_nodes").alias("n_nodes")).where(F.col("elements") > F.col("most"))
    blocks = lambda x: F.ceil(x / BLOCK_ELEMENTS).cast("int")
    groups = groups.select("root", "main", "n_nodes", blocks(F.col("most")).alias("mains"), blocks(F.col("elements") - F.col("most")).alias("others"))
    met = skew_safe_join(nodes, groups, ["root"], "n_nodes", total, "inner")
    main = F.col("part") == F.col("main")
    met = met.withColumn("block", F.when(main, F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("node"), F.col("others"))).cast("int"))
    last = F.col("mains") + F.col("others") - 1
    other = F.when(F.col("block") < F.col("mains"), F.sequence(F.col("mains"), last)).otherwise(F.sequence(F.lit(0), last))
    return met.select(*keys, "node", "root", "first_id", "block", F.explode(other).alias("other")).select(*keys, "node", "root", "first_id", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
