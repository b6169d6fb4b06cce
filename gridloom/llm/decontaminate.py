"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A text that holds an item of m characters with at most k edits shares at least m + 1 - q * (k + 1) of the
item's q-grams, all on diagonals that differ by at most k. Diagonals are cut into bands of width 2 * (k + 1)
that overlap by half, so one band sees all of them. A band with fewer hits than the bound is passed over; the
region under any other, and under those that touch it, is aligned with the item inside a band of the matrix, exactly.

Q is 8, or less where an item is so short that no gram of 8 need survive its edits; an item that allows none is
its own gram up to that length, so the shortest items are found too, exactly.

Characters are those of the lower-cased (A-Z) UTF-8 text, one byte each: a difference in a character beyond
ASCII counts for as many edits as it has bytes that differ. Runs of blanks and line ends count as one space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import column_of, give_back, numbered, pick, stored
from gridloom.llm.words import LOWER, slices

#: The longest q-grams.
Q = 8
#: Edits allowed, as a share of an item's characters.
EDIT_SHARE = 0.1
TABLE_BITS = 22
#: Places of texts, and pairs of them and groups of an item's places, that are held at a time.
HELD = 1 << 18
#: So many pairs are kept for a second look; if there are more, they are found again.
KEPT = 1 << 20
#: Items are looked for in blocks of so many characters and items, which bounds what each task holds; and with so
#: many blocks in one plan.
BLOCK_CHARS, BLOCK_ITEMS, PLAN_BLOCKS = 1 << 20, 1 << 16, 16
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The q-grams of bytes (q is 8 at most) as 64-bit numbers."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    wide = np.concatenate([data, np.zeros(Q - q, np.uint8)]) if q < Q else np.ascontiguousarray(data)
    out = np.ndarray((len(data) - q + 1,), "<u8", wide, 0, (1,))
    return out & np.uint64((1 << 8 * q) - 1) if q < Q else out


def squeeze(low: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Runs of blanks become one space; offsets move along."""
    blank = BLANK[low]
    keep = np.ones(len(low), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[start[start < len(low)]] = True
    moved = np.concatenate([[0], np.cumsum(keep)])
    out = np.where(blank, np.uint8(0x20), low)[keep]
    return out, moved[start], moved[end]


class Index:
    """Items of one block that are looked for by grams of one length.

    A group is an item's places of one gram, ascending. What is counted are places of a text that meet a group, and how
    many of its places lie on a band's diagonals: a gram that both text and item repeat is a few numbers for each place
    of the text, not one for each pair of places. Rows are taken HELD at a time, so memory is linear in text and items.
    """

    def __init__(self, q: int, items: list[int], data: list[np.ndarray], k: list[int]):
        self.q = q
        self.least = np.array([len(d) + 1 - q * (e + 1) for d, e in zip(data, k)], np.int64)
        self.half = np.array([e + 1 for e in k], np.int64)
        self.number = np.array(items, np.int64)
        g = [grams(d, q) for d in data]
        value = np.concatenate(g)
        item = np.repeat(np.arange(len(g)), [len(x) for x in g])
        at = np.concatenate([np.arange(len(x)) for x in g])
        order = np.lexsort((at, item, value))
        value, item, self.at = value[order], item[order], at[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (item[1:] != item[:-1])
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(value)))
        self.item = item[self.first]
        # Places in one ascending row: those of group n begin at n * span.
        self.span = int(at.max(initial=0)) + 2
        self.line = np.repeat(np.arange(len(self.first)), self.size) * self.span + self.at
        self.value, self.begin = np.unique(value[self.first], return_index=True)
        self.groups = np.diff(np.append(self.begin, len(self.first)))
        self.table = None

    def cell(self, values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def met(self, low: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(place, row, group) of every place of a text that meets a group, some HELD at a time."""
        for base in range(0, max(len(low) - self.q + 1, 0), HELD):
            g = grams(low[base : base + HELD + self.q - 1], self.q)
            place = np.flatnonzero(self.table[self.cell(g)])
            u = np.minimum(np.searchsorted(self.value, g[place]), len(self.value) - 1)
            same = self.value[u] == g[place]
            place, u = place[same] + base, u[same]
            row = np.searchsorted(start, place, "right") - 1
            inside = place + self.q <= end[row]
            place, u, row = place[inside], u[inside], row[inside]
            upto = np.cumsum(self.groups[u])
            a = 0
            while a < len(place):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HELD, "right")))
                n = self.groups[u[a:b]]
                group = np.repeat(self.begin[u[a:b]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                yield np.repeat(place[a:b], n), np.repeat(row[a:b], n), group
                a = b

    def regions(self, low: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(row, item, first diagonal, last diagonal) where bands meet the bound; bands that touch are one region.
        ``start``, ``end``: rows' offsets in ``low``."""
        if self.table is None:  # made where it is used, not sent there
            self.table = np.zeros(1 << TABLE_BITS, bool)
            self.table[self.cell(self.value)] = True
        many = len(self.least)
        # A pair of row and item with fewer hits than the bound has no band that meets it.
        hits, kept, size = Sums(), [], 0
        for part in self.met(low, start, end):
            hits.add(part[1] * many + self.item[part[2]], self.size[part[2]])
            size += len(part[0])
            if size <= KEPT:
                kept.append(part)
        pairs = hits.key[hits.total >= self.least[hits.key % many]]
        if not len(pairs):
            return np.zeros((0, 4), np.int64)
        # Bands [2b + shift, 2b + shift + 2) of half widths, for shifts of 0 and 1.
        reach = 1 + (len(low) + self.span) // self.half.min()
        counts = [Sums(), Sums()]
        for place, row, group in kept if size <= KEPT else self.met(low, start, end):
            pair = row * many + self.item[group]
            n = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            some = pairs[n] == pair
            place, row, group, n = place[some], row[some], group[some], n[some]
            half, x = self.half[self.item[group]], place - start[row]
            first = self.at[self.first[group]]
            last = self.at[self.first[group] + self.size[group] - 1]
            for shift in (0, 1):
                low_band = ((x - last) // half - shift) // 2
                bands = ((x - first) // half - shift) // 2 - low_band + 1
                of = np.repeat(np.arange(len(x)), bands)
                b = low_band[of] + np.arange(len(of)) - np.repeat(np.cumsum(bands) - bands, bands)
                below = (2 * b + shift) * half[of]  # diagonals from here, 2 * half of them
                upto = np.clip(x[of] - below, -1, self.span - 2)
                before = np.clip(x[of] - below - 2 * half[of], -1, self.span - 2)
                line = group[of] * self.span
                held = np.searchsorted(self.line, line + upto, "right") - np.searchsorted(self.line, line + before, "right")
                counts[shift].add(n[of] * (2 * reach) + b + reach, held)
        out = []
        for shift in (0, 1):
            met = counts[shift].key[counts[shift].total >= self.least[pairs[counts[shift].key // (2 * reach)] % many]]
            pair, b = pairs[met // (2 * reach)], met % (2 * reach) - reach
            half = self.half[pair % many]
            out.append(np.stack([pair // many, pair % many, (2 * b + shift) * half, (2 * b + shift + 2) * half], 1))
        found = np.concatenate(out)
        if not len(found):
            return found
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:, :2] != found[:-1, :2]).any(1) | (found[1:, 2] > found[:-1, 3])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(found)) - 1
        return np.stack([found[first, 0], self.number[found[first, 1]], found[first, 2], found[last, 3]], 1)


class Sums:
    """Sums by whole-number key, ascending, added to in parts."""

    def __init__(self):
        self.key, self.total = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        if len(key):
            self.key, place = np.unique(np.concatenate([self.key, key]), return_inverse=True)
            self.total = np.bincount(place, np.concatenate([self.total, n])).astype(np.int64)


class Items:
    """Benchmark items of one block and the indexes of their q-grams."""

    def __init__(self, ids: list, texts: list[str], share: float):
        self.ids, self.data, self.k = [], [], []
        lengths: dict[int, list[int]] = {}
        for i, t in zip(ids, texts):
            raw = LOWER[np.frombuffer((t or "").encode(), np.uint8)]
            data = squeeze(raw, np.array([0]), np.array([len(raw)]))[0]
            while len(data) and data[-1] == 0x20:
                data = data[:-1]
            while len(data) and data[0] == 0x20:
                data = data[1:]
            if len(data):
                # The longest grams of which all edits leave one at least.
                k = int(len(data) * share)
                lengths.setdefault(max(1, min(Q, len(data) // (k + 1))), []).append(len(self.ids))
                self.ids.append(i)
                self.data.append(data)
                self.k.append(k)
        self.indexes = [Index(q, at, [self.data[n] for n in at], [self.k[n] for n in at]) for q, at in sorted(lengths.items())]


def banded(text: np.ndarray, item: np.ndarray, k: int) -> int:
    """The fewest edits, at most ``k``, that turn the item into a part of ``text``; else k + 1.

    ``text`` is the item's length and the diagonals to be looked at, so the matrix is a band by itself. One row
    for each character of the item; insertions along a row are a running minimum.
    """
    if item.tobytes() in text.tobytes():
        return 0
    n = len(text)
    row = np.zeros(n + 1, np.int64)
    steps = np.arange(n + 1)
    for j, c in enumerate(item):
        new = np.empty(n + 1, np.int64)
        new[0] = j + 1
        np.minimum(row[1:] + 1, row[:-1] + (text != c), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > k:
            return k + 1
    return min(int(row.min()), k + 1)


def search(items: Items, part) -> dict[int, list]:
    """For each row of a slice that holds an item: (item's id, fewest edits found)."""
    low, start, end = squeeze(part.low, part.start, part.end)
    best: dict[tuple[int, int], int] = {}
    for row, item, diagonal, until in np.concatenate([np.zeros((0, 4), np.int64), *[x.regions(low, start, end) for x in items.indexes]]):
        name, k, data = (int(row), int(item)), items.k[item], items.data[item]
        if best.get(name) == 0:
            continue
        # The region: where the item may lie on these diagonals, with k characters of slack.
        a = max(int(start[row]), int(start[row] + diagonal) - k)
        b = min(int(end[row]), int(start[row] + until) + len(data) + k)
        edits = banded(low[a:b], data, k)
        if edits <= k and edits < best.get(name, k + 1):
            best[name] = edits
    found: dict[int, list] = {}
    for (row, item), edits in best.items():
        found.setdefault(row, []).append((items.ids[item], edits))
    return found


def _add_leaks(items: Items):
    """(doc_id, text, leaks, edits) with the leaks of one block of items added."""
    longs = pa.list_(pa.int64())

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = search(items, part)
                rows = []
                for r, (ids, edits) in enumerate(zip(part.batch.column(2).to_pylist(), part.batch.column(3).to_pylist())):
                    rows.append(sorted([*zip(ids, edits), *found.get(r, ())], key=lambda x: (x[0] is None, x)))
                yield pa.RecordBatch.from_arrays([part.batch.column(0), part.batch.column(1), pa.array([[x[0] for x in r] for r in rows], longs), pa.array([[x[1] for x in r] for r in rows], longs)], names=["doc_id", "text", "leaks", "edits"])

    return run


def _without(items: Items, text: str):
    """The batches' rows that hold no item."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                found = search(items, part)
                yield part.batch.filter(pa.array([r not in found for r in range(part.rows)], pa.bool_()))
        give_back()

    return run


def blocks(benchmark: DataFrame):
    """The benchmark's items in blocks, streamed to the driver one partition at a time; it holds one block."""
    ids, texts, size = [], [], 0
    for r in pick(benchmark, "item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if texts and (size + len(r[1] or "") > BLOCK_CHARS or len(texts) >= BLOCK_ITEMS):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1] or "")
    if texts:
        yield ids, texts


def _block_by_block(docs: DataFrame, benchmark: DataFrame, share: float, step) -> DataFrame:
    """``step`` of each block in turn; after PLAN_BLOCKS of them what there is by then is written."""
    for n, (ids, texts) in enumerate(blocks(benchmark)):
        if n and n % PLAN_BLOCKS == 0:
            docs = stored(docs)
        docs = docs.mapInArrow(step(Items(ids, texts, share)), docs.schema)
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """Look for the items of ``benchmark`` (item_id, text) in whole texts of ``docs`` (doc_id, text).

    Returns one row per row of ``docs``: doc_id, leaks (sorted ids of items that stand in the text with at most
    ``share`` of their characters edited, rounded down) and edits (for each of them the fewest found). Items of
    any length are looked for, those of fewer than ten characters exactly; null, empty and blank ones match
    nothing. Items are found inside words too.

    A null text counts as empty; repeated rows are searched each, repeated items reported each; a null doc_id
    stays null; an empty table gives an empty result, an empty benchmark rows without leaks; other columns are
    ignored. Items go to the tasks in blocks of BLOCK_CHARS characters at most, one after the other: what the
    driver, a plan and a task hold is bounded, nothing is shuffled, and time grows with texts times blocks.
    """
    none = F.expr("cast(array() as array<bigint>)")
    out = pick(docs, "doc_id", "text").select("doc_id", "text", none.alias("leaks"), none.alias("edits"))
    return _block_by_block(out, benchmark, share, _add_leaks).select("doc_id", "leaks", "edits")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``, with all their columns, whatever their names; cases as in find_leaks."""
    text = column_of(docs, "text")
    return _block_by_block(numbered(docs), benchmark, share, lambda items: _without(items, text)).toDF(*docs.columns)
