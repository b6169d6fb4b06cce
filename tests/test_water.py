"""Filling by watersheds against the fixpoint, cell by cell, and the spill graph by both of its ways."""

import heapq
import math
import random

import numpy as np
import pytest

from gridloom.operators import hydro


def relief(spark, h):
    return spark.createDataFrame([(i, j, float(v)) for j, row in enumerate(h) for i, v in enumerate(row)], "i long, j long, h double")


def filled(h, epsilon=0.0):
    n, m = h.shape
    f = np.full(h.shape, np.inf)
    edge = np.zeros(h.shape, bool)
    edge[0], edge[-1], edge[:, 0], edge[:, -1] = True, True, True, True
    f[edge] = h[edge]
    while True:
        before = f.copy()
        pad = np.pad(f, 1, constant_values=np.inf)
        low = np.min([pad[a : a + n, b : b + m] for a in range(3) for b in range(3) if (a, b) != (1, 1)], axis=0)
        f = np.where(edge, f, np.minimum(f, np.where(h > low, h, low + epsilon)))
        if (f == before).all():
            return f


def pits(rng, n, m):
    h = np.round(rng.random((n, m)) * 20)
    h[n // 4 : n // 2, m // 4 : m // 2] -= 30
    h[2 * n // 3 : -2, 3:-3] -= 15
    return h


@pytest.mark.parametrize("tile,small,seed", [(5, 1 << 20, 1), (5, 0, 2), (3, 0, 3), (256, 1 << 20, 4)])
def test_spilled_is_the_fixpoint(spark, tile, small, seed):
    h = pits(np.random.default_rng(seed), 22, 17)
    got = hydro.spilled(relief(spark, h), 17, 22, tile=tile, small=small).collect()
    want = filled(h)
    assert len(got) == h.size and all(r.f == want[r.j, r.i] for r in got)


def test_fill_of_flats_strips_and_single_cells(spark):
    for h in (np.zeros((1, 1)), np.zeros((6, 9)), np.array([[5.0, 1, 7, 2]]), np.array([[9.0, 9, 9], [9, 1, 9], [9, 9, 9]])):
        got = {(r.j, r.i): r.f for r in hydro.fill(relief(spark, h), h.shape[1], h.shape[0], 0.0).collect()}
        want = filled(h)
        assert got == {(j, i): want[j, i] for j in range(h.shape[0]) for i in range(h.shape[1])}


@pytest.mark.parametrize("seed", [1, 2])
def test_spill_levels_by_both_ways(spark, seed):
    """Ties, parts without a way out, and a hub that most others touch."""
    rng = random.Random(seed)
    edges = {}
    for _ in range(160):
        a, b = rng.sample(range(60), 2)
        edges[min(a, b), max(a, b)] = float(rng.randrange(12))
    edges |= {(7, k): float(rng.randrange(12)) for k in range(8, 60, 2)} | {(100, 101): 1.0}
    around = {}
    for (a, b), w in edges.items():
        around.setdefault(a, []).append((b, w))
        around.setdefault(b, []).append((a, w))
    want, queue = {}, [(-math.inf, 0)]
    while queue:
        z, k = heapq.heappop(queue)
        if k in want:
            continue
        want[k] = z
        for q, w in around.get(k, ()):
            heapq.heappush(queue, (max(z, w), q))
    del want[0]
    graph = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "u long, v long, w double")
    for small in (1 << 20, 0):
        assert {r.label: r.level for r in hydro.spill_levels(graph, small).collect()} == want


# Flow


@pytest.mark.parametrize("tile,seed", [(3, 1), (4, 2), (1, 3), (256, 4)])
def test_flow_by_tiles(spark, tile, seed):
    """Accumulation and ends on a relief with pits, by following every cell; a long winding river crosses many tiles."""
    rng = np.random.default_rng(seed)
    n, m = 17, 23
    h = np.round(rng.random((n, m)) * 50) + np.arange(n)[:, None] * 3
    for j in range(0, n, 2):  # a channel that winds from row to row
        h[j, 1:-1] = -100 - j * 30 - (np.arange(m - 2) if j % 4 == 0 else np.arange(m - 2)[::-1])
        if j + 2 < n:
            h[j + 1, -2 if j % 4 == 0 else 1] = -100 - j * 30 - 25
    graph = hydro.edges(hydro.d8(relief(spark, h)), m).cache()
    to = {r.src: r.dst for r in graph.collect()}
    acc, ends = dict.fromkeys(to, 0), {}
    for c in to:
        at = c
        while True:
            acc[at] += 1
            if to[at] is None:
                break
            at = to[at]
        ends[c] = at
    assert {r.src: r.acc for r in hydro.accumulation(graph, m, tile).collect()} == acc and max(acc.values()) > 100
    assert {r.src: r.terminal for r in hydro.flow_terminals(graph, m, tile).collect()} == ends
    assert {r.src: r.acc for r in hydro.accumulation(graph).collect()} == acc


def test_cells_without_height_are_walls(spark):
    """Nothing runs over them or into them, in whatever tile they lie; a neighbour of theirs runs down to the next best."""
    rng = np.random.default_rng(7)
    h = pits(rng, 23, 19)
    h[rng.random(h.shape) < 0.08] = np.nan
    f, queue = np.where(np.isnan(h), np.nan, np.inf), []
    for j, i in np.ndindex(h.shape):
        if (j in (0, 22) or i in (0, 18)) and not np.isnan(h[j, i]):
            f[j, i] = h[j, i]
            queue.append((h[j, i], j, i))
    heapq.heapify(queue)
    while queue:
        z, j, i = heapq.heappop(queue)
        for y, x in ((j + b, i + a) for b in (-1, 0, 1) for a in (-1, 0, 1)):
            if 0 <= y < 23 and 0 <= x < 19 and f[y, x] == np.inf:
                f[y, x] = max(h[y, x], z)
                heapq.heappush(queue, (f[y, x], y, x))
    f = np.where(f == np.inf, h, f)
    cells = spark.createDataFrame([(i, j, None if np.isnan(h[j, i]) else float(h[j, i])) for j, i in np.ndindex(h.shape)], "i long, j long, h double").cache()
    for tile in (4, 256):
        got = {(r.j, r.i): r.f for r in hydro.spilled(cells, 19, 23, tile=tile).collect()}
        assert len(got) == h.size and all(got[k] == f[k] or np.isnan(f[k]) for k in got)
    got = {(r.j, r.i): r.dir for r in hydro.d8(cells).collect()}
    for j, i in np.ndindex(h.shape):
        around = [(h[j + b, i + a], c) for c, a, b in hydro.STEPS if 0 <= j + b < 23 and 0 <= i + a < 19 and not np.isnan(h[j + b, i + a])]
        assert got[j, i] == (min(around)[1] if min(around)[0] < h[j, i] else 0)


def test_rounds_of_filling_write_borders(spark, monkeypatch):
    """A river crosses the tiles one by one: each round writes the tiles and what crosses a border, not all cells again."""
    h = np.full((96, 40), 90.0)
    h[1:-1, 20], h[-1, 20] = 5, 0
    written, real = [], hydro.checkpointed
    monkeypatch.setattr(hydro, "checkpointed", lambda df: written.append(real(df)) or written[-1])
    got = hydro.fill(relief(spark, h), 40, 96, 0.25, tile=8).collect()
    want = filled(h, 0.25)
    assert len(got) == h.size and all(r.f == want[r.j, r.i] for r in got)
    assert len(written) > 8 and sum(d.count() for d in written[2:]) < h.size


def test_outlets_of_water_followed_once(spark):
    """Ends and sums of one pass over the tiles, and the inside said of numbers, against single ones and a table."""
    rng = np.random.default_rng(5)
    h = np.round(rng.random((21, 18)) * 40) + np.arange(21)[:, None] * 2
    graph = hydro.edges(hydro.d8(relief(spark, h)), 18).cache()
    inside = spark.createDataFrame([(c,) for c in range(h.size) if 2 <= c % 18 < 16], "src long")
    one = hydro.outlets(hydro.followed(graph, 18, 4), None, lambda cell: (cell % 18).between(2, 15), None, None)
    two = hydro.outlets(hydro.flow_terminals(graph), hydro.accumulation(graph), inside, None, None)
    for a, b in zip(one, two):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
