"""Water on a raster: directions, accumulation, terminals, basins, filling, depressions.

Cells are numbered j * width + i. Directions are 1 east, 2 south-east, ... clockwise to 8 north-east, 0 none.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranks import at_ranks
from gridloom.operators.tiles import tiled
from gridloom.plans.iterate import checkpointed, labels, terminals, upstream_counts, upstream_sums
from gridloom.plans.shared import checked_broadcast, skew_safe_join

#: Fixed values: (code, di, dj).
STEPS = ((1, 1, 0), (2, 1, 1), (3, 0, 1), (4, -1, 1), (5, -1, 0), (6, -1, -1), (7, 0, -1), (8, 1, -1))
MIN_AREA, MIN_DEPTH, TOP_BASINS = 64, 3.0, 8


def neighbours(cells: DataFrame, value: str) -> DataFrame:
    """(i, j, code, value of the neighbour in that direction): each cell is sent to its eight neighbours, once."""
    sent = F.array(*[F.struct(F.lit(c).cast("long").alias("code"), (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j")) for c, di, dj in STEPS])
    return cells.select(F.col(value).alias("z"), F.explode(sent).alias("s")).select("s.i", "s.j", "s.code", "z")


def d8(cells: DataFrame, value: str = "h") -> DataFrame:
    """(i, j, dir): towards the lowest of eight neighbours if it is strictly lower; ties by code. Cells without a height are no neighbours."""

    def work(b):
        import numpy as np

        low, code = np.full((b.height, b.width), np.inf), np.zeros((b.height, b.width), np.int64)
        for c, di, dj in STEPS:
            z = b.side("z", di, dj)
            lower = z < low
            low[lower], code[lower] = z[lower], c
        return {"dir": np.where(low < b.side("z", 0, 0), code, 0)}

    z = F.col(value).cast("double")
    return tiled(cells.select("i", "j", F.when(F.isnan(z), F.lit(math.inf)).otherwise(z).alias("z")), ["z"], work, "dir long")


def edges(directions: DataFrame, width: int) -> DataFrame:
    """(src, dst): the flow graph; a cell without direction has no target."""
    step = F.lit(None).cast("long")
    for c, di, dj in STEPS:
        step = F.when(F.col("dir") == c, F.lit(dj * width + di).cast("long")).otherwise(step)
    src = F.col("j") * width + F.col("i")
    return directions.select(src.alias("src"), (src + step).alias("dst"))


#: Cells of a side of the tiles in which water is followed before it leaves them.
FLOW_TILE = 256


def _in_tiles(graph: DataFrame, width: int, tile: int) -> DataFrame:
    """Cells (src, dst, further columns) with their tile."""
    return graph.withColumns({"ti": F.floor(F.pmod("src", F.lit(width)) / tile), "tj": F.floor(F.floor(F.col("src") / width) / tile)})


def _followed(src, dst, weight):
    """For each cell of a tile: the number of its last cell inside, and the weights that drain through it inside; by doubling."""
    import numpy as np

    order = np.argsort(src)
    at = order[np.minimum(np.searchsorted(src[order], dst), len(src) - 1)]
    here = src[at] == dst
    to = np.where(here, at, np.arange(len(src)))
    acc, jump, flows = weight.copy(), to.copy(), here.copy()
    end = to
    for _ in range(64):
        if not flows.any():
            return end, acc
        k = np.flatnonzero(flows)
        # What lies 2**n steps up is added once: a cell that has arrived adds no more.
        acc = acc + np.bincount(jump[k], acc[k], len(src)).astype(np.int64)
        end = end[end]
        flows = flows & flows[jump]
        jump = jump[jump]
    raise ValueError("the graph has a cycle")


def _local(table):
    import numpy as np
    import pyarrow as pa

    src, dst = table.column("src").to_numpy(), table.column("dst").fill_null(-1).to_numpy()
    end, acc = _followed(src, dst, np.ones(len(src), np.int64))
    out = dst[end]
    return pa.table({"src": pa.array(src), "last": pa.array(src[end]), "exit": pa.array(out, mask=out < 0), "acc": pa.array(acc)})


def _arrived(graph, inbox):
    """Each cell's end and what drains through it, of a tile and what its neighbours know: inflow by cells, ends by last cells."""
    import numpy as np
    import pyarrow as pa

    src, dst = graph.column("src").to_numpy(), graph.column("dst").fill_null(-1).to_numpy()
    order = np.argsort(src)

    def placed(column, rest):
        told = inbox.filter(inbox.column(column).is_valid())
        rest[order[np.searchsorted(src[order], told.column("src").to_numpy())]] = told.column(column).to_numpy()
        return rest

    end, acc = _followed(src, dst, placed("inflow", np.zeros(len(src), np.int64)) + 1)
    return pa.table({"src": pa.array(src), "terminal": pa.array(placed("terminal", src.copy())[end]), "acc": pa.array(acc)})


def _borders(graph: DataFrame, width: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """(local, entries): each cell's last cell inside its tile, the cell that it goes on to in another one, and what drains
    through it inside (src, last, exit, acc); and the cells that water enters a tile by, with the same columns and ``inflow``.

    A cell whose exit is its own tile's would be a cycle; it fails.
    """
    local = checkpointed(_in_tiles(graph.select("src", "dst"), width, tile).groupBy("ti", "tj").applyInArrow(_local, "src long, last long, exit long, acc long"))
    inflow = local.where((F.col("src") == F.col("last")) & F.col("exit").isNotNull()).groupBy(F.col("exit").alias("src")).agg(F.sum("acc").alias("inflow"))
    return local, checkpointed(local.join(inflow, "src"))


def followed(graph: DataFrame, width: int, tile: int = FLOW_TILE, ends: bool = True, sums: bool = True) -> DataFrame:
    """(src, terminal, acc): where each cell's water ends, and the cells that drain through it, itself included.

    Water is followed inside tiles first. What is left is a graph of the cells by which water enters a tile, followed and
    summed by doubling; a second pass over the tiles adds what enters and where it ends. So rounds move the tiles'
    borders. Without ``ends`` or ``sums`` that column stops at the tile's border.
    """
    local, entries = _borders(graph, width, tile)
    told = []
    if sums:
        entered = upstream_sums(entries.select("src", F.col("exit").alias("dst"), F.col("inflow").alias("acc")))
        told.append(entered.select("src", F.col("acc").alias("inflow"), F.lit(None).cast("long").alias("terminal")))
    if ends:
        last = terminals(entries.select("src", F.col("exit").alias("dst"))).select(F.col("src").alias("exit"), F.col("terminal").alias("entry"))
        # The last entry's water ends where it ends inside its own tile.
        known = last.join(entries.select(F.col("src").alias("entry"), F.col("last").alias("terminal")), "entry")
        out = local.where((F.col("src") == F.col("last")) & F.col("exit").isNotNull())
        told.append(out.select("src", "exit").join(known, "exit").select("src", F.lit(None).cast("long").alias("inflow"), "terminal"))
    inbox = told[0].unionByName(told[1]) if len(told) == 2 else told[0]
    by = lambda rows: _in_tiles(rows, width, tile).groupBy("ti", "tj")
    return by(graph.select("src", "dst")).cogroup(by(checkpointed(inbox))).applyInArrow(_arrived, "src long, terminal long, acc long")


def accumulation(graph: DataFrame, width: int | None = None, tile: int = FLOW_TILE) -> DataFrame:
    """(src, acc): the cells that drain through each cell of a flow graph (src, dst or null), itself included; by tiles with the raster's width."""
    if width is None:
        return upstream_counts(graph)
    return followed(graph, width, tile, ends=False).select("src", "acc")


def flow_terminals(graph: DataFrame, width: int | None = None, tile: int = FLOW_TILE) -> DataFrame:
    """(src, terminal): where each cell's water ends; by tiles with the raster's width."""
    if width is None:
        return terminals(graph)
    return followed(graph, width, tile, sums=False).select("src", "terminal")


def basins(ends: DataFrame, acc: DataFrame, top: int = TOP_BASINS) -> DataFrame:
    """The largest basins: (rank, terminal, n_cells, outlet_acc), by the water at their end, ties by terminal."""
    sizes = ends.groupBy("terminal").agg(F.count(F.lit(1)).alias("n_cells"))
    flow = acc.select(F.col("src").alias("terminal"), F.col("acc").alias("outlet_acc"))
    return sizes.join(flow, "terminal").orderBy(F.desc("outlet_acc"), "terminal").limit(top)


TILE = 128


def fill(cells: DataFrame, width: int, height: int, epsilon: float, value: str = "h", tile: int = TILE, max_rounds: int = 2000, ground: bool = False) -> DataFrame:
    """Depression filling: (i, j, f), the least surface that drains to the edge with steps of epsilon; with the ``ground`` in ``value`` too.

    The fixpoint f = h at the edge and h or m + epsilon inside, whichever is higher, m the least f around. Without
    epsilon it is found by watersheds (``spilled``), in two passes over the cells. With it levels depend on the steps taken:
    tiles are relaxed in rounds (``_settled``). Their number is that of tiles on a drain path, not of cells.
    """
    if epsilon == 0:
        return spilled(cells, width, height, value, ground=ground)
    edge = (F.col("i") == 0) | (F.col("j") == 0) | (F.col("i") == width - 1) | (F.col("j") == height - 1)
    h = F.col(value).cast("double")
    still = _settled(cells.select("i", "j", h.alias("g"), F.when(edge, h).otherwise(F.lit(math.inf)).alias("f")), _risen(epsilon), tile, max_rounds)
    return still.select("i", "j", *[F.col("g").alias(value)] * ground, "f")


#: A tile of a loop as one row (its first cell, size, and two planes with a rim of one cell), and cells told to a neighbour.
STATE = "ti long, tj long, i long, j long, w long, n long, g double, f double, ground binary, level binary"


def _settled(cells: DataFrame, relax, tile: int, max_rounds: int) -> DataFrame:
    """(i, j, g, f) of cells with a ground ``g`` and a first level ``f``, when ``relax`` moves none of them any more.

    Each tile is one row from its first round on. A round takes what its neighbours told it, relaxes it until it is still
    and tells them which of its outermost cells went down; a tile that was told nothing stays as it is. Rounds end when
    nobody is told anything, so they move borders and no cells one by one.
    """
    place = [F.floor(F.col(c) / tile).alias(f"t{c}") for c in "ij"]
    step = checkpointed(cells.select("i", "j", "g", "f", *place).groupBy("ti", "tj").applyInArrow(_opened(relax, tile), STATE))
    for _ in range(max_rounds):
        state, told = step.where("level is not null"), step.where("level is null")
        if told.isEmpty():
            return state.groupBy("ti", "tj").applyInArrow(_unpacked, "i long, j long, g double, f double")
        step = checkpointed(state.groupBy("ti", "tj").cogroup(told.select("ti", "tj", "i", "j", "g", "f").groupBy("ti", "tj")).applyInArrow(_told(relax, tile), STATE))
    raise RuntimeError("tiles did not settle")


def _state(ti, tj, i0, j0, g, f, before, tile):
    """The row of a tile and those for its neighbours: outermost cells that are lower than ``before``."""
    import numpy as np
    import pyarrow as pa

    n, w = before.shape
    row = {"ti": ti, "tj": tj, "i": i0, "j": j0, "w": w, "n": n, "g": None, "f": None, "ground": g.tobytes(), "level": f.tobytes()}
    lower = f[1:-1, 1:-1] < before
    i, j = np.arange(i0, i0 + w), np.arange(j0, j0 + n)
    at_i, at_j = ({-1: c == t * tile, 0: np.ones(len(c), bool), 1: c == t * tile + tile - 1} for c, t in ((i, ti), (j, tj)))
    told = {c: [] for c in ("ti", "tj", "i", "j", "g", "f")}
    for _, a, b in STEPS:
        y, x = np.nonzero(lower & at_j[b][:, None] & at_i[a])
        values = (np.full(len(x), ti + a), np.full(len(x), tj + b), i[x], j[y], g[y + 1, x + 1], f[y + 1, x + 1])
        for c, v in zip(told, values):
            told[c].append(v)
    told = {c: np.concatenate(v) for c, v in told.items()}
    none = len(told["ti"])
    schema = _state_schema()
    rows = pa.table({c.name: pa.array(told[c.name], c.type) if c.name in told else pa.nulls(none, c.type) for c in schema}, schema)
    return pa.concat_tables([pa.Table.from_pylist([row], schema), rows])


def _state_schema():
    import pyarrow as pa

    types = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, types[kind]) for name, kind in (c.split() for c in STATE.split(", "))])


def _opened(relax, tile):
    def run(key, table):
        import numpy as np

        ti, tj = (k.as_py() for k in key)
        i, j = (table.column(c).to_numpy() for c in "ij")
        i0, j0 = int(i.min()), int(j.min())
        shape = (int(j.max()) - j0 + 3, int(i.max()) - i0 + 3)
        # Ground of -inf is no cell. One of NaN is a cell without height, which no water passes.
        g, f = np.full(shape, -np.inf), np.full(shape, np.inf)
        h = table.column("g").to_numpy()
        g[j - j0 + 1, i - i0 + 1], f[j - j0 + 1, i - i0 + 1] = h, np.where(np.isnan(h), np.inf, table.column("f").to_numpy())
        return _state(ti, tj, i0, j0, g, relax(g, f), np.full((shape[0] - 2, shape[1] - 2), np.inf), tile)

    return run


def _planes(row):
    import numpy as np

    shape = (row["n"] + 2, row["w"] + 2)
    return np.frombuffer(row["ground"]).reshape(shape).copy(), np.frombuffer(row["level"]).reshape(shape).copy()


def _told(relax, tile):
    def run(key, state, told):
        if not state.num_rows:
            return _state_schema().empty_table()
        if not told.num_rows:
            return state.select(_state_schema().names)
        row = state.to_pylist()[0]
        g, f = _planes(row)
        before = f[1:-1, 1:-1].copy()
        x, y = told.column("i").to_numpy() - row["i"] + 1, told.column("j").to_numpy() - row["j"] + 1
        near = (x >= 0) & (y >= 0) & (x < g.shape[1]) & (y < g.shape[0])
        g[y[near], x[near]], f[y[near], x[near]] = told.column("g").to_numpy()[near], told.column("f").to_numpy()[near]
        return _state(row["ti"], row["tj"], row["i"], row["j"], g, relax(g, f), before, tile)

    return run


def _unpacked(key, state):
    import numpy as np
    import pyarrow as pa

    row = state.to_pylist()[0]
    g, f = (p[1:-1, 1:-1] for p in _planes(row))
    y, x = np.nonzero(g != -np.inf)
    ground = g[y, x]
    return pa.table({"i": pa.array(x + row["i"]), "j": pa.array(y + row["j"]), "g": pa.array(ground), "f": pa.array(np.where(np.isnan(ground), np.nan, f[y, x]))})


def _risen(epsilon: float):
    def relax(g, f):
        import numpy as np

        h, own = g[1:-1, 1:-1], f[1:-1, 1:-1]
        solid = ~(h > -np.inf)
        while True:
            # A cell's own level among those around it changes nothing: it is its ground's at least.
            m = np.minimum(np.minimum(f[:-2], f[1:-1]), f[2:])
            m = np.minimum(np.minimum(m[:, :-2], m[:, 1:-1]), m[:, 2:])
            new = np.minimum(own, np.where(h > m, h, m + epsilon))
            new[solid] = np.inf
            if (new == own).all():
                return f
            own[:] = new

    return relax


#: The watershed of what drains over the raster's edge; others are numbered by tile, LABELS to a tile.
OUTSIDE, LABELS = 0, 1 << 20
#: Edges of a spill graph that one task solves; larger graphs are contracted in rounds.
SMALL_GRAPH = 1 << 20


def spilled(cells: DataFrame, width: int, height: int, value: str = "h", tile: int = 256, small: int = SMALL_GRAPH, ground: bool = False) -> DataFrame:
    """(i, j, f): the least surface without pits, by watersheds of tiles; with the ``ground`` in ``value`` too.

    Each tile is flooded from its own rim, lowest first: every cell gets the level at which it spills over the rim, and the
    watershed by which it does. Watersheds that touch, in a tile or across its border, are joined by the level at which
    one runs over into the other. On that graph, which is as large as the tiles' rims, each watershed's level is the
    least highest step on the ways to the raster's edge; a cell's is the higher of its own and its watershed's.
    """
    place = [F.floor(F.col(c) / tile).alias(f"t{c}") for c in "ij"]
    local = checkpointed(cells.select("i", "j", F.col(value).cast("double").alias("h"), *place).groupBy("ti", "tj").applyInArrow(_flooded(width, height, tile), "i long, j long, h double, f double, label long, other long"))
    held = local.where("other is null").select("i", "j", "h", "f", "label")
    edge = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    rim = held.where(edge("i") | edge("j")).select("i", "j", "label", "f", F.struct("label", "f").alias("s"))
    met = neighbours(rim, "s").join(rim, ["i", "j"]).where(F.col("z.label") != F.col("label"))
    across = met.select(F.col("label").alias("u"), F.col("z.label").alias("v"), F.greatest("f", "z.f").alias("w"))
    inside = local.where("other is not null").select(F.col("label").alias("u"), F.col("other").alias("v"), F.col("f").alias("w"))
    every = across.unionByName(inside)
    graph = checkpointed(every.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w")))
    levels = spill_levels(graph, small)
    low = held.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    known = checkpointed(low.join(levels, "label", "left"))
    risen = _looked_up(held, known, width * height)
    return risen.select("i", "j", *[F.col("h").alias(value)] * ground, F.greatest("f", F.coalesce("level", F.lit(-math.inf))).alias("f"))


#: Bytes of a row of a table that is looked up by a label.
LABEL_BYTES = 64


def _looked_up(rows: DataFrame, groups: DataFrame, total: int, key: str = "label") -> DataFrame:
    """``rows`` with their groups (key, n rows, values): broadcast where a count shows that they are small, else by a join that spreads hot ones."""
    small = checked_broadcast(groups, LABEL_BYTES)
    return rows.join(small.drop("n"), key) if small is not groups else skew_safe_join(rows, groups, [key], "n", total, "inner").drop("n")


def _flooded(width: int, height: int, tile: int):
    def run(key, table):
        import numpy as np
        import pyarrow as pa

        ti, tj = (k.as_py() for k in key)
        i, j, h = (table.column(c).to_numpy() for c in ("i", "j", "h"))
        i0, j0 = ti * tile, tj * tile
        w, n = int(i.max()) - i0 + 1, int(j.max()) - j0 + 1
        line = w + 2  # a wall around the tile, so that steps need no bounds
        at = (j - j0 + 1) * line + i - i0 + 1
        ground = np.full((n + 2) * line, np.nan)
        ground[at] = h
        outside = (i == 0) | (j == 0) | (i == width - 1) | (j == height - 1)
        rim = outside | (i == i0) | (j == j0) | (i == i0 + w - 1) | (j == j0 + n - 1)
        cells = np.flatnonzero(~np.isnan(ground))
        out = np.zeros(len(ground), bool)
        out[at[outside]] = True
        steps = (-line - 1, -line, -line + 1, -1, 1, line - 1, line, line + 1)
        # Each cell runs down to its lowest neighbour, of equal ones to the first; what leaves the raster stays.
        low, to = ground[cells], cells.copy()
        for d in steps:
            z = ground[cells + d]
            better = (z < low) | ((z == low) & (to == cells) & (d < 0))
            low[better], to[better] = z[better], (cells + d)[better]
        to[out[cells]] = cells[out[cells]]
        root = np.arange(len(ground))
        root[cells] = to
        while (root[root] != root).any():
            root = root[root]
        # Basins are numbered; 0 is the raster's outside.
        names, basin = np.unique(np.where(out[root[cells]], 0, root[cells]), return_inverse=True)
        if not len(names) or names[0] != 0:
            names, basin = np.concatenate([[0], names]), basin + 1
        of = np.full(len(ground), -1)
        of[cells] = basin
        # Water leaves the tile over a basin's lowest cell on the rim.
        leaves = np.full(len(names), np.inf)
        over = rim & ~np.isnan(h)
        np.minimum.at(leaves, of[at[over]], h[over])
        leaves[0] = -np.inf
        edges = []
        for d in steps[4:]:
            near = cells[of[cells + d] >= 0]
            u, v = of[near], of[near + d]
            far = u != v
            edges.append((np.minimum(u, v)[far], np.maximum(u, v)[far], np.maximum(ground[near], ground[near + d])[far]))
        u, v, top = (np.concatenate(e) for e in zip(*edges))
        order = np.argsort(top, kind="stable")
        _, first = np.unique((u * len(names) + v)[order], return_index=True)
        order = order[np.sort(first)]
        part, floor, spills = _joined(u[order].tolist(), v[order].tolist(), top[order].tolist(), leaves)
        label = np.full(len(names), -1)
        stands = np.unique(part[leaves < np.inf])
        label[stands] = np.arange(len(stands)) + (tj * -(-width // tile) + ti) * LABELS
        label[0] = OUTSIDE
        floor[label[part] < 0] = -np.inf
        number = label[part]
        known = of[at] >= 0
        f = np.where(known, np.maximum(h, floor[of[at]]), np.nan)
        own = pa.table({"i": i, "j": j, "h": h, "f": f, "label": np.where(known, number[of[at]], -2), "other": pa.nulls(len(i), pa.int64())})
        none = pa.nulls(len(spills), pa.int64())
        pairs = [sorted((int(label[a]), int(label[b]))) for a, b in spills]
        return pa.concat_tables([own, pa.table({"i": none, "j": none, "h": none.cast(pa.float64()), "f": pa.array(spills.values(), pa.float64()), "label": pa.array([p[0] for p in pairs], pa.int64()), "other": pa.array([p[1] for p in pairs], pa.int64())})])

    return run


def _joined(u, v, top, leaves):
    """Basins joined by edges from the lowest one up: each one's part, the level at which it runs over into that, and the
    lowest edges between parts. A part takes in what runs over into it before it leaves the tile.
    """
    import numpy as np

    n = len(leaves)
    up, exit, link, floor, spills = list(range(n)), leaves.tolist(), np.arange(n), np.full(n, -np.inf), {}

    def part(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b, z in zip(u, v, top):
        a, b = part(a), part(b)
        if a == b:
            continue
        if exit[a] <= z and exit[b] <= z:
            spills.setdefault((a, b) if a < b else (b, a), z)
            continue
        if exit[a] <= z:
            a, b = b, a
        up[a] = link[a] = b
        floor[a] = z
        if exit[b] > z:
            floor[b] = z
        exit[b] = min(exit[a], exit[b])
    # The last level on the way up is the highest.
    while (link[link] != link).any():
        floor, link = np.maximum(floor, floor[link]), link[link]
    return link, np.maximum(floor, floor[link]), spills


def spill_levels(graph: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """(label, level) of a graph (u, v, w), each pair once: the least highest w on the ways to OUTSIDE; what has none is left out.

    A graph of ``small`` edges at most, by count, is solved in one task. A larger one is contracted: every watershed takes
    its lowest way out, watersheds that this connects become one, and the lowest ways between those are left. A
    watershed's level is the highest of the ways that it and what it became a part of took.
    """
    if graph.count() <= small:
        return graph.groupBy(F.lit(0).alias("one")).applyInPandas(_by_height, "label long, level double")
    both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    held = checkpointed(both.select("u").distinct().select(F.col("u").alias("label"), F.col("u").alias("at"), F.lit(-math.inf).alias("level")))
    for _ in range(64):
        if graph.isEmpty():
            break
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
        # The order of all edges is total, so that ways out meet in pairs only.
        best = both.where(F.col("u") != OUTSIDE).groupBy("u").agg(F.min(F.struct("w", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))).alias("e"))
        out = checkpointed(best.select("u", F.when(F.col("e.a") == F.col("u"), F.col("e.b")).otherwise(F.col("e.a")).alias("to"), F.col("e.w").alias("w")))
        back = out.select(F.col("u").alias("to"), F.col("to").alias("again"))
        linked = out.join(back, "to", "left")
        # Of two that take each other the smaller one stands for both.
        stays = (F.col("again") == F.col("u")) & (F.col("u") < F.col("to"))
        forest = checkpointed(linked.select("u", F.when(~F.coalesce(stays, F.lit(False)), F.col("to")).alias("to"), "w"))
        ends = terminals(forest.select(F.col("u").alias("src"), F.col("to").alias("dst")).unionByName(forest.sparkSession.createDataFrame([(OUTSIDE, None)], "src long, dst long")))
        root = checkpointed(ends.join(forest.select(F.col("u").alias("src"), "w", F.col("to").isNull().alias("stays")), "src", "left"))
        step = F.when(F.coalesce("stays", F.lit(True)), F.lit(-math.inf)).otherwise(F.col("w"))
        held = checkpointed(held.join(root.select(F.col("src").alias("at"), "terminal", step.alias("step")), "at", "left").select("label", F.coalesce("terminal", "at").alias("at"), F.greatest("level", F.coalesce("step", F.lit(-math.inf))).alias("level")))
        to = lambda c: root.select(F.col("src").alias(c), F.col("terminal").alias(f"{c}2"))
        moved = graph.join(to("u"), "u").join(to("v"), "v").where("u2 <> v2")
        graph = checkpointed(moved.groupBy(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).agg(F.min("w").alias("w")))
    else:
        raise RuntimeError("the spill graph did not settle")
    return held.where((F.col("at") == OUTSIDE) & (F.col("label") != OUTSIDE)).select("label", "level")


def _by_height(pdf):
    """Edges from the lowest one up: what a rise connects to the outside has its level then."""
    import pandas as pd

    members, of, level = {}, {}, {}
    for u, v, w in pdf.sort_values(["w", "u", "v"])[["u", "v", "w"]].itertuples(index=False):
        a, b = of.setdefault(u, u), of.setdefault(v, v)
        if a == b:
            continue
        groups = [members.pop(k, [k]) for k in (a, b)]
        if OUTSIDE in (a, b):
            name = OUTSIDE
            for m in groups[0] if b == OUTSIDE else groups[1]:
                level[m] = w
        else:
            name = a if len(groups[0]) >= len(groups[1]) else b
        moved = groups[0] if name == b else groups[1]
        for m in moved:
            of[m] = name
        stays = groups[1] if name == b else groups[0]
        stays += moved
        members[name] = stays
    return pd.DataFrame({"label": list(level), "level": list(level.values())}).astype({"label": "int64", "level": "float64"})


def components(cells: DataFrame, width: int, tile: int = 256) -> DataFrame:
    """(node, label) of the 8-connected components of a set of cells, the label the smallest node; further columns stay.

    Components inside a tile are found in the tile; what is joined over the whole raster is one edge for each pair of
    them that touch across a border.
    """
    further = [c for c in cells.columns if c not in ("i", "j")]
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    place = [F.floor(F.col(c) / tile).alias(f"t{c}") for c in "ij"]
    schema = ", ".join(["i long", "j long", *[f"`{c}` {kinds[c]}" for c in further], "node long, local long"])
    local = checkpointed(cells.select("i", "j", *further, *place).groupBy("ti", "tj").applyInArrow(_labelled(width, further), schema))
    edge = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    rim = local.where(edge("i") | edge("j")).select("i", "j", "local")
    met = neighbours(rim, "local").join(rim, ["i", "j"]).where(F.col("z") != F.col("local"))
    parts = checkpointed(local.groupBy("local").agg(F.count(F.lit(1)).alias("n")))
    found = labels(parts.select(F.col("local").alias("node")), met.select(F.col("local").alias("u"), F.col("z").alias("v")).distinct())
    whole = checkpointed(parts.join(found.select(F.col("node").alias("local"), "label"), "local"))
    total = whole.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return _looked_up(local, whole, total, "local").select("node", "label", *further)


def _labelled(width: int, further: list[str]):
    def run(key, table):
        import numpy as np
        import pyarrow as pa

        i, j = (table.column(c).to_numpy() for c in "ij")
        i0, j0 = i.min() - 1, j.min() - 1
        shape = (int(j.max() - j0) + 2, int(i.max() - i0) + 2)
        # Places in the tile are in the order of the nodes.
        at, none = (j - j0) * shape[1] + i - i0, shape[0] * shape[1]
        held = np.full(none + 1, none)
        held[at] = at
        plane = held[:-1].reshape(shape)
        while True:
            low = np.minimum(np.minimum(plane[:-2], plane[1:-1]), plane[2:])
            low = np.minimum(np.minimum(low[:, :-2], low[:, 1:-1]), low[:, 2:]).ravel()
            own = (j - j0 - 1) * (shape[1] - 2) + i - i0 - 1
            # A cell's label is a cell of its component: what that one knows, and the one that it names.
            new = held[np.minimum(low[own], held[at])]
            np.minimum.at(held, held[at], new)
            new = np.minimum(new, held[held[at]])
            if (new == held[at]).all():
                break
            held[at] = new
        first = held[at]
        local = (first // shape[1] + j0) * width + first % shape[1] + i0
        return pa.table({"i": pa.array(i), "j": pa.array(j)} | {c: table.column(c) for c in further} | {"node": pa.array(j * width + i), "local": pa.array(local)})

    return run


def submerged(cells: DataFrame, filled: DataFrame, width: int, value: str = "h") -> DataFrame:
    """(node, label, z, depth): the cells that filling raised by over 0.01, their component, ground and depth."""
    both = _on_ground(cells, filled, value)
    wet = both.where(F.col("f") - F.col(value) > 0.01).select("i", "j", F.col(value).alias("z"), (F.col("f") - F.col(value)).alias("depth"))
    return checkpointed(components(wet, width))


def _on_ground(cells: DataFrame, filled: DataFrame, value: str) -> DataFrame:
    """A fill with its ground, which it may have kept."""
    return filled if value in filled.columns else cells.join(filled, ["i", "j"])


def depressions(cells: DataFrame, filled: DataFrame, width: int, value: str = "h", members: DataFrame | None = None) -> DataFrame:
    """Each component of cells that filling raised by over 0.01: cells, greatest depth, lowest cell, whether it is kept.

    ``members`` are these cells as ``submerged`` gives them, if they are at hand.
    """
    named = submerged(cells, filled, width, value) if members is None else members
    found = named.groupBy("label").agg(F.count(F.lit(1)).alias("n_cells"), F.max("depth").alias("max_depth"), F.min_by("node", F.struct("z", "node")).alias("bottom"))
    return found.withColumn("retained", retained(F.col("n_cells"), F.col("max_depth")))


def retained(n_cells: Column, depth: Column) -> Column:
    return (n_cells >= MIN_AREA) & (depth >= MIN_DEPTH)


def river_threshold(acc: DataFrame, share: float) -> DataFrame:
    """The accumulation at rank ceil(n * share) from above; infinite where there are no cells."""
    n = acc.count()
    rank = min(n - 1, max(0, math.ceil(n * share) - 1))
    threshold = at_ranks(acc, F.col("acc"), [n - 1 - rank])[0] if n else math.inf
    return acc.sparkSession.range(1).select(F.lit(threshold).cast("double").alias("threshold"))


def outlets(ends: DataFrame, acc: DataFrame | None, inside: DataFrame | Callable[[Column], Column], depressions: DataFrame | None, members: DataFrame | None, top: int = TOP_BASINS) -> tuple[DataFrame, DataFrame]:
    """Main basins and every cell's label.

    ``ends`` (src, terminal), ``acc`` (src, acc), or none if ``ends`` holds it, ``inside`` (src), or what says it of a cell's
    number; ``depressions`` (label, bottom, retained) and
    ``members`` (node, label) merge the ends in one retained depression. Basins: (id, terminal, outlet, outlet_acc,
    n_cells, kind), by their largest accumulation inside, then by key; closed if retained or if the end is inside.
    Labels: (src, basin) with 1 to ``top``, 0 for others inside and 255 outside.
    """
    cells = ends if acc is None else ends.join(acc, "src")
    if callable(inside):
        cells = cells.withColumn("in", F.coalesce(inside(F.col("src")), F.lit(False)))
    else:
        cells = cells.join(inside.select("src", F.lit(True).alias("in")), "src", "left").withColumn("in", F.coalesce("in", F.lit(False)))
    if depressions is not None:
        cells = checkpointed(cells)
        kept = depressions.where("retained").select("label", "bottom")
        # Ends, not their cells, are looked up in the depressions.
        single = cells.select("terminal").distinct().join(members.select(F.col("node").alias("terminal"), "label"), "terminal")
        merged = checkpointed(single.join(kept, "label").select("terminal", "bottom", F.lit(True).alias("merged")))
        cells = cells.join(checked_broadcast(merged, LABEL_BYTES), "terminal", "left")
    else:
        cells = cells.withColumns({"bottom": F.lit(None).cast("long"), "merged": F.lit(None).cast("boolean")})
    # Retained depressions come after single ends where accumulations are equal.
    cells = checkpointed(cells.select("src", "acc", "in", F.coalesce("bottom", "terminal").alias("terminal"), F.coalesce("merged", F.lit(False)).alias("merged")))
    groups = cells.where("in").groupBy("merged", "terminal").agg(F.max(F.struct("acc", (-F.col("src")).alias("minus"))).alias("o"), F.count(F.lit(1)).alias("n_cells"))
    best = groups.orderBy(F.desc("o.acc"), "merged", "terminal").limit(top)
    first = best.select(F.row_number().over(Window.orderBy(F.desc("o.acc"), "merged", "terminal")).cast("long").alias("id"), "merged", "terminal", (-F.col("o.minus")).alias("outlet"), F.col("o.acc").alias("outlet_acc"), "n_cells")
    if callable(inside):
        basins = checkpointed(first.withColumn("end_in", inside(F.col("terminal"))))
    else:
        basins = checkpointed(first.join(inside.select(F.col("src").alias("terminal"), F.lit(True).alias("end_in")), "terminal", "left"))
    kind = F.when(F.col("merged") | F.coalesce("end_in", F.lit(False)), "cerrada").otherwise("abierta")
    labelled = cells.join(F.broadcast(basins.select("merged", "terminal", "id")), ["merged", "terminal"], "left")  # ``top`` rows
    basin = F.when(~F.col("in"), 255).otherwise(F.coalesce("id", F.lit(0))).cast("long")
    return basins.select("id", "terminal", "outlet", "outlet_acc", "n_cells", kind.alias("kind")), labelled.select("src", basin.alias("basin"))


def hops(cells: DataFrame, tile: int = TILE, max_rounds: int = 2000) -> DataFrame:
    """(i, j, label, hops): steps to eight neighbours of the same label from the cells that ``start``, for cells (i, j, label, start).

    Tiles are relaxed in rounds, as in filling; rounds are as many as tiles on a path.
    """
    first = F.when(F.col("start"), 0.0).otherwise(F.lit(math.inf))
    still = _settled(cells.select("i", "j", F.col("label").cast("double").alias("g"), first.alias("f")), _stepped, tile, max_rounds)
    steps = F.when(F.col("f") < math.inf, F.col("f")).otherwise(1 << 40)
    return still.select("i", "j", F.col("g").cast("long").alias("label"), steps.cast("long").alias("hops"))


def _stepped(g, f):
    import numpy as np

    label, own = g[1:-1, 1:-1], f[1:-1, 1:-1]
    n, w = own.shape
    parts = [(slice(b + 1, b + 1 + n), slice(a + 1, a + 1 + w)) for _, a, b in STEPS]
    apart = [np.where((g[p] == label) & (label >= 0), 1.0, np.inf) for p in parts]
    while True:
        new = own.copy()
        for p, far in zip(parts, apart):
            np.minimum(new, f[p] + far, out=new)
        if (new == own).all():
            return f
        own[:] = new


def routing(cells: DataFrame, filled: DataFrame, minimal: DataFrame, found: DataFrame, members: DataFrame, width: int, epsilon: float = 0.01, value: str = "h") -> DataFrame:
    """(i, j, z): the surface that water follows. Outside retained depressions the fill by ``epsilon``; inside the ground,
    raised by a small step for each cell of distance from the bottom, and kept below the brim.

    ``filled`` and ``minimal`` are fills (i, j, f) with and without epsilon, ``found`` depressions (label, n_cells,
    max_depth, bottom, retained), ``members`` (node, label). Distances go from tile to tile.
    """
    node = F.col("j") * width + F.col("i")
    kept = found.where("retained").select("label", "bottom", F.col("n_cells").alias("n"), F.least(F.lit(epsilon), F.lit(0.5) * F.col("max_depth") / F.col("n_cells")).alias("step"))
    brim = minimal.select(node.alias("bottom"), (F.col("f") - epsilon).alias("brim"))
    kept = checkpointed(kept.join(brim, "bottom"))
    total = found.agg(F.coalesce(F.sum("n_cells"), F.lit(0))).first()[0]
    inner = _looked_up(members.select("node", "label"), kept, total)
    j = F.floor(F.col("node") / width)
    reached = hops(inner.select((F.col("node") - j * width).alias("i"), j.alias("j"), "label", (F.col("node") == F.col("bottom")).alias("start")))
    low = _looked_up(reached, kept, total).select("i", "j", "hops", "step", "brim")
    on = _on_ground(cells, filled, value).join(low, ["i", "j"], "left")
    sunk = F.when(F.col("hops").isNotNull(), F.least(F.col(value).cast("double") + F.col("step") * F.col("hops"), F.col("brim")))
    return on.select("i", "j", F.coalesce(sunk, "f").cast("float").cast("double").alias("z"))
