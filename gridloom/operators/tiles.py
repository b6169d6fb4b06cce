"""Neighbourhoods on a raster: square tiles with a rim of their neighbours' cells, as numpy blocks.

A cell goes to its own tile and, near a border, to those whose rim it is in: one shuffle, in which rows grow by the rim's
share. A task holds one tile, however long or wide the raster, and no window runs along a row or a column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256


class Block:
    """One tile: its own cells from (i0, j0), and ``halo`` cells around them; what a raster lacks is NaN."""

    def __init__(self, key: tuple, table: pa.Table, columns: list[str], tile: int, halo: int):
        i, j = (table.column(c).to_numpy() for c in ("i", "j"))
        own = (i // tile == key[0]) & (j // tile == key[1])
        self.empty = not own.any()
        if self.empty:
            return
        self.halo = halo
        self.i0, self.j0 = i[own].min(), j[own].min()
        self.width, self.height = int(i[own].max() - self.i0) + 1, int(j[own].max() - self.j0) + 1
        x, y = i - self.i0 + halo, j - self.j0 + halo
        near = (x >= 0) & (y >= 0) & (x < self.width + 2 * halo) & (y < self.height + 2 * halo)
        self.whole = {}
        for c in columns:
            block = np.full((self.height + 2 * halo, self.width + 2 * halo), np.nan)
            block[y[near], x[near]] = table.column(c).cast(pa.float64()).to_numpy()[near]
            self.whole[c] = block
        self.there = np.zeros((self.height, self.width), bool)
        self.there[y[own] - halo, x[own] - halo] = True

    def side(self, column: str, di: int, dj: int) -> np.ndarray:
        """What stands ``di`` to the east and ``dj`` to the south of each own cell."""
        a, b = self.halo + dj, self.halo + di
        return self.whole[column][a : a + self.height, b : b + self.width]


def _dealt(cells: DataFrame, columns: list[str], tile: int, halo: int) -> DataFrame:
    if not 0 <= halo <= tile:
        raise ValueError("a rim cannot be wider than a tile")
    side = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + d) / tile) for d in (-halo, 0, halo)]))
    return cells.select("i", "j", *columns, F.explode(side("i")).alias("ti")).select("i", "j", *columns, "ti", F.explode(side("j")).alias("tj"))


def tiled(cells: DataFrame, columns: list[str], work, out: str, halo: int = 1, tile: int = TILE) -> DataFrame:
    """(i, j, ``out``) of cells (i, j, columns): ``work`` gives arrays by name for a block's own cells, and may give ``keep``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"i long, j long, {out}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(key, table):
        b = Block(tuple(k.as_py() for k in key), table, columns, tile, halo)
        if b.empty:
            return arrow.empty_table()
        found = work(b)
        j, i = np.nonzero(b.there & found.pop("keep", True))
        data = {"i": i + b.i0, "j": j + b.j0} | {k: np.asarray(v)[j, i] for k, v in found.items()}
        return pa.table({f.name: pa.array(data[f.name]).cast(f.type) for f in arrow}, arrow)

    return _dealt(cells, columns, tile, halo).groupBy("ti", "tj").applyInArrow(run, schema)


BLOCKS = "ti long, tj long, i0 long, j0 long, width long, height long, low double, high double, data binary"


def blocks(cells: DataFrame, value: str, halo: int, tile: int) -> DataFrame:
    """Each tile as one row (BLOCKS): its first cell, size and cells, rim included as far as the raster goes.

    ``low`` and ``high`` are of its own cells and the next ones to the east and south, on which surfaces between its own
    cells rest. A missing cell fails.
    """

    def run(key, table):
        ti, tj = (k.as_py() for k in key)
        i, j = (table.column(c).to_numpy() for c in ("i", "j"))
        none = not ((i // tile == ti) & (j // tile == tj)).any()
        if none:
            return pa.table({f: pa.array([], t) for f, t in BLOCK_TYPES})
        i0, j0, w, h = i.min(), j.min(), int(i.max() - i.min()) + 1, int(j.max() - j.min()) + 1
        block = np.full((h, w), np.nan)
        v = table.column(value).cast(pa.float64()).to_numpy()
        block[j - j0, i - i0] = v
        if np.isnan(block).any():
            raise ValueError(f"tile {ti}, {tj} lacks cells")
        rests = (i >= ti * tile) & (i <= (ti + 1) * tile) & (j >= tj * tile) & (j <= (tj + 1) * tile)
        row = (ti, tj, i0, j0, w, h, v[rests].min(), v[rests].max(), block.tobytes())
        return pa.table({f: pa.array([x], t) for (f, t), x in zip(BLOCK_TYPES, row)})

    return _dealt(cells, [value], tile, halo).groupBy("ti", "tj").applyInArrow(run, BLOCKS)


BLOCK_TYPES = [(n, pa.int64()) for n in ("ti", "tj", "i0", "j0", "width", "height")] + [("low", pa.float64()), ("high", pa.float64()), ("data", pa.binary())]


def corners(cells: DataFrame, value: str, tile: int = TILE) -> DataFrame:
    """(i, j, tl, tr, bl, br): the values at the corners of each square of four cells."""

    def work(b: Block) -> dict:
        c = {n: b.side(value, di, dj) for n, di, dj in (("tl", 0, 0), ("tr", 1, 0), ("bl", 0, 1), ("br", 1, 1))}
        return c | {"keep": ~np.isnan(sum(c.values()))}

    return tiled(cells, [value], work, "tl double, tr double, bl double, br double", tile=tile)
