"""Raster operators on cells (i, j, value), one row each.

Neighbourhoods come from tiles with a rim of their neighbours' cells, or from shifted keys in one grouping, so a raster of
any size and shape spreads over its tiles.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import half_up
from gridloom.operators import tiles
from gridloom.operators.ranks import percentiles
from gridloom.plans.shared import stored


def crop(cells: DataFrame, x: int, y: int, width: int, height: int, size: tuple[int, int] | None = None) -> DataFrame:
    """The window's cells with (x, y) as the new origin; the filter reaches the scan.

    A window that leaves a raster of the given size (width, height) is an error.
    """
    if width < 1 or height < 1 or x < 0 or y < 0 or size and (x + width > size[0] or y + height > size[1]):
        raise ValueError(f"window {(x, y, width, height)} leaves the raster {size}")
    inside = F.col("i").between(x, x + width - 1) & F.col("j").between(y, y + height - 1)
    return cells.where(inside).withColumns({"i": F.col("i") - x, "j": F.col("j") - y})


def box_downsample(cells: DataFrame, factor: int, value: str = "h") -> DataFrame:
    """Mean of each block of cells; blocks at the edge average what they have."""
    block = [F.floor(F.col(c) / factor).alias(c) for c in ("i", "j")]
    return cells.groupBy(*block).agg(F.avg(value).alias(value))


def rgba_downsample(pixels: DataFrame, factor: int) -> DataFrame:
    """Each channel's mean over a block, rounded half up."""
    block = [F.floor(F.col(c) / factor).alias(c) for c in ("i", "j")]
    return pixels.groupBy(*block).agg(*[half_up(F.avg(c)).cast("long").alias(c) for c in "rgba"])


def plurality_downsample(cells: DataFrame, factor: int, value: str = "v") -> DataFrame:
    """Most frequent value of each block; ties prefer a value other than 0, then the lowest."""
    block = [F.floor(F.col(c) / factor).alias(c) for c in ("i", "j")]
    counts = cells.groupBy(*block, F.col(value)).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("i", "j").agg(F.max_by(value, F.struct("n", F.col(value) != 0, -F.col(value))).alias(value))


def elevation_stats(cells: DataFrame, value: str = "h") -> DataFrame:
    low, high = percentiles(cells, F.col(value), [0.001, 0.999])
    return cells.agg(F.min(value).alias("min_h"), F.max(value).alias("max_h"), F.avg(value).alias("mean_h"), F.lit(low).cast("double").alias("p001"), F.lit(high).cast("double").alias("p999"))


def bilinear(points: DataFrame, cells: DataFrame, width: int, height: int, value: str = "h") -> DataFrame:
    """Add ``sample`` to points (i, j): weighted sum of four cells, clamped to the border.

    A point becomes four keyed rows that meet their cells in an equi join.
    """
    clamp = lambda x, n: F.least(F.greatest(x, F.lit(0)), F.lit(n - 1))
    x, y = clamp(F.col("i"), width), clamp(F.col("j"), height)
    i0, j0 = F.floor(x), F.floor(y)
    fx, fy = x - i0, y - j0
    corner = lambda di, dj, w: F.struct(F.least(i0 + di, F.lit(width - 1)).cast("long").alias("ci"), F.least(j0 + dj, F.lit(height - 1)).cast("long").alias("cj"), w.alias("w"))
    corners = F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(1, 0, fx * (1 - fy)), corner(0, 1, (1 - fx) * fy), corner(1, 1, fx * fy))
    keyed = points.select(*points.columns, F.explode(corners).alias("c"))
    c = cells.select(F.col("i").alias("ci"), F.col("j").alias("cj"), F.col(value).alias("cv"))
    met = keyed.select(*points.columns, "c.*").join(c, ["ci", "cj"])
    return met.groupBy(*points.columns).agg(F.sum(F.col("w") * F.col("cv")).alias("sample"))


def reconstruction_error(cells: DataFrame, width: int, height: int, factor: int = 2, limit: float = 20.0, value: str = "h") -> DataFrame:
    """How far the raster is from the bilinear reading of its own downsampled version."""
    half = box_downsample(cells, factor, value)
    at = cells.select(F.col("i").alias("fi"), F.col("j").alias("fj"), F.col(value).alias("full"), ((F.col("i") + 0.5) / factor - 0.5).alias("i"), ((F.col("j") + 0.5) / factor - 0.5).alias("j"))
    e = bilinear(at, half, -(-width // factor), -(-height // factor), value).select(F.abs(F.col("full") - F.col("sample")).alias("e"))
    e = stored(e)
    p99 = percentiles(e, F.col("e"), [0.99])[0]
    return e.agg(F.max("e").alias("max_e"), F.avg("e").alias("mean_e"), F.lit(p99).cast("double").alias("p99_e"), F.avg((F.col("e") > limit).cast("double")).alias("share"))


def numbered(cells: DataFrame) -> DataFrame:
    """Cells with ``idx`` from 0 in row-major order: places in a row, after the cells of all rows before it.

    Only the rows' counts meet in one task.
    """
    counts = cells.groupBy("j").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("j", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("j").orderBy("i")) - 1
    return cells.withColumn("place", place).join(bases, "j").withColumn("idx", F.col("base") + F.col("place")).drop("place", "base")


def hillshade(cells: DataFrame, cell_size: float, azimuth: float = 315.0, altitude: float = 45.0, value: str = "h", tile: int = tiles.TILE) -> DataFrame:
    """Horn's 3 x 3 shading, 0 to 255; neighbours beyond the edge are the edge's own."""
    az, alt = math.radians(azimuth), math.radians(altitude)
    lx, ly, lz = math.sin(az) * math.cos(alt), -math.cos(az) * math.cos(alt), math.sin(alt)

    def work(b: tiles.Block) -> dict:
        v = b.whole[value]
        mid = v[:, 1:-1]
        west, east = (np.where(np.isnan(x), mid, x) for x in (v[:, :-2], v[:, 2:]))
        dx, sx = east - west, west + 2 * mid + east
        own = lambda x, k: np.where(np.isnan(x[k : k + b.height]), x[1:-1], x[k : k + b.height])
        p = (own(dx, 0) + 2 * dx[1:-1] + own(dx, 2)) / (8 * cell_size)
        q = (own(sx, 2) - own(sx, 0)) / (8 * cell_size)
        light = (lz - p * lx - q * ly) / np.sqrt(p**2 + q**2 + 1)
        return {"shade": np.floor(np.nan_to_num(np.clip(light, 0, 1)) * 255 + 0.5).astype(np.int64)}

    return tiles.tiled(cells, [value], work, "shade long", tile=tile)


def borders(cells: DataFrame, value: str = "v", tile: int = tiles.TILE) -> DataFrame:
    """Cells whose east or south neighbour has another value."""

    def work(b: tiles.Block) -> dict:
        own = b.side(value, 0, 0)
        differs = {n: ~np.isnan(x := b.side(value, *to)) & (x != own) for n, to in (("east", (1, 0)), ("south", (0, 1)))}
        return differs | {"keep": differs["east"] | differs["south"]}

    return tiles.tiled(cells, [value], work, "east boolean, south boolean", tile=tile)


def bounds(cells: DataFrame, inside: Column) -> DataFrame:
    return cells.where(inside).agg(F.min("i").alias("min_i"), F.min("j").alias("min_j"), F.max("i").alias("max_i"), F.max("j").alias("max_j"))


def int16(value: Column) -> Column:
    """Rounded half up and kept within 16 bits."""
    return F.greatest(F.least(half_up(value), F.lit(32767)), F.lit(-32768)).cast("long")


def log_code(acc: Column) -> Column:
    return F.when(acc <= 1, F.lit(0)).otherwise(half_up(F.log2(acc.cast("double")) * 256)).cast("long")


def log_decode(code: Column) -> Column:
    return F.pow(F.lit(2.0), code / 256)


def rasterize(edges: DataFrame) -> DataFrame:
    """Cells inside polygons, by even-odd scan lines through cell centres.

    ``edges``: (ord, poly, x1, y1, x2, y2) in cell coordinates. A row is crossed where y1 <= j < y2; cells run
    from the first crossing, rounded up, to the one before the second. Where polygons overlap, the largest ord
    stays. Edges become crossings by an explode over their rows: no join at all.
    """
    top, bottom = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(top), F.ceil(bottom) - 1
    rows = edges.where(first <= last).select("ord", "poly", "x1", "y1", "x2", "y2", F.explode(F.sequence(first, last)).alias("j"))
    x = F.col("x1") + (F.col("j") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    line = Window.partitionBy("ord", "poly", "j").orderBy("x")
    crossings = rows.select("ord", "poly", "j", x.alias("x")).withColumns({"n": F.row_number().over(line), "next": F.lead("x").over(line)})
    start, end = F.ceil("x"), F.ceil("next") - 1
    spans = crossings.where((F.col("n") % 2 == 1) & (start <= end)).select("ord", "j", F.explode(F.sequence(start, end)).alias("i"))
    return spans.groupBy("i", "j").agg(F.max("ord").alias("v"))


def contour_segments(cells: DataFrame, value: str = "s") -> DataFrame:
    """Marching-squares case (1 to 14) of every square that the zero line crosses; at or above zero is inside.

    Bits: 1 own cell, 2 east, 4 south-east, 8 south.
    """
    bit = lambda c, k: F.when(F.col(c) >= 0, k).otherwise(0)
    code = (bit("tl", 1) + bit("tr", 2) + bit("br", 4) + bit("bl", 8)).cast("long")
    return tiles.corners(cells, value).select("i", "j", code.alias("code")).where("code between 1 and 14")


def signed_distance(cells: DataFrame, inside: str = "inside", clamp: int = 127, tile: int = tiles.TILE) -> DataFrame:
    """Rounded distance to the nearest cell of the other kind, negative outside, kept within the clamp.

    Exact: what lies beyond the clamp cannot tell, so a tile with a rim of so many cells knows all that counts. Gaps along
    columns are carried down and up in whole rows, then the least of squares is taken over as many steps to each side.
    """
    tile = max(tile, clamp)

    def work(b: tiles.Block) -> dict:
        v = b.whole[inside]
        own = v[clamp : clamp + b.height, clamp : clamp + b.width] == 1
        squares = [_nearest(v == kind, clamp, b) for kind in (0, 1)]
        d = np.sqrt(np.where(own, *squares))
        return {"s": np.clip(np.floor(np.where(own, d, -d) + 0.5), -clamp, clamp).astype(np.int64)}

    return tiles.tiled(cells, [inside], work, "s long", halo=clamp, tile=tile)


def _nearest(there: np.ndarray, reach: int, b: tiles.Block) -> np.ndarray:
    """For each own cell the square of its distance to the nearest one of ``there``, if that is at most ``reach`` away on either axis."""
    rows = np.arange(len(there))[:, None]
    above = np.maximum.accumulate(np.where(there, rows, -(10**6)), 0)
    below = np.minimum.accumulate(np.where(there, rows, 10**6)[::-1], 0)[::-1]
    gap = np.minimum(rows - above, below - rows)[reach : reach + b.height].astype(float) ** 2
    best = np.full((b.height, b.width), float(10**12))
    for k in range(2 * reach + 1):
        np.minimum(best, gap[:, k : k + b.width] + float((k - reach) ** 2), out=best)
    return best
