"""Coordinates: Mercator metres, slippy pixels, raster cells. Everything is a Column expression.

A raster's integer (i, j) is a cell's centre; it covers [-0.5, size - 0.5], both ends included.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
MAX_LATITUDE = 85.0511287798066
TILE = 256
KM_PER_DEGREE = 111.0


def micro(x: Column) -> Column:
    """Millionths as a whole number, halves towards plus infinity."""
    return F.floor(x * 1e6 + 0.5).cast("long")


def half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity (-2.5 becomes -2)."""
    return F.floor(x + 0.5)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    lat = F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))
    return F.radians(lon) * EARTH_RADIUS, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * EARTH_RADIUS


def unmercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH_RADIUS), F.degrees(F.atan(F.sinh(y / EARTH_RADIUS)))


def pixel(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = TILE * 2.0**zoom
    return (lon + 180) / 360 * n, (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n


def unpixel(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    n = TILE * 2.0**zoom
    return x / n * 360 - 180, F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n))))


def metres_per_pixel(zoom: int) -> float:
    return 2 * math.pi * EARTH_RADIUS / (TILE * 2.0**zoom)


def pixel_of_mercator(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    n, around = TILE * 2.0**zoom, 2 * math.pi * EARTH_RADIUS
    return (x / around + 0.5) * n, (F.lit(0.5) - y / around) * n


def mercator_of_pixel(px: Column, py: Column, zoom: int) -> tuple[Column, Column]:
    n, around = TILE * 2.0**zoom, 2 * math.pi * EARTH_RADIUS
    return (px / n - 0.5) * around, (F.lit(0.5) - py / n) * around


def planar_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.hypot((lon2 - lon1) * KM_PER_DEGREE * F.cos(F.radians(lat1)), (lat2 - lat1) * KM_PER_DEGREE)


@dataclass(frozen=True)
class GridSpec:
    """A raster's georeference: where its first cell's corner lies and how large its cells are, in pixels of a zoom."""

    zoom: int
    origin_x: int
    origin_y: int
    width: int
    height: int
    scale: int = 1

    def of_pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        return (x - self.origin_x) / self.scale - 0.5, (y - self.origin_y) / self.scale - 0.5

    def to_pixel(self, i: Column, j: Column) -> tuple[Column, Column]:
        return (i + 0.5) * self.scale + self.origin_x, (j + 0.5) * self.scale + self.origin_y

    def of_lonlat(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return self.of_pixel(*pixel(lon, lat, self.zoom))

    def to_lonlat(self, i: Column, j: Column) -> tuple[Column, Column]:
        return unpixel(*self.to_pixel(i, j), self.zoom)

    def contains(self, i: Column, j: Column) -> Column:
        return i.between(-0.5, self.width - 0.5) & j.between(-0.5, self.height - 0.5)

    def coarser(self, factor: int) -> GridSpec:
        return GridSpec(self.zoom, self.origin_x, self.origin_y, -(-self.width // factor), -(-self.height // factor), self.scale * factor)

    def extent_pixels(self, zoom: int | None = None) -> tuple[float, float, float, float]:
        """Left, top, right and bottom in pixels of the grid's zoom, or of another."""
        k = 2.0 ** ((self.zoom if zoom is None else zoom) - self.zoom)
        return self.origin_x * k, self.origin_y * k, (self.origin_x + self.width * self.scale) * k, (self.origin_y + self.height * self.scale) * k

    def extent_degrees(self) -> tuple[float, float, float, float]:
        """West, south, east and north."""
        left, top, right, bottom = self.extent_pixels()
        n = TILE * 2.0**self.zoom
        lat = lambda y: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / n))))
        return left / n * 360 - 180, lat(bottom), right / n * 360 - 180, lat(top)

    def same_ground(self, other: GridSpec, tolerance: float = 0.5) -> bool:
        """Whether both cover the same ground, to half a pixel of the finer zoom."""
        zoom = max(self.zoom, other.zoom)
        return all(abs(a - b) <= tolerance for a, b in zip(self.extent_pixels(zoom), other.extent_pixels(zoom)))

    @property
    def centre(self) -> tuple[float, float]:
        return self.origin_x + self.width * self.scale / 2, self.origin_y + self.height * self.scale / 2

    @property
    def metres_per_cell(self) -> float:
        """On the ground at the centre's latitude, which stands for the whole raster."""
        lat = math.atan(math.sinh(math.pi * (1 - 2 * self.centre[1] / (TILE * 2.0**self.zoom))))
        return metres_per_pixel(self.zoom) * math.cos(lat) * self.scale

    @property
    def size_km(self) -> tuple[float, float]:
        return self.metres_per_cell / 1000 * self.width, self.metres_per_cell / 1000 * self.height

    def to_world(self, i: Column, j: Column) -> tuple[Column, Column]:
        """Kilometres east and south of the centre."""
        px, py = self.to_pixel(i, j)
        km = self.metres_per_cell / self.scale / 1000
        return (px - self.centre[0]) * km, (py - self.centre[1]) * km

    def of_world(self, x: Column, z: Column) -> tuple[Column, Column]:
        km = self.metres_per_cell / self.scale / 1000
        return self.of_pixel(x / km + self.centre[0], z / km + self.centre[1])

    def box_on(self, other: GridSpec, box: tuple[Column, Column, Column, Column]) -> list[Column]:
        """A box of cells (first and last, both included) as the covering cells of another grid of the same zoom."""
        half = F.lit(0.5)
        i0, j0 = other.of_pixel(*self.to_pixel(box[0] - half, box[1] - half))
        i1, j1 = other.of_pixel(*self.to_pixel(box[2] + half, box[3] + half))
        return [F.floor(i0 + half), F.floor(j0 + half), F.ceil(i1 - half), F.ceil(j1 - half)]

    def patch_on(self, base: GridSpec) -> tuple[float, float, float]:
        """(k, cx, cy): a cell g of this patch lies at (g + 0.5) * k + c of the base grid."""
        z = 2.0 ** (self.zoom - base.zoom)
        c = [(a - z * b) / (z * base.scale) - 0.5 for a, b in ((self.origin_x, base.origin_x), (self.origin_y, base.origin_y))]
        return self.scale / (z * base.scale), *c

    def rect_on(self, base: GridSpec) -> tuple[float, float, float, float]:
        k, cx, cy = self.patch_on(base)
        return cx, cy, self.width * k + cx, self.height * k + cy

    def centre_on(self, base: GridSpec) -> tuple[float, float]:
        k, cx, cy = self.patch_on(base)
        return self.width / 2 * k + cx, self.height / 2 * k + cy


def site_grids(fine: tuple, coarse: tuple) -> tuple[GridSpec, GridSpec, GridSpec, tuple[int, int, int, int]]:
    """Image, height and mosaic grids of tile ranges (zoom, x0, x1, y0, y1), and the heights' window in the mosaic.

    Raises ValueError for ranges out of order, zooms that do not divide a tile, and images beyond the mosaic.
    """
    for name, r in (("image", fine), ("heights", coarse)):
        if any(v != int(v) or v < 0 for v in r) or r[2] < r[1] or r[4] < r[3]:
            raise ValueError(f"{name}: invalid tile range {r}")
    factor = 2.0 ** (fine[0] - coarse[0])
    if factor < 1 or TILE % factor:
        raise ValueError(f"zoom {fine[0]} does not refine zoom {coarse[0]} by whole parts of a tile")
    of = lambda z, x0, x1, y0, y1: GridSpec(z, x0 * TILE, y0 * TILE, (x1 - x0 + 1) * TILE, (y1 - y0 + 1) * TILE)
    image, mosaic, f = of(*fine), of(*coarse), int(factor)
    heights = GridSpec(coarse[0], image.origin_x // f, image.origin_y // f, image.width // f, image.height // f)
    x, y = heights.origin_x - mosaic.origin_x, heights.origin_y - mosaic.origin_y
    if x < 0 or y < 0 or x + heights.width > mosaic.width or y + heights.height > mosaic.height:
        raise ValueError("the image is not covered by the heights' tiles")
    return image, heights, mosaic, (x, y, heights.width, heights.height)


def sdf_cell(i: Column, j: Column, size: tuple[int, int], sdf_size: tuple[int, int]) -> tuple[Column, Column]:
    """The same place on a distance raster of another size."""
    return (i + 0.5) * sdf_size[0] / size[0] - 0.5, (j + 0.5) * sdf_size[1] / size[1] - 0.5


@dataclass(frozen=True)
class Grids:
    """Grids in columns, one a row: zoom, first pixel, cells and pixels a cell."""

    zoom: Column
    origin_x: Column
    origin_y: Column
    width: Column
    height: Column
    scale: Column

    def coarser(self, factor: int) -> Grids:
        """The same first pixel with cells of ``factor`` times the side, as many as cover the grid."""
        cells = lambda c: F.ceil(c / factor)
        return Grids(self.zoom, self.origin_x, self.origin_y, cells(self.width), cells(self.height), self.scale * factor)

    def extent_pixels(self, zoom: Column | None = None) -> list[Column]:
        """Left, top, right and bottom in pixels of the grid's zoom, or of another."""
        k = F.pow(F.lit(2.0), (self.zoom if zoom is None else zoom) - self.zoom)
        return [c * k for c in (self.origin_x, self.origin_y, self.origin_x + self.width * self.scale, self.origin_y + self.height * self.scale)]

    def extent_degrees(self) -> list[Column]:
        """West, south, east and north."""
        left, top, right, bottom = self.extent_pixels()
        n = F.pow(F.lit(2.0), self.zoom) * TILE
        lon, lat = (lambda x: x / n * 360 - 180), (lambda y: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n)))))
        return [lon(left), lat(bottom), lon(right), lat(top)]

    def same_ground(self, other: Grids, tolerance: float = 0.5) -> Column:
        """Whether both cover the same ground, to half a pixel of the finer zoom."""
        zoom = F.greatest(self.zoom, other.zoom)
        out = F.lit(True)
        for a, b in zip(self.extent_pixels(zoom), other.extent_pixels(zoom)):
            out = out & (F.abs(a - b) <= tolerance)
        return out


def site_windows(fine: tuple[Column, ...], coarse: tuple[Column, ...]) -> dict[str, Column]:
    """What follows from tile ranges (zoom, x0, x1, y0, y1) of a site's image and heights: ``image``, ``heights`` and
    ``mosaic`` grids as structs, the heights' ``window`` in the mosaic, and ``problem``, null where there is none.
    """
    grid = lambda z, x, y, w, h: F.struct(z.alias("zoom"), x.cast("long").alias("x"), y.cast("long").alias("y"), w.cast("long").alias("width"), h.cast("long").alias("height"))
    of = lambda r: (r[1] * TILE, r[3] * TILE, (r[2] - r[1] + 1) * TILE, (r[4] - r[3] + 1) * TILE)
    bad = lambda r: (r[1] < 0) | (r[3] < 0) | (r[2] < r[1]) | (r[4] < r[3])
    step = fine[0] - coarse[0]
    # A tile's side is 2**8 pixels, so zooms up to eight apart divide it.
    apart = (step < 0) | (step > 8)
    factor = F.pow(F.lit(2.0), F.least(F.greatest(step, F.lit(0)), F.lit(8)))
    image, mosaic = of(fine), of(coarse)
    heights = [F.floor(c / factor) for c in image]
    x, y = heights[0] - mosaic[0], heights[1] - mosaic[1]
    beyond = (x < 0) | (y < 0) | (x + heights[2] > mosaic[2]) | (y + heights[3] > mosaic[3])
    problem = F.when(bad(fine) | bad(coarse), "invalid tile range").when(apart, "zooms do not divide a tile").when(beyond, "the image is not covered")
    return {"image": grid(fine[0], *image), "heights": grid(coarse[0], *heights), "mosaic": grid(coarse[0], *mosaic), "window": grid(F.lit(None).cast("int"), x, y, heights[2], heights[3]), "problem": problem}
