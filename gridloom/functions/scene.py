"""Expressions of a drawn scene: blends, the sun's colours, flattened surroundings, projection, budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Heights of the block below a relief (km), and how much the surroundings are flattened.
SKIRT_KM, LIFT_KM, FLATTEN = 10.0, 0.6, 0.2
#: Red, green and blue of light.
WARM_SUN, WHITE = (1.0, 0.38, 0.1), (1.0, 1.0, 1.0)
NIGHT_AIR, DAY_AIR = (0.05, 0.08, 0.15), (0.42, 0.42, 0.44)
NIGHT_SKY, WARM_SKY = (0.12, 0.16, 0.28), (1.0, 0.68, 0.42)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = clamp((x - low) / (high - low), 0, 1)
    return t * t * (3 - 2 * t)


def lerp(a, b, t: Column) -> Column:
    return a + (b - a) * t


def angle_lerp(a: Column, b: Column, t: Column) -> Column:
    """Between two headings in degrees, the short way round; the remainder keeps the sign of what is divided."""
    return a + (((b - a + 540) % 360) - 180) * t


def ease(t: Column) -> Column:
    """Slow at both ends, by cubes."""
    return F.when(t < 0.5, 4 * t * t * t).otherwise(1 - F.pow(2 - 2 * t, F.lit(3)) / 2)


def direction(azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    """A unit vector east, up and south."""
    az, el = F.radians(azimuth), F.radians(elevation)
    return F.sin(az) * F.cos(el), F.sin(el), -F.cos(az) * F.cos(el)


def angle_between(a: tuple, b: tuple) -> Column:
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return F.degrees(F.acos(clamp(dot, -1, 1)))


def sun_colour(elevation: Column) -> list[Column]:
    strength, white = smoothstep(-1, 5, elevation), smoothstep(-1, 35, elevation)
    return [lerp(F.lit(a), b, white) * strength for a, b in zip(WARM_SUN, WHITE)]


def air_colour(elevation: Column) -> list[Column]:
    day = smoothstep(-6, 4, elevation)
    return [lerp(F.lit(a), b, day) for a, b in zip(NIGHT_AIR, DAY_AIR)]


def sky_colour(elevation: Column) -> list[Column]:
    warmth, day = (1 - smoothstep(-2, 28, elevation)) * 0.8, smoothstep(-8, -1, elevation)
    return [lerp(F.lit(n), lerp(F.lit(1.0), w, warmth), day) for n, w in zip(NIGHT_SKY, WARM_SKY)]


def look(azimuth: Column, elevation: Column, light: float = 0.85, ambient: float = 0.42) -> Column:
    """Everything about the sun that a scene needs, as one struct."""
    d = direction(azimuth, elevation)
    return F.struct(
        F.array(*d).alias("direction"),
        F.array(*[c * light for c in sun_colour(elevation)]).alias("sun"),
        F.array(*[c * (ambient / 0.42) for c in air_colour(elevation)]).alias("air"),
        F.array(*sky_colour(elevation)).alias("sky"),
        elevation.alias("elevation"),
        azimuth.alias("azimuth"),
    )


def base_plane_km(least: float, exaggeration: float) -> float:
    return least / 1000 * exaggeration - SKIRT_KM


def flat_world_y(y: Column, least: float, exaggeration: float) -> Column:
    return base_plane_km(least, exaggeration) + LIFT_KM + y * FLATTEN


def flat_metres(metres: Column, least: float, exaggeration: float) -> Column:
    return (base_plane_km(least, exaggeration) + LIFT_KM) * 1000 / exaggeration + metres * FLATTEN


def flat_margin(least: float, exaggeration: float) -> float:
    """How far below the relief's lowest point the flattened surroundings may lie."""
    return max(0.0, least - ((base_plane_km(least, exaggeration) + LIFT_KM) * 1000 / exaggeration + least * FLATTEN))


def drawn_metres(metres: Column, sdf: Column, least: float, exaggeration: float) -> Column:
    """Inside (distance at least 0) as it is, flattened outside."""
    return F.when(sdf >= 0, metres).otherwise(flat_metres(metres, least, exaggeration))


def wall_tops(metres: Column, least: float, exaggeration: float) -> tuple[Column, Column]:
    """Of the cut wall and of the rim's (km)."""
    cut = metres / 1000 * exaggeration
    return cut, flat_world_y(cut, least, exaggeration)


def zoom_distance(now: Column, spread: Column, target: float = 66.0, least: float = 12.0) -> Column:
    """How near to go so that a cluster spreads over ``target`` pixels; never farther than now."""
    wanted = now * spread / max(1.0, target)
    return F.when(~(now > 0) | now.isNull(), F.lit(least)).when(~(spread > 0) | spread.isNull(), now).otherwise(F.least(now, F.greatest(F.lit(least), wanted)))


def projected(m: list[float], x: Column, y: Column, z: Column, width: float, height: float) -> tuple[Column, Column]:
    """Screen place of a point by a column-major 4 x 4 matrix; null behind the eye."""
    row = lambda r: m[r] * x + m[4 + r] * y + m[8 + r] * z + m[12 + r]
    w = row(3)
    return F.when(w > 0, (row(0) / w + 1) / 2 * width), F.when(w > 0, (1 - row(1) / w) / 2 * height)


def on_screen(x: Column, y: Column, width: float, height: float, margin: float = 24.0) -> Column:
    """Before the eye and in the viewport, or at most the margin beyond it."""
    return F.coalesce(x.between(-margin, width + margin) & y.between(-margin, height + margin), F.lit(False))


def in_frustum(m: list[float], x: Column, z: Column, half_x: Column, half_z: Column, low: Column, high: Column) -> Column:
    """Whether no single plane of the view has all eight corners of a box behind it."""
    row = lambda r: [m[r], m[4 + r], m[8 + r], m[12 + r]]
    add = lambda a, b, s: [p + s * q for p, q in zip(a, b)]
    w = row(3)
    planes = [add(w, row(0), 1), add(w, row(0), -1), add(w, row(1), 1), add(w, row(1), -1), row(2), add(w, row(2), -1)]
    corners = [(x + sx * half_x, y, z + sz * half_z) for sx in (-1, 1) for y in (low, high) for sz in (-1, 1)]
    seen = F.lit(True)
    for a, b, c, d in planes:
        # The farthest corner along the plane decides.
        seen = seen & (F.greatest(*[a * p + b * q + c * r + d for p, q, r in corners]) >= 0)
    return seen


def within(x: Column, z: Column, cx: Column, cz: Column, distance: float) -> Column:
    return F.hypot(x - cx, z - cz) < distance


def mip_levels(width: Column, height: Column) -> Column:
    return (F.floor(F.log2(F.greatest(width, height).cast("double"))) + 1).cast("long")


def texture_bytes(width: Column, height: Column, per_pixel: int = 4) -> Column:
    """All levels, each half the one before and one pixel at least."""
    half = lambda n, k: F.greatest(F.lit(1).cast("long"), F.shiftright(n.cast("long"), k))
    levels = F.sequence(F.lit(0), (mip_levels(width, height) - 1).cast("int"))
    sizes = F.transform(levels, lambda k: F.greatest(F.lit(1).cast("long"), F.floor(width / F.pow(F.lit(2.0), k)).cast("long")) * F.greatest(F.lit(1).cast("long"), F.floor(height / F.pow(F.lit(2.0), k)).cast("long")) * per_pixel)
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b)


def haze_range(size_km: Column, near: float = 1.6, far: float = 2.6) -> tuple[Column, Column]:
    return size_km * near, size_km * far


def sample_count(metres: Column, cell: Column) -> Column:
    """Two samples a cell, 96 to 2048; 96 where there is no length."""
    n = F.least(F.greatest(F.ceil(metres / (cell * 0.5)) + 1, F.lit(96)), F.lit(2048))
    return F.when((metres > 0) & (cell > 0), n).otherwise(F.lit(96)).cast("long")
