"""What is seen of a relief: rays, lines of sight, shadows, normals, drawn meshes, coarser levels."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import GridSpec
from gridloom.functions.scene import smoothstep
from gridloom.operators import tiles
from gridloom.operators.raster import bilinear, box_downsample
from gridloom.plans.shared import checked_broadcast, stored


def clipped(low: tuple, high: tuple) -> tuple[Column, Column]:
    """(enter, leave) of rays (ox, oy, oz, dx, dy, dz) in a box; null where they miss it or it lies behind."""
    enter, leave, misses = F.lit(-math.inf), F.lit(math.inf), F.lit(False)
    for axis, a, b in zip("xyz", low, high):
        o, d = F.col(f"o{axis}"), F.col(f"d{axis}")
        flat = F.abs(d) < 1e-12
        misses = misses | (flat & ((o < a) | (o > b)))
        safe = F.when(flat, F.lit(1.0)).otherwise(d)
        ta, tb = (F.lit(float(a)) - o) / safe, (F.lit(float(b)) - o) / safe
        enter = F.when(flat, enter).otherwise(F.greatest(enter, F.least(ta, tb)))
        leave = F.when(flat, leave).otherwise(F.least(leave, F.greatest(ta, tb)))
    hit = ~misses & (leave >= enter) & (leave >= 0)
    return F.when(hit, F.greatest(enter, F.lit(0.0))), F.when(hit, leave)


#: Cells of a leaf's side, nodes of a level's side that one above holds, and rays that meet a leaf's cells together.
LEAF, FAN, RAYS = 64, 4, 4096
#: Rays of a task that descend the pyramid, and steps of a task: rows are small there and work is not, so tasks follow the work.
TASK_RAYS, TASK_STEPS = 1 << 15, 1 << 20
RAY = ["ray", "ox", "oy", "oz", "dx", "dy", "dz"]


def pyramid(leaves: DataFrame, tiles_wide: int, tiles_high: int) -> list[DataFrame]:
    """(a, b, low, high) of the leaves' heights, and of FAN x FAN nodes of each level below, up to a single one."""
    levels = [leaves.select(F.col("ti").alias("a"), F.col("tj").alias("b"), "low", "high")]
    while max(tiles_wide, tiles_high) > 1:
        up = levels[-1].groupBy(F.floor(F.col("a") / FAN).alias("a"), F.floor(F.col("b") / FAN).alias("b"))
        levels.append(stored(up.agg(F.min("low").alias("low"), F.max("high").alias("high"))))
        tiles_wide, tiles_high = -(-tiles_wide // FAN), -(-tiles_high // FAN)
    return levels


def first_hits(rays: DataFrame, cells: DataFrame, spec: GridSpec, exaggeration: float, step_cells: float = 0.5, refine_metres: float = 1.0, max_steps: int = 20_000, value: str = "h", leaf: int = LEAF) -> DataFrame:
    """(ray, t, x, y, z, i, j): where rays (ray, ox, oy, oz, dx, dy, dz; km, unit directions) first meet the relief.

    Rays that miss are left out. A ray is looked at in steps inside the relief's box; the first change of side brackets
    the hit, and brackets are halved until they are short. The steps come from a pyramid of least and greatest heights: it
    is descended level by level, only where a ray's heights over a node meet the node's, since a ray that is above or below
    all of a node cannot change sides there. Steps are taken inside the leaves that are left, each a block of cells that
    RAYS rays share, so rows follow the nodes that rays meet. A leaf that most rays meet is as many rows as its
    rays need, each of which may go to another task. A column ``until`` of rays says up to which t hits are wanted; a
    later one may be left out.
    """
    if exaggeration <= 0 or step_cells <= 0:
        raise ValueError("exaggeration and step must be positive")
    km, width, height = spec.metres_per_cell / 1000, spec.width, spec.height
    leaves = stored(tiles.blocks(cells, value, math.ceil(step_cells) + 2, leaf))
    levels = pyramid(leaves, -(-width // leaf), -(-height // leaf))
    low, high = leaves.agg(F.min("low"), F.max("high")).first()
    half = (width * km / 2, height * km / 2)
    enter, leave = clipped((-half[0], low / 1000 * exaggeration, -half[1]), (half[0], high / 1000 * exaggeration, half[1]))
    flat = F.hypot("dx", "dz")
    inside = rays.select(*RAY, *(["until"] if "until" in rays.columns else [])).withColumns({"t0": enter, "t1": leave}).where("t0 is not null").withColumn("step", F.when(flat > 1e-9, km * step_cells / flat).otherwise(F.col("t1") - F.col("t0")))
    steps = F.least(F.when(F.col("step") > 0, F.ceil((F.col("t1") - F.col("t0")) / F.col("step"))).otherwise(0), F.lit(max_steps)).cast("int")
    if "until" in rays.columns:
        steps = F.least(steps, F.when(F.col("step") > 0, F.ceil((F.col("until") - F.col("t0")) / F.col("step"))).otherwise(0)).cast("int")
    # The end of the way that is looked at.
    end = F.when(F.col("step") > 0, F.least("t1", F.col("t0") + F.col("steps") * F.col("step"))).otherwise(F.col("t1"))
    parallel = 2 * cells.sparkSession.sparkContext.defaultParallelism
    top = len(levels) - 1
    # Written twice: else every level's conditions would hold the expressions of the box again, and those of the steps.
    inside = stored(inside.repartition(max(parallel, -(-rays.count() // TASK_RAYS)), "ray"))
    at = stored(inside.withColumn("steps", steps).where("steps >= 0").select(*RAY, "t0", "t1", "step", "steps", end.alias("te"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    for level in range(top, -1, -1):
        if level < top:
            fan = F.sequence(F.lit(0), F.lit(FAN - 1))
            at = at.withColumn("da", F.explode(fan)).withColumn("db", F.explode(fan)).withColumns({"a": F.col("a") * FAN + F.col("da"), "b": F.col("b") * FAN + F.col("db")}).drop("da", "db")
        at = _crossing(at, leaf * FAN**level, spec, km)
        near = at.join(checked_broadcast(levels[level], 64), ["a", "b"])
        heights = [F.col("oy") + F.col("dy") * F.col(t) for t in ("ta", "tb")]
        scaled = lambda c: F.col(c) / 1000 * exaggeration
        at = near.where((F.least(*heights) <= scaled("high") + 1e-9) & (F.greatest(*heights) >= scaled("low") - 1e-9)).drop("low", "high")
    first = F.when(F.col("step") > 0, F.floor((F.col("ta") - F.col("t0")) / F.col("step"))).otherwise(0)
    last = F.when(F.col("step") > 0, F.ceil((F.col("tb") - F.col("t0")) / F.col("step"))).otherwise(0)
    spans = at.select(*RAY, "t0", "t1", "step", F.greatest(first, F.lit(0)).cast("int").alias("s0"), F.least(last, F.col("steps")).cast("int").alias("s1"), F.col("a").alias("ti"), F.col("b").alias("tj")).where("s0 <= s1")
    spans = stored(spans)
    many = stored(spans.groupBy("ti", "tj").agg(F.ceil(F.count(F.lit(1)) / RAYS).cast("long").alias("parts"), F.sum(F.col("s1") - F.col("s0") + 1).alias("n")))
    tasks = max(parallel, -(-(many.agg(F.sum("n")).first()[0] or 0) // TASK_STEPS))
    many, key = many.drop("n"), ["ti", "tj", "part"]
    dealt = spans.join(checked_broadcast(many, 64), ["ti", "tj"]).withColumn("part", F.pmod(F.xxhash64("ray"), F.col("parts")))
    taken = dealt.repartition(tasks, *key).groupBy(*key).agg(F.collect_list(F.struct(*RAY, "t0", "t1", "step", "s0", "s1")).alias("rays"))
    shared = leaves.join(many, ["ti", "tj"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = taken.join(shared.repartition(tasks, *key), key).select("rays", "i0", "j0", "width", "height", "data")
    ray_type = rays.schema["ray"].dataType.simpleString()
    hits = met.mapInArrow(_marched(spec, exaggeration, refine_metres / 1000), f"ray {ray_type}, s int, t double, x double, y double, z double, i double, j double")
    return hits.groupBy("ray").agg(F.min_by(F.struct("t", "x", "y", "z", "i", "j"), F.struct("s", "t")).alias("m")).select("ray", "m.*")


def _crossing(at: DataFrame, size: int, spec: GridSpec, km: float) -> DataFrame:
    """Rays over a node (a, b) of so many cells' side: those that cross it, with the way (ta, tb) on which they do."""
    ta, tb, misses = F.col("t0"), F.col("te"), F.lit(False)
    for n, o, d, cells_ in (("a", "ox", "dx", spec.width), ("b", "oz", "dz", spec.height)):
        edge = lambda c: (c - (cells_ - 1) / 2) * km  # noqa: B023, E731
        # The outermost nodes reach to the raster's edge, half a cell beyond its last centre.
        low, high = edge(F.when(F.col(n) == 0, F.lit(-1.0)).otherwise(F.col(n) * float(size))), edge(F.least((F.col(n) + 1) * float(size), F.lit(float(cells_))))
        still = F.abs(F.col(d)) < 1e-12
        misses = misses | (still & ((F.col(o) < low) | (F.col(o) > high)))
        safe = F.when(still, F.lit(1.0)).otherwise(F.col(d))
        p, q = (low - F.col(o)) / safe, (high - F.col(o)) / safe
        ta, tb = F.when(still, ta).otherwise(F.greatest(ta, F.least(p, q))), F.when(still, tb).otherwise(F.least(tb, F.greatest(p, q)))
    return at.withColumns({"ta": ta, "tb": tb}).where(~misses & (F.col("ta") <= F.col("tb")))


def _marched(spec: GridSpec, exaggeration: float, refine_km: float):
    """Rays over a leaf's cells -> the first change of side of each, halved until it is short."""
    km, width, height = spec.metres_per_cell / 1000, spec.width, spec.height

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                i0, j0, w, h = (batch.column(k)[r].as_py() for k in range(1, 5))
                ground = np.frombuffer(batch.column(5)[r].as_py()).reshape(h, w)
                yield _first_in(batch.column(0)[r].values, ground, i0, j0)

    def _first_in(rays: pa.StructArray, ground: np.ndarray, i0: int, j0: int) -> pa.RecordBatch:
        c = {f.name: rays.field(f.name).to_numpy(zero_copy_only=False) for f in rays.type}
        n = c["s1"] - c["s0"] + 1
        ray = np.repeat(np.arange(len(n)), n)
        s = np.arange(len(ray)) - np.repeat(np.cumsum(n) - n, n) + c["s0"][ray]

        def surface(k: np.ndarray, t: np.ndarray):
            x, z = c["ox"][k] + c["dx"][k] * t, c["oz"][k] + c["dz"][k] * t
            i, j = x / km + (width - 1) / 2, z / km + (height - 1) / 2
            u, v = np.clip(i, 0, width - 1), np.clip(j, 0, height - 1)
            a, b = np.floor(u).astype(int), np.floor(v).astype(int)
            fx, fy = u - a, v - b
            a2, b2 = np.minimum(a + 1, width - 1) - i0, np.minimum(b + 1, height - 1) - j0
            a, b = a - i0, b - j0
            sample = (1 - fx) * (1 - fy) * ground[b, a] + fx * (1 - fy) * ground[b, a2] + (1 - fx) * fy * ground[b2, a] + fx * fy * ground[b2, a2]
            return x, sample / 1000 * exaggeration, z, i, j

        def above(k: np.ndarray, t: np.ndarray) -> np.ndarray:
            return c["oy"][k] + c["dy"][k] * t - surface(k, t)[1]

        t = np.minimum(c["t0"][ray] + s * c["step"][ray], c["t1"][ray])
        f = above(ray, t)
        turns = f == 0
        turns[1:] |= (ray[1:] == ray[:-1]) & (np.sign(f[1:]) * np.sign(f[:-1]) < 0)
        at = np.flatnonzero(turns)
        k, place = np.unique(ray[at], return_index=True)
        at = at[place]
        exact = f[at] == 0
        lo, hi, side = np.where(exact, t[at], t[at - 1]), t[at], np.sign(f[at - 1])
        longest = np.maximum(np.hypot(c["dx"][k], c["dz"][k]), np.abs(c["dy"][k]))
        for _ in range(64):
            wide = np.flatnonzero((hi - lo) * longest > refine_km)
            if not len(wide):
                break
            mid = (lo[wide] + hi[wide]) / 2
            m = np.sign(above(k[wide], mid))
            same = m == side[wide]
            lo[wide], hi[wide] = np.where(same | (m == 0), mid, lo[wide]), np.where(same, hi[wide], mid)
        t = (lo + hi) / 2
        x, y, z, i, j = surface(k, t)
        return pa.RecordBatch.from_arrays([rays.field("ray").take(pa.array(k)), pa.array(s[at].astype(np.int32)), *[pa.array(v) for v in (t, x, y, z, i, j)]], names=["ray", "s", "t", "x", "y", "z", "i", "j"])

    return run


def occluded(markers: DataFrame, eye: tuple[float, float, float], cells: DataFrame, spec: GridSpec, exaggeration: float) -> DataFrame:
    """(m, hidden) of markers (m, x, y, z): whether the relief stands before them, with a tolerance of 50 m or a fiftieth."""
    away = [F.col(a) - e for a, e in zip("xyz", eye)]
    far = F.sqrt(away[0] ** 2 + away[1] ** 2 + away[2] ** 2)
    aimed = markers.withColumn("far", far)
    # What lies behind a marker does not hide it.
    rays = aimed.where("far > 0").select(F.col("m").alias("ray"), F.col("far").alias("until"), *[F.lit(float(e)).alias(f"o{a}") for a, e in zip("xyz", eye)], *[(v / F.when(F.col("far") > 0, F.col("far"))).alias(f"d{a}") for a, v in zip("xyz", away)])
    hits = first_hits(rays, cells, spec, exaggeration).select(F.col("ray").alias("m"), F.sqrt((F.col("x") - eye[0]) ** 2 + (F.col("y") - eye[1]) ** 2 + (F.col("z") - eye[2]) ** 2).alias("hit"))
    near = F.col("hit") < F.col("far") - F.greatest(F.lit(0.05), F.col("far") * 0.02)
    return aimed.join(hits, "m", "left").select("m", F.coalesce(near, F.lit(False)).alias("hidden"))


def shadows(cells: DataFrame, width: int, height: int, cell_km: float, sun: tuple[float, float, float], exaggeration: float = 1.0, steps: int = 64, step_km: float = 0.1, growth: float = 0.05, max_km: float = 90.0, penumbra: float = 8.0, bias_km: float = 0.01, tile: int = 256, value: str = "h") -> DataFrame:
    """(i, j, lit) from 0 to 1: how much of the sun reaches each cell past what stands towards it.

    ``sun``: a unit vector east, up, south. From every cell a ray goes towards it in growing steps; the least clearance
    for its distance counts, softened by ``penumbra``. Tiles are worked on by themselves: each gets the cells that
    its rays can reach, which lie on the sun's side only.
    """
    import numpy as np
    import pandas as pd

    flat = math.hypot(sun[0], sun[2])
    if sun[1] <= 0 or flat < 1e-5:
        return cells.select("i", "j", F.lit(0.0 if sun[1] <= 0 else 1.0).alias("lit"))
    stops, t = [], step_km
    for s in range(steps):
        if t > max_km:
            break
        stops.append(t)
        t += step_km * (1 + growth * s)
    reach = max(stops, default=0.0) / cell_km
    ux, uz, slope = sun[0] / flat, sun[2] / flat, sun[1] / flat
    spread = lambda c, u: F.sequence(F.floor((F.col(c) - (max(u, 0) * reach + 2)) / tile), F.floor((F.col(c) + (max(-u, 0) * reach + 2)) / tile))
    last = (F.lit((width - 1) // tile), F.lit((height - 1) // tile))
    dealt = cells.select("i", "j", F.col(value).cast("double").alias("h"), F.explode(spread("i", ux)).alias("ti"), spread("j", uz).alias("tjs")).select("i", "j", "h", "ti", F.explode("tjs").alias("tj"))
    dealt = dealt.where(F.col("ti").between(F.lit(0), last[0]) & F.col("tj").between(F.lit(0), last[1]))

    def march(key, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        i0, j0 = i.min(), j.min()
        ground = np.zeros((j.max() - j0 + 1, i.max() - i0 + 1))
        ground[j - j0, i - i0] = pdf["h"].to_numpy() / 1000 * exaggeration
        own = (i // tile == key[0]) & (j // tile == key[1])
        ci, cj = i[own].astype(float), j[own].astype(float)
        start, lit, active = ground[j[own] - j0, i[own] - i0] + bias_km, np.ones(own.sum()), np.ones(own.sum(), bool)
        for t in stops:
            pi, pj = ci + ux * t / cell_km, cj + uz * t / cell_km
            active &= (lit > 0) & (pi >= -0.5) & (pi <= width - 0.5) & (pj >= -0.5) & (pj <= height - 0.5)
            if not active.any():
                break
            x, y = np.clip(pi[active], 0, width - 1), np.clip(pj[active], 0, height - 1)
            a, b = np.floor(x).astype(int), np.floor(y).astype(int)
            fx, fy = x - a, y - b
            a2, b2 = np.minimum(a + 1, width - 1) - i0, np.minimum(b + 1, height - 1) - j0
            a, b = a - i0, b - j0
            top = ground[b, a] + (ground[b, a2] - ground[b, a]) * fx
            low = ground[b2, a] + (ground[b2, a2] - ground[b2, a]) * fx
            lit[active] = np.minimum(lit[active], penumbra * (start[active] + t * slope - (top + (low - top) * fy)) / t)
        return pd.DataFrame({"i": i[own], "j": j[own], "lit": np.clip(lit, 0, 1)})

    return dealt.groupBy("ti", "tj").applyInPandas(march, "i long, j long, lit double")


def normals(cells: DataFrame, cell_size: float, value: str = "h", tile: int = tiles.TILE) -> DataFrame:
    """(i, j, nx, ny, nz): unit normals from central differences; at the edge the cell itself stands for what is missing."""

    def work(b: tiles.Block) -> dict:
        own = b.side(value, 0, 0)
        west, east, north, south = (np.where(np.isnan(x := b.side(value, *to)), own, x) for to in ((-1, 0), (1, 0), (0, -1), (0, 1)))
        p, q = (west - east) / (2 * cell_size), (north - south) / (2 * cell_size)
        length = np.sqrt(p**2 + q**2 + 1)
        return {"nx": p / length, "ny": 1 / length, "nz": q / length}

    return tiles.tiled(cells, [value], work, "nx double, ny double, nz double", tile=tile)


def mesh_heights(points: DataFrame, vertices: DataFrame, mesh: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """Points (id, i, j) with ``drawn``, the height of the two-triangle mesh over a raster of ``size``.

    ``vertices`` (mi, mj, h) are the mesh's corners, which ``mesh_vertices`` reads off the raster.
    """
    at = lambda c, k: F.least(F.greatest((F.col(c) + 0.5) * (mesh[k] - 1) / size[k], F.lit(0.0)), F.lit(float(mesh[k] - 1)))
    quad = lambda c, k: F.least(F.floor(F.col(c)), F.lit(mesh[k] - 2))
    p = points.withColumns({"x": at("i", 0), "y": at("j", 1)}).withColumns({"qi": quad("x", 0), "qj": quad("y", 1)})
    corners = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), (F.col("qi") + a).alias("mi"), (F.col("qj") + b).alias("mj")) for n, (a, b) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1)))]))
    met = p.select("id", (F.col("x") - F.col("qi")).alias("fx"), (F.col("y") - F.col("qj")).alias("fy"), corners.alias("c")).select("id", "fx", "fy", "c.*").join(vertices, ["mi", "mj"])
    h = [F.max(F.when(F.col("n") == n, F.col("h"))) for n in range(4)]
    flat = met.groupBy("id", "fx", "fy").agg(*[c.alias(f"h{n}") for n, c in enumerate(h)])
    fx, fy = F.col("fx"), F.col("fy")
    near = F.col("h0") + (F.col("h1") - F.col("h0")) * fx + (F.col("h2") - F.col("h0")) * fy
    far = F.col("h3") + (F.col("h2") - F.col("h3")) * (1 - fx) + (F.col("h1") - F.col("h3")) * (1 - fy)
    return flat.select("id", F.when(fx + fy <= 1, near).otherwise(far).alias("drawn"))


def mesh_vertices(cells: DataFrame, mesh: tuple[int, int], size: tuple[int, int], value: str = "h") -> DataFrame:
    spark = cells.sparkSession
    grid = spark.range(mesh[0] * mesh[1]).select(F.pmod("id", F.lit(mesh[0])).alias("mi"), F.floor(F.col("id") / mesh[0]).alias("mj"))
    at = grid.withColumns({"i": F.col("mi") * (size[0] / (mesh[0] - 1)) - 0.5, "j": F.col("mj") * (size[1] / (mesh[1] - 1)) - 0.5})
    return bilinear(at, cells, *size, value).select("mi", "mj", F.col("sample").alias("h"))


def seam_blend(base: Column, patch: Column, u: Column, v: Column, margin: Column, fade: float = 0.05, band: float = 8.0) -> Column:
    """A patch fades into what lies below it at its edges (u, v from 0 to 1) and where a neighbour's centre gets nearer."""
    edge = F.least(u, 1 - u, v, 1 - v)
    return base + (patch - base) * smoothstep(0, fade, edge) * smoothstep(0, band, margin)


def levels(cells: DataFrame, width: int, height: int, value: str = "h") -> DataFrame:
    """(level, i, j, value): the raster, and each level half the one before, down to one cell."""
    out, now, level = cells.select(F.lit(0).cast("long").alias("level"), "i", "j", F.col(value).cast("double").alias(value)), cells, 0
    while max(width, height) > 1:
        width, height, level = max(1, width // 2), max(1, height // 2), level + 1
        # An odd last line has no partner and goes.
        now = stored(box_downsample(now, 2, value).where((F.col("i") < width) & (F.col("j") < height)))
        out = out.unionByName(now.select(F.lit(level).cast("long").alias("level"), "i", "j", value))
    return out
