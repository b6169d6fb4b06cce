"""Features and rings: geometries from GeoJSON, boxes, centroids, chained outlines, simplification."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import name_key
from gridloom.operators.tiles import corners
from gridloom.plans.shared import checked_broadcast, skew_safe_join, stored

POSITIONS = "array<array<array<double>>>"


def polygons_of(geometry: Column) -> Column:
    """array<polygon<ring<position>>> of a GeoJSON geometry as JSON text; null where it is none that can be read.

    A polygon is a list of one; rings need four positions, polygons a ring, positions two numbers.
    """
    kind = F.get_json_object(geometry, "$.type")
    at = F.get_json_object(geometry, "$.coordinates")
    one, many = F.array(F.from_json(at, POSITIONS)), F.from_json(at, f"array<{POSITIONS}>")
    found = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    position = lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull()
    ring = lambda r: (F.size(r) >= 4) & F.forall(r, position)
    polygon = lambda p: (F.size(p) >= 1) & F.forall(p, ring)
    return F.when(F.coalesce((F.size(found) >= 1) & F.forall(found, polygon), F.lit(False)), found)


def geometry_problem(geometry: Column) -> Column:
    """Why a geometry cannot be read; null if it can."""
    kind = F.get_json_object(geometry, "$.type")
    unknown = ~F.coalesce(kind.isin("Polygon", "MultiPolygon"), F.lit(False))
    return F.when(unknown, F.concat(F.lit("unsupported geometry "), F.coalesce(kind, F.lit("none")))).when(polygons_of(geometry).isNull(), F.lit("a polygon needs rings of four positions of two numbers"))


def vertices(features: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """(key, poly, ring, k, lon, lat): every position, a ring's last one too."""
    p = features.select(key, F.posexplode(polygons_of(F.col(geometry))).alias("poly", "rings"))
    r = p.select(key, "poly", F.posexplode("rings").alias("ring", "positions"))
    return r.select(key, "poly", "ring", F.posexplode("positions").alias("k", "p")).select(key, "poly", "ring", "k", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    """West, south, east and north of vertices; no keys: of all of them."""
    return points.groupBy(*keys).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def centroids(points: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of all vertices; one that closes a ring counts again."""
    return points.groupBy(*keys).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def select_named(features: DataFrame, wanted: DataFrame, extent: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Features (fid, name, geometry) whose name is wanted (name) and whose centroid lies in the extent; and problems.

    Names are compared by their keys. A wanted name with no feature or several is a problem (name, found).
    """
    keyed = features.withColumn("key", name_key(F.col("name")))
    expected = wanted.select(F.col("name").alias("wanted"), name_key(F.col("name")).alias("key"))
    named = keyed.join(checked_broadcast(expected, 128), "key")
    centre = centroids(vertices(named, "fid"), ["fid"])
    west, south, east, north = extent
    inside = named.join(centre, "fid").where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    counts = inside.groupBy("key").agg(F.count(F.lit(1)).alias("found"))
    problems = expected.join(counts, "key", "left").select(F.col("wanted").alias("name"), F.coalesce("found", F.lit(0)).alias("found")).where("found <> 1")
    return inside.select("fid", "name", "key", "lon", "lat"), problems


def ring_measures(ring: Column) -> tuple[Column, Column]:
    """(signed area, perimeter) of array<struct<x, y>>, the last vertex joined to the first."""
    n = F.size(ring)
    after = lambda k: F.get(ring, (k + 1) % n)
    steps = F.transform(ring, lambda p, k: F.struct((p["x"] * after(k)["y"] - after(k)["x"] * p["y"]).alias("a"), F.hypot(after(k)["x"] - p["x"], after(k)["y"] - p["y"]).alias("d")))
    total = lambda f: F.aggregate(steps, F.lit(0.0), lambda a, s: a + s[f])
    return total("a") / 2, total("d")


def crossings(cells: DataFrame, value: str = "s") -> DataFrame:
    """Segments (a, b, ax, ay, bx, by) of the zero line through squares of four cells; at or above zero is inside.

    A segment's ends are named by the cell edges that they lie on: 2 * cell for the one to the east, 2 * cell + 1 for
    the one to the south, cells being numbered by i and j in 31 bits each. Where all four edges are crossed, the mean
    of the corners tells which corners belong together. Segments run so that the inside is always on the same hand:
    one that ends on an edge goes on in the next square with the one that begins there.
    """
    q = corners(cells, value)
    i, j = F.col("i"), F.col("j")
    name = lambda di, dj, south: (F.shiftleft((j + dj).cast("long"), 32) + (i + di)) * 2 + south
    inside = lambda c: F.col(c) >= 0
    cut = lambda a, b: F.when(inside(a) != inside(b), F.col(a) / (F.col(a) - F.col(b)))
    # Clockwise from ``a`` to ``b`` the line is crossed inwards if ``b`` is inside: there a segment begins.
    end = lambda t, e, x, y, b: F.when(t.isNotNull(), F.struct(e.alias("e"), x.alias("x"), y.alias("y"), inside(b).alias("begins")))
    t, r, b, left = cut("tl", "tr"), cut("tr", "br"), cut("bl", "br"), cut("tl", "bl")
    d = lambda c: c.cast("double")
    ends = F.array_compact(F.array(end(t, name(0, 0, 0), i + t, d(j), "tr"), end(r, name(1, 0, 1), d(i + 1), j + r, "br"), end(b, name(0, 1, 0), i + b, d(j + 1), "bl"), end(left, name(0, 0, 1), d(i), j + left, "tl")))
    e = q.select(ends.alias("e"), ((F.col("tl") >= 0) == (F.col("tl") + F.col("tr") + F.col("bl") + F.col("br") >= 0)).alias("joined")).where(F.size("e") > 0)
    one = lambda k: F.get("e", F.lit(k))
    pair = lambda a, b: F.struct(F.when(one(a)["begins"], one(a)).otherwise(one(b)).alias("p"), F.when(one(a)["begins"], one(b)).otherwise(one(a)).alias("q"))
    pairs = F.when(F.size("e") == 2, F.array(pair(0, 1))).when(F.col("joined"), F.array(pair(0, 1), pair(2, 3))).otherwise(F.array(pair(0, 3), pair(1, 2)))
    s = e.select(F.explode(pairs).alias("s"))
    return s.select(F.col("s.p.e").alias("a"), F.col("s.q.e").alias("b"), F.col("s.p.x").alias("ax"), F.col("s.p.y").alias("ay"), F.col("s.q.x").alias("bx"), F.col("s.q.y").alias("by"))


#: Cells of the side of a tile in which chains are followed; vertices that one task simplifies together.
CHAIN_TILE, RANGE = 256, 4096
PIECES = "start long, end long, n long, low long, at long, area double, length double, points array<struct<x:double,y:double>>"


def _chains(table: pa.Table) -> pa.Table:
    """The segments of one tile -> the pieces of chains that they make.

    A piece begins on an edge that no segment of the tile ends on, or is closed and begins on its smallest one. Its points
    are those of its edges but the last, which is where the next piece begins.
    """
    a, b = (table.column(c).to_pylist() for c in ("a", "b"))
    x, y, bx, by = (table.column(c).to_pylist() for c in ("ax", "ay", "bx", "by"))
    leaves = dict(zip(a, range(len(a))))
    heads = sorted(set(a) - set(b)) + sorted(a)
    done, rows = [False] * len(a), []
    for head in heads:
        k = leaves[head]
        if done[k]:
            continue
        chain = []
        while k is not None and not done[k]:
            done[k] = True
            chain.append(k)
            k = leaves.get(b[k])
        edges = [a[k] for k in chain]
        area = sum(x[k] * by[k] - bx[k] * y[k] for k in chain) / 2
        length = sum(math.hypot(bx[k] - x[k], by[k] - y[k]) for k in chain)
        low = min(edges)
        rows.append((edges[0], b[chain[-1]], len(chain), low, edges.index(low), area, length, [{"x": x[k], "y": y[k]} for k in chain]))
    return pa.table({f.name: pa.array(c, f.type) for f, c in zip(PIECE_SCHEMA, zip(*rows))}, PIECE_SCHEMA)


PIECE_SCHEMA = pa.schema([(n, pa.int64()) for n in ("start", "end", "n", "low", "at")] + [(n, pa.float64()) for n in ("area", "length")] + [("points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))])


def _ranked(pieces: DataFrame) -> DataFrame:
    """(start, ring, dist) of open pieces (start, end, n, low, at) that lie on closed chains.

    Pointer doubling: after k rounds a piece knows of 2**k pieces from itself on the least edge, how many points lie
    before it, and which piece comes next. A round that changes nothing has gone around every ring. Chains that end
    somewhere are left out.
    """
    s = stored(pieces.select("start", F.col("end").alias("to"), F.col("n").alias("len"), "low", F.col("at").alias("dist")))
    for _ in range(MOST_ROUNDS):
        step = s.withColumn("moved", F.lit(False))
        for _ in range(2):  # two rounds a write
            far = step.select(F.col("start").alias("to"), F.col("to").alias("to2"), F.col("len").alias("len2"), F.col("low").alias("low2"), F.col("dist").alias("dist2"))
            less = F.col("low2") < F.col("low")
            step = step.join(far, "to", "left").select(
                "start", F.col("to2").alias("to"), (F.col("len") + F.col("len2")).alias("len"), F.when(less, F.col("low2")).otherwise(F.col("low")).alias("low"),
                F.when(less, F.col("len") + F.col("dist2")).otherwise(F.col("dist")).alias("dist"), (F.col("moved") | F.coalesce(less, F.lit(False)) | (F.col("to").isNotNull() & F.col("to2").isNull())).alias("moved"))
        step = stored(step)
        s = step.drop("moved")
        if step.where("moved").isEmpty():
            return s.where("to is not null").select("start", F.col("low").alias("ring"), "dist")
    raise RuntimeError("chains of more than 2**62 pieces")


MOST_ROUNDS = 31


def rings(segments: DataFrame, tile: int = CHAIN_TILE) -> tuple[DataFrame, DataFrame]:
    """Closed chains of at least three segments: their vertices (ring, place, x, y, n) and measures (ring, n, area, length).

    A ring is named by its smallest edge and begins there; its area is positive. Chains are followed inside tiles; the
    pieces that this leaves are ranked by pointer doubling, and a vertex's place is its piece's and its own. Measures are
    sums over pieces. No task sees a ring that is larger than a tile. Open chains are left out.
    """
    place = lambda c, d: F.floor((F.col(c) + F.col(d)) / 2 / tile)
    dealt = segments.withColumns({"ti": place("ax", "bx"), "tj": place("ay", "by")})
    pieces = stored(dealt.groupBy("ti", "tj").applyInArrow(_chains, PIECES))
    open_ = pieces.where("start <> end")
    ranked = _ranked(open_)
    whole = pieces.where("start = end").withColumns({"ring": F.col("low"), "dist": F.col("at")}).unionByName(open_.join(ranked, "start"))
    whole = stored(whole.select("ring", "dist", F.col("n").alias("own"), "area", "length", "points"))
    measures = whole.groupBy("ring").agg(F.sum("own").alias("n"), F.sum("area").alias("signed"), F.sum("length").alias("length")).where("n >= 3")
    measures = stored(measures)
    n = F.col("n")
    at = F.pmod(n - F.col("dist") + F.col("pos"), n)
    v = whole.select("ring", "dist", F.posexplode("points").alias("pos", "p"))
    v = skew_safe_join(v, measures.select("ring", "n", "signed"), ["ring"], "n", measures.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], "inner")
    vertices = v.select("ring", F.when(F.col("signed") < 0, F.pmod(n - at, n)).otherwise(at).cast("long").alias("place"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), "n")
    return vertices, measures.select("ring", "n", F.abs("signed").alias("area"), "length")


def simplify(vertices: DataFrame, tolerance: float, most: int = RANGE) -> DataFrame:
    """(ring, place, x, y, to_x, to_y) of rings (ring, place, x, y, n) with fewer vertices, and each one's next vertex.

    None that is dropped lies farther than the tolerance from what remains. A ring is cut at two far vertices, and each
    part at its farthest vertex while that is beyond the tolerance. Rings of three vertices, and those that would fall
    below three, stay as they are. Rings of ``most`` vertices or fewer are worked on each in one task, which takes many;
    parts of larger ones are cut by aggregates over all their vertices until they are as small.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(vertices.schema["ring"].dataType)
    schema = f"ring {vertices.schema['ring'].dataType.simpleString()}, place long, x double, y double, to_x double, to_y double"
    sorted_ = lambda df: df.repartition("ring", "part").sortWithinPartitions("ring", "part", "t").select("ring", "part", "place", "x", "y")
    v = vertices.withColumns({"part": F.lit(0).cast("long"), "t": F.col("place")})
    small = sorted_(v.where(F.col("n") <= most)).mapInArrow(_by_part(kind, lambda p: _ring(p, tolerance)), schema)
    large = stored(v.where(F.col("n") > most).drop("part", "t"))
    if large.isEmpty():
        return small
    parts = _cut(large, tolerance, most)
    kept = stored(sorted_(parts).mapInArrow(_by_part(kind, lambda p: _part(p, tolerance)), schema))
    few = kept.groupBy("ring").count().where("count < 3").select("ring")
    after = F.pmod(F.col("place") - 1, F.col("n"))
    back = large.join(few, "ring")
    nexts = back.select("ring", after.alias("place"), F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    return small.unionByName(kept.join(few, "ring", "left_anti")).unionByName(back.select("ring", "place", "x", "y").join(nexts, ["ring", "place"]))


def _cut(large: DataFrame, tolerance: float, most: int) -> DataFrame:
    """(ring, part, t, place, x, y): vertices of large rings in parts of ``most`` at most; a part's last is the next one's first."""
    away = lambda x, y: F.hypot(F.col("x") - F.col(x), F.col("y") - F.col(y))
    far = lambda df: df.groupBy("ring").agg(F.max_by(F.struct("place", "x", "y"), F.struct("d", (-F.col("place")).alias("minus"))).alias("f")).select("ring", F.col("f.place").alias("fp"), F.col("f.x").alias("fx"), F.col("f.y").alias("fy"))
    first = large.where("place = 0").select("ring", F.col("x").alias("fx"), F.col("y").alias("fy"))
    a = stored(far(large.join(checked_broadcast(first, 32), "ring").withColumn("d", away("fx", "fy"))))
    b = stored(far(large.join(checked_broadcast(a.drop("fp"), 32), "ring").withColumn("d", away("fx", "fy"))))
    t = F.pmod(F.col("place") - F.col("fp"), F.col("n"))
    v = large.join(checked_broadcast(a.select("ring", "fp"), 24), "ring").withColumn("t", t)
    # The first vertex stands at both ends.
    v = stored(v.unionByName(v.where("t = 0").withColumn("t", F.col("n"))).select("ring", "t", "place", "x", "y"))
    sizes = large.where("place = 0").select("ring", "n")
    cut = b.select("ring", F.col("fp").alias("bp")).join(a.select("ring", "fp"), "ring").join(sizes, "ring").select("ring", "n", F.pmod(F.col("bp") - F.col("fp"), F.col("n")).alias("m"))
    parts = stored(cut.select("ring", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("m").alias("hi")), F.struct(F.col("m").alias("lo"), F.col("n").alias("hi")))).alias("p")).select("ring", "p.lo", "p.hi", F.lit(False).alias("still")))
    for _ in range(MOST_CUTS):
        open_ = parts.where((F.col("hi") - F.col("lo") > most) & ~F.col("still"))
        if open_.isEmpty():
            break
        ends = lambda c: v.select("ring", F.col("t").alias(c), F.col("x").alias(f"{c}_x"), F.col("y").alias(f"{c}_y"))
        posts = open_.join(ends("lo"), ["ring", "lo"]).join(ends("hi"), ["ring", "hi"])
        posts = checked_broadcast(stored(posts), 64)
        inner = v.join(posts, (v["ring"] == posts["ring"]) & (F.col("t") > F.col("lo")) & (F.col("t") < F.col("hi"))).drop(posts["ring"])
        dx, dy = F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y")
        long = dx * dx + dy * dy
        k = F.when(long > 1e-18, F.least(F.greatest(((F.col("x") - F.col("lo_x")) * dx + (F.col("y") - F.col("lo_y")) * dy) / long, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        d = F.hypot(F.col("x") - F.col("lo_x") - k * dx, F.col("y") - F.col("lo_y") - k * dy)
        farthest = inner.withColumn("d", d).groupBy("ring", "lo", "hi").agg(F.max(F.struct("d", (-F.col("t")).alias("minus"))).alias("f"))
        split = F.when(F.col("f.d") > tolerance, F.array(F.struct("lo", (-F.col("f.minus")).alias("hi"), F.lit(False).alias("still")), F.struct((-F.col("f.minus")).alias("lo"), "hi", F.lit(False).alias("still")))).otherwise(F.array(F.struct("lo", "hi", F.lit(True).alias("still"))))
        parts = stored(farthest.select("ring", F.explode(split).alias("p")).select("ring", "p.*").unionByName(parts.where((F.col("hi") - F.col("lo") <= most) | F.col("still"))))
    else:
        raise RuntimeError("parts did not get smaller")
    # A part without a far vertex is its ends.
    parts = checked_broadcast(parts, 40)
    met = v.join(parts, (v["ring"] == parts["ring"]) & (F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi"))).drop(parts["ring"])
    return met.where(~F.col("still") | (F.col("t") == F.col("lo")) | (F.col("t") == F.col("hi"))).select("ring", F.col("lo").alias("part"), "t", "place", "x", "y")


MOST_CUTS = 1000


def _by_part(kind: pa.DataType, work):
    """(ring, part, place, x, y), sorted -> what ``work`` keeps of each part's (n, 2) points: numbers of points, and of their next ones."""

    def done(ring, rows: list):
        place = np.concatenate([r[0] for r in rows])
        p = np.concatenate([r[1] for r in rows])
        at, to = work(p)
        return pa.RecordBatch.from_arrays([pa.array([ring] * len(at), kind), pa.array(place[at]), *[pa.array(c) for c in (*p[at].T.copy(), *p[to].T.copy())]], names=["ring", "place", "x", "y", "to_x", "to_y"])

    def run(batches):
        held, key, out, size = [], None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            rings_, parts = b.column(0).to_pylist(), b.column(1).to_numpy()
            place, p = b.column(2).to_numpy(), np.stack([b.column(3).to_numpy(), b.column(4).to_numpy()], 1)
            names = list(zip(rings_, parts.tolist()))
            starts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(names)]):
                if held and names[lo] != key:
                    out.append(done(key[0], held))
                    size += out[-1].num_rows
                    held = []
                key = names[lo]
                held.append((place[lo:hi], p[lo:hi]))
            if size > 1 << 15:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, size = [], 0
        if held:
            out.append(done(key[0], held))
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def _ring(p: np.ndarray, tolerance: float):
    """Which points of a ring stay, and each one's next."""
    n = len(p)
    every = np.arange(n), (np.arange(n) + 1) % n
    if n <= 3 or tolerance <= 0:
        return every
    a = int(np.argmax(np.hypot(*(p - p[0]).T)))
    b = int(np.argmax(np.hypot(*(p - p[a]).T)))
    if a == b:
        return every
    order = np.append(np.arange(a, a + n) % n, a)
    m = (b - a) % n
    kept = np.concatenate([_kept(p[order[: m + 1]], tolerance)[:-1], m + _kept(p[order[m:]], tolerance)[:-1]])
    return (order[kept], order[np.append(kept[1:], 0)]) if len(kept) >= 3 else every


def _part(p: np.ndarray, tolerance: float):
    """Which points of a part stay, its last one left to the next part, and each one's next."""
    kept = _kept(p, tolerance)
    return kept[:-1], kept[1:]


def _kept(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Numbers of a line's points that stay: its ends, and the farthest of each part that is beyond the tolerance."""
    keep, parts = {0, len(p) - 1}, [(0, len(p) - 1)]
    while parts:
        lo, hi = parts.pop()
        if hi <= lo + 1:
            continue
        inner, d = p[lo + 1 : hi] - p[lo], p[hi] - p[lo]
        length = float(d @ d)
        t = np.clip(inner @ d / length, 0, 1) if length > 1e-18 else np.zeros(len(inner))
        away = np.hypot(*(inner - t[:, None] * d).T)
        k = int(np.argmax(away))
        if away[k] > tolerance:
            keep.add(lo + 1 + k)
            parts += [(lo, lo + 1 + k), (lo + 1 + k, hi)]
    return np.array(sorted(keep))


def line_measures(lines: DataFrame) -> DataFrame:
    """(ring, n, area, length) of closed lines (ring, x, y, to_x, to_y), as sums."""
    area = (F.col("x") * F.col("to_y") - F.col("to_x") * F.col("y")) / 2
    return lines.groupBy("ring").agg(F.count(F.lit(1)).alias("n"), F.sum(area).alias("area"), F.sum(F.hypot(F.col("to_x") - F.col("x"), F.col("to_y") - F.col("y"))).alias("length"))


def longest(measures: DataFrame) -> DataFrame:
    """The ring with the longest perimeter; of equal ones the first."""
    return measures.orderBy(F.desc("length"), "ring").limit(1)
