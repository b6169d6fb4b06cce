"""Lookups between points, rectangles, lines and records. Distances and ranges become equi joins on buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.geo import KM_PER_DEGREE, planar_km
from gridloom.plans.iterate import labels
from gridloom.plans.shared import skew_safe_join, stored


def buckets(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def in_rectangles(points: DataFrame, rects: DataFrame, x: str = "i", y: str = "j", size: float = 32.0) -> DataFrame:
    """Points with each rectangle (x0, y0, x1, y1, both ends included) that covers them.

    A rectangle is listed under the square buckets that it touches, so a point meets only its own bucket's.
    """
    r = rects.select("*", F.explode(buckets(F.col("x0"), F.col("x1"), size)).alias("bx")).select("*", F.explode(buckets(F.col("y0"), F.col("y1"), size)).alias("by"))
    p = points.withColumns({"bx": F.floor(F.col(x) / size), "by": F.floor(F.col(y) / size)})
    covered = F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1"))
    return p.join(r, ["bx", "by"]).where(covered).drop("bx", "by")


#: Margins up to this count as a tie, which the lower class wins.
TIE = 0.001


def owner(covered: DataFrame, key: list[str], x: str = "i", y: str = "j") -> DataFrame:
    """Among covering rectangles the one that no other's centre is nearer than, and by how much it is nearer (null: alone).

    Distances that differ by TIE at most count as TIE in favour of the lower class. A point meets the pairs of the
    rectangles that cover it, which are few.
    """
    d = F.hypot(F.col(x) - (F.col("x0") + F.col("x1")) / 2, F.col(y) - (F.col("y0") + F.col("y1")) / 2)
    own = covered.select(*key, "cls", d.alias("d"))
    all_of = own.groupBy(*key).agg(F.collect_list(F.struct("cls", "d")).alias("c"))
    each = all_of.select(*key, "c", F.explode("c").alias("s"))
    apart = lambda q: q["d"] - F.col("s.d")
    margin = F.transform(F.filter("c", lambda q: q["cls"] != F.col("s.cls")), lambda q: F.when(F.abs(apart(q)) > TIE, apart(q)).otherwise(F.when(q["cls"] < F.col("s.cls"), -TIE).otherwise(TIE)))
    judged = each.select(*key, F.col("s.cls").alias("cls"), F.array_min(margin).alias("margin")).where("margin is null or margin >= 0")
    return judged.groupBy(*key).agg(F.min_by(F.struct("cls", "margin"), F.col("cls")).alias("o")).select(*key, "o.cls", "o.margin")


def first_match(covered: DataFrame, key: list[str]) -> DataFrame:
    return covered.groupBy(*key).agg(F.min("cls").alias("cls"))


def nearest_named(points: DataFrame, sites: DataFrame, pattern: str, radius_km: float, fallback: str) -> DataFrame:
    """(id, name): the nearest site within the radius whose name matches; else the fallback.

    Sites are listed under the latitude and longitude buckets around them. A latitude bucket is one radius high; a
    longitude bucket is one radius wide at the point farthest from the equator, and at 89.9 degrees beyond that. Places
    meet, not their copies: points of one place are looked up once, and of the sites of one place only the first counts.
    """
    size = radius_km / KM_PER_DEGREE
    far = points.agg(F.max(F.abs("lat"))).first()[0] or 0.0
    wide = size / math.cos(math.radians(min(far, 89.9)))
    near = sites.where(F.col("name").rlike(pattern)).groupBy(F.col("lon").alias("slon"), F.col("lat").alias("slat")).agg(F.min(F.struct("site", "name")).alias("s")).select("s.*", "slon", "slat")
    around = lambda c, s: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(c) / s) + d)
    near = near.select("*", F.explode(around("slon", wide)).alias("bx")).select("*", F.explode(around("slat", size)).alias("by"))
    places = points.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("copies"))
    p = places.withColumns({"bx": F.floor(F.col("lon") / wide), "by": F.floor(F.col("lat") / size)})
    km = planar_km(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat"))
    found = p.join(near, ["bx", "by"]).withColumn("km", km).where(F.col("km") <= radius_km).groupBy("lon", "lat").agg(F.min_by("name", F.struct("km", "site")).alias("name"))
    named = at_places(points.select("id", "lon", "lat"), places.join(found, ["lon", "lat"], "left"), ["lon", "lat"])
    return named.select("id", F.coalesce("name", F.lit(fallback)).alias("name"))


def at_places(rows: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their place (``keys``); ``copies`` counts its rows, of which it may have any share."""
    return skew_safe_join(rows, stored(places), keys, "copies", rows.count()).drop("copies")


def value_at(samples: DataFrame, targets: DataFrame, step: float) -> DataFrame:
    """Linear reading of transects (tid, k, distance, elevation) at targets (tid, at), clamped to the ends.

    Null where an end of the bracket has no elevation; at its own ends a transect has what its sample has. Brackets meet targets on buckets of ``step`` metres.
    """
    w = Window.partitionBy("tid").orderBy("k")
    ends = samples.groupBy("tid").agg(F.max("distance").alias("far"), F.min("distance").alias("near"))
    t = targets.join(ends, "tid").withColumn("q", F.least(F.greatest("at", "near"), "far"))
    seg = samples.select("tid", F.col("distance").alias("d0"), F.col("elevation").alias("e0"), F.lead("distance").over(w).alias("d1"), F.lead("elevation").over(w).alias("e1"))
    seg = seg.withColumn("d1", F.coalesce("d1", "d0"))
    seg = seg.select("*", F.explode(buckets(F.col("d0"), F.col("d1"), step)).alias("b"))
    met = t.withColumn("b", F.floor(F.col("q") / step)).join(seg, ["tid", "b"]).where("q between d0 and d1")
    best = met.groupBy("tid", "at", "q", "near").agg(F.max_by(F.struct("d0", "e0", "d1", "e1"), F.col("d0")).alias("s"))
    f = F.when(F.col("s.d1") > F.col("s.d0"), (F.col("q") - F.col("s.d0")) / (F.col("s.d1") - F.col("s.d0"))).otherwise(0.0)
    first = (F.col("s.d1") == F.col("s.d0")) | (F.col("q") <= F.col("near"))
    return best.select("tid", "at", F.when(first, F.col("s.e0")).otherwise(F.col("s.e0") + (F.col("s.e1") - F.col("s.e0")) * f).alias("elevation"))


#: Segments in a box of the lowest level, and boxes in one of the next.
PIECE, FAN = 16, 8


def nearest_on_line(line: DataFrame, targets: DataFrame) -> DataFrame:
    """For targets (id, tid, px, py) the nearest segment of their own line (tid, k, x, y): (id, k, d2).

    A line's segments lie in boxes of PIECE, those in boxes of FAN, and so on up to one box a line. Targets descend level
    by level: of the boxes below those that are left, those stay that are no farther than the nearest one is at its
    farthest. So a target meets some FAN boxes a level, and the segments of a few boxes. Of equally near ones the first
    counts.
    """
    w = Window.partitionBy("tid").orderBy("k")
    seg = line.select("tid", "k", "x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.floor((F.row_number().over(w) - 1) / PIECE).alias("box")).where("x1 is not null")
    seg = stored(seg)
    low, high = (lambda a, b: F.min(F.least(a, b))), (lambda a, b: F.max(F.greatest(a, b)))
    sides = [f("x", "x1") if n in "lr" else f("y", "y1") for n, f in (("l", low), ("r", high), ("t", low), ("b", high))]
    levels = [stored(seg.groupBy("tid", "box").agg(*[c.alias(n) for n, c in zip("lrtb", sides)]))]
    most = levels[0].agg(F.max("box")).first()[0] or 0
    while most > 0:
        up = levels[-1].groupBy("tid", F.floor(F.col("box") / FAN).alias("box")).agg(F.min("l").alias("l"), F.max("r").alias("r"), F.min("t").alias("t"), F.max("b").alias("b"))
        levels.append(stored(up))
        most //= FAN
    out = lambda p, a, b: F.greatest(F.col(a) - F.col(p), F.col(p) - F.col(b), F.lit(0.0))
    across = lambda p, a, b: F.greatest(F.abs(F.col(p) - F.col(a)), F.abs(F.col(p) - F.col(b)))
    square = lambda f: F.pow(f("px", "l", "r"), F.lit(2)) + F.pow(f("py", "t", "b"), F.lit(2))
    near = targets.select("id", "tid", "px", "py", F.lit(0).cast("long").alias("box"))
    for boxes in levels[-2::-1]:
        below = boxes.select("tid", F.floor(F.col("box") / FAN).alias("up"), "box", "l", "r", "t", "b")
        met = near.withColumnRenamed("box", "up").join(below, ["tid", "up"]).select("id", "tid", "px", "py", "box", square(out).alias("least"), square(across).alias("most"))
        met = stored(met)
        limit = met.groupBy("id").agg(F.min("most").alias("limit"))
        near = met.join(limit, "id").where(F.col("least") <= F.col("limit") * (1 + 1e-12)).select("id", "tid", "px", "py", "box")
    met = near.join(seg, ["tid", "box"])
    dx, dy = F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("x")) * dx + (F.col("py") - F.col("y")) * dy) / length))).otherwise(0.0)
    met = met.withColumn("t", t)
    d2 = F.pow(F.col("px") - F.col("x") - F.col("t") * dx, F.lit(2)) + F.pow(F.col("py") - F.col("y") - F.col("t") * dy, F.lit(2))
    best = met.withColumn("d2", d2).groupBy("id").agg(F.min(F.struct("d2", "k")).alias("b"))
    return best.select("id", F.col("b.k").alias("k"), F.col("b.d2").alias("d2"))


def proximity_edges(points: DataFrame, tolerance: float, strict: bool = False) -> DataFrame:
    """Edges (u, v), both ways, between points (id, x, y) at most ``tolerance`` apart (``strict``: nearer), met on buckets of that size."""
    cell = lambda c: F.floor(F.col(c) / tolerance)
    own = points.select(F.col("id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"), cell("x").alias("bx"), cell("y").alias("by"))
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    other = points.select(F.col("id").alias("v"), "x", "y", F.explode(offsets).alias("o")).select("v", "x", "y", (cell("x") + F.col("o.a")).alias("bx"), (cell("y") + F.col("o.b")).alias("by"))
    apart = F.hypot(F.col("x") - F.col("ux"), F.col("y") - F.col("uy"))
    return own.join(other, ["bx", "by"]).where((F.col("u") != F.col("v")) & (apart < tolerance if strict else apart <= tolerance)).select("u", "v")


def proximity_labels(points: DataFrame, tolerance: float, strict: bool = False) -> DataFrame:
    """(id, label) of points (id, x, y): components by ``proximity_edges``, label the smallest id.

    Points of one place are one node, named by the smallest id: its copies reach all that it reaches. So edges follow
    places, not pairs of copies. A point without a finite place is by itself.
    """
    finite = points.where("x - x = 0 and y - y = 0")
    places = stored(finite.groupBy("x", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    named = labels(places.select(F.col("id").alias("node")), stored(proximity_edges(places, tolerance, strict))).withColumnRenamed("node", "id")
    found = at_places(points.select("id", "x", "y"), places.join(named, "id").select("x", "y", "copies", "label"), ["x", "y"])
    return found.select("id", F.coalesce("label", "id").alias("label"))


def flattened(records: DataFrame, key: str) -> DataFrame:
    """(key, path, value): every leaf of nested records; fields by name, elements of arrays by number, maps by key."""

    def leaves(kind, at: Column, path: Column) -> Column:
        if isinstance(kind, T.StructType):
            parts = [leaves(f.dataType, at[f.name], F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
            return F.when(at.isNotNull(), F.concat(*parts)).otherwise(none) if parts else none
        if isinstance(kind, T.ArrayType):
            inner = F.transform(at, lambda x, k: leaves(kind.elementType, x, F.concat(path, F.lit("["), k.cast("string"), F.lit("]"))))
            return F.coalesce(F.flatten(inner), none)
        if isinstance(kind, T.MapType):
            inner = F.transform(F.map_entries(at), lambda e: leaves(kind.valueType, e["value"], F.concat(path, F.lit("."), e["key"].cast("string"))))
            return F.coalesce(F.flatten(inner), none)
        return F.array(F.struct(path.alias("path"), at.cast("string").alias("value")))

    none = F.expr("cast(array() as array<struct<path:string,value:string>>)")
    fields = [f for f in records.schema.fields if f.name != key]
    every = F.concat(none, *[leaves(f.dataType, F.col(f.name), F.lit(f.name)) for f in fields])
    return records.select(key, F.explode(every).alias("l")).select(key, "l.path", "l.value").where("value is not null")


def record_diff(old: DataFrame, new: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Leaves (key, path, old, new) that differ or stand on one side only; with a ``limit``, the first of a report."""
    both = flattened(old, key).withColumnRenamed("value", "old").join(flattened(new, key).withColumnRenamed("value", "new"), [key, "path"], "full")
    apart = both.where(~F.col("old").eqNullSafe(F.col("new")))
    return apart if limit is None else apart.orderBy(key, "path").limit(limit)
