"""Queries of features, outlines, routing, what is seen of a relief, and state machines."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.catalog_scene import sql_whole, whole
from gridloom.functions.geo import GridSpec, micro
from gridloom.operators import hydro, raster, vectors, view
from gridloom.plans.shared import shared_root
from gridloom.registry import query, rounded
from gridloom.sources.tables import grid, height, table, with_tables, zones
from gridloom.streaming import folds, reducers, state, streams

SUN = (math.cos(math.radians(20)) * 0.6, math.sin(math.radians(20)), -math.cos(math.radians(20)) * 0.8)


def spec(rows: int) -> GridSpec:
    return GridSpec(10, 82048, 145664, 64, rows)


# Features


def features(spark, d):
    """GeoJSON of the zones; every sixth has another type, every seventh a ring that is too short, every eighth two parts."""
    z = zones(spark, d)
    at = lambda x, y: F.format_string("[%.2f,%.2f]", F.col(x), F.col(y))
    ring = F.concat(F.lit("["), F.concat_ws(",", at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"), at("x0", "y0")), F.lit("]"))
    short = F.concat(F.lit("["), F.concat_ws(",", at("x0", "y0"), at("x1", "y0"), at("x0", "y0")), F.lit("]"))
    polygon = F.concat(F.lit("["), F.when(F.col("cls") % 7 == 0, short).otherwise(ring), F.lit("]"))
    kind = F.when(F.col("cls") % 6 == 0, "Point").when(F.col("cls") % 8 == 0, "MultiPolygon").otherwise("Polygon")
    coordinates = F.when(kind == "MultiPolygon", F.concat(F.lit("["), polygon, F.lit(","), polygon, F.lit("]"))).otherwise(polygon)
    return z.select(F.col("cls").alias("fid"), "name", F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}")).alias("geometry"))


@query(with_tables("zones", " SELECT cls AS fid, CASE WHEN cls % 6 = 0 THEN 'unsupported geometry Point' WHEN cls % 7 = 0 THEN 'a polygon needs rings of four positions of two numbers' END AS problem FROM zones"))
def geometry_problems(spark, d):
    return features(spark, d).select("fid", vectors.geometry_problem(F.col("geometry")).alias("problem"))


GOOD = "g AS (SELECT cls AS fid, name, x0, y0, x1, y1 FROM zones WHERE cls % 6 <> 0 AND cls % 7 <> 0)"


@query(with_tables("zones", f", {GOOD} SELECT fid, x0 AS west, y0 AS south, x1 AS east, y1 AS north FROM g UNION ALL SELECT 0, min(x0), min(y0), max(x1), max(y1) FROM g"))
def feature_boxes(spark, d):
    v = vectors.vertices(features(spark, d), "fid")
    return vectors.boxes(v, ["fid"]).unionByName(vectors.boxes(v, []).withColumn("fid", F.lit(0).cast("long")))


@query(with_tables("zones", f", {GOOD} SELECT fid, {sql_whole(('lon', '(3 * x0 + 2 * x1) / 5'), ('lat', '(3 * y0 + 2 * y1) / 5'))} FROM g"))
def feature_centroids(spark, d):
    return vectors.centroids(vectors.vertices(features(spark, d), "fid"), ["fid"]).select("fid", *whole(("lon", F.col("lon")), ("lat", F.col("lat"))))


@query(with_tables("zones", f", {GOOD}, i AS (SELECT * FROM g WHERE (3 * x0 + 2 * x1) / 5 BETWEEN 5 AND 50 AND (3 * y0 + 2 * y1) / 5 BETWEEN 20 AND 400) SELECT n_name AS name, count(i.fid) AS found FROM nation LEFT JOIN i ON i.name = n_name GROUP BY n_name"))
def selected_features(spark, d):
    wanted = table(spark, d, "nation").select(F.initcap("n_name").alias("name"))
    chosen, problems = vectors.select_named(features(spark, d), wanted, (5.0, 20.0, 50.0, 400.0))
    return problems.unionByName(chosen.select(F.initcap("name").alias("name"), F.lit(1).cast("long").alias("found"))).select(F.upper("name").alias("name"), "found")


@query(with_tables("zones", f" SELECT cls, {sql_whole(('area', '(x1 - x0) * (y1 - y0)'), ('length', '2 * (x1 - x0 + y1 - y0)'))} FROM zones"))
def ring_measures(spark, d):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    area, length = vectors.ring_measures(F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")))
    return zones(spark, d).select("cls", *whole(("area", area), ("length", length)))


def signed(spark, d):
    """A smooth field with a zero line, and some noise on it."""
    return grid(spark, d).select("i", "j", (F.col("h") - 1000 + 400 * F.sin(F.col("i") / 9.0) * F.cos(F.col("j") / 11.0)).alias("s"))


@query()
def outline_rings(spark, d):
    # Chains have no SQL of their own; tests hold them against a walk.
    vertices, _ = vectors.rings(vectors.crossings(signed(spark, d)))
    found = vectors.line_measures(vectors.simplify(vertices, 0.5))
    return found.select("ring", F.col("n").alias("n_points"), *whole(("area", F.col("area")), ("length", F.col("length")), digits=2))


@query()
def longest_outline(spark, d):
    _, measures = vectors.rings(vectors.crossings(signed(spark, d)))
    return vectors.longest(measures).select("ring", F.col("n").alias("n_points"), *whole(("length", F.col("length")), digits=2))


# Water


def water(spark, d):
    """A relief with wide hollows, its rows, its fill without epsilon, its depressions and their cells."""
    g = grid(spark, d)
    rows = height(g)
    bowl = F.when((F.pmod("i", F.lit(32)).between(6, 25)) & (F.pmod("j", F.lit(40)).between(8, 30)), F.lit(900)).otherwise(F.lit(0))
    cells = hydro.checkpointed(g.select("i", "j", (F.col("h") / 4 + 40 * F.pmod("j", F.lit(40)) - bowl + 3000).alias("h")))
    minimal = hydro.checkpointed(hydro.fill(cells, 64, rows, 0.0, ground=True))
    members = hydro.submerged(cells, minimal, 64)
    return cells, rows, minimal, hydro.checkpointed(hydro.depressions(cells, minimal, 64, members=members)), members


@query()
def largest_depressions(spark, d):
    _, _, _, found, _ = water(spark, d)
    return found.where("retained").orderBy(F.desc("n_cells"), "label").limit(12).select("label", "n_cells", "bottom", micro(F.col("max_depth")).alias("depth"))


@query()
def flow_routing(spark, d):
    """Directions over the routing surface, main basins with retained depressions merged, and every cell's label."""
    cells, rows, minimal, found, members = water(spark, d)
    filled = hydro.fill(cells, 64, rows, 0.01, ground=True)
    surface = hydro.checkpointed(hydro.routing(cells, filled, minimal, found, members, 64))
    graph = hydro.checkpointed(hydro.edges(hydro.d8(surface, "z"), 64))
    basins, labels = hydro.outlets(hydro.followed(graph, 64), None, lambda cell: F.pmod(cell, F.lit(64)).between(4, 59), found, members)
    sizes = labels.groupBy("basin").agg(F.count(F.lit(1)).alias("labelled"))
    return sizes.join(basins.withColumnRenamed("id", "basin"), "basin", "left").select("basin", "labelled", "terminal", "outlet", "outlet_acc", "n_cells", "kind")


# What is seen


@query(with_tables("grid", f""", n AS (SELECT i, j, coalesce(lag(h) OVER r, h) - coalesce(lead(h) OVER r, h) AS p, coalesce(lag(h) OVER c, h) - coalesce(lead(h) OVER c, h) AS q FROM grid WINDOW r AS (PARTITION BY j ORDER BY i), c AS (PARTITION BY i ORDER BY j)), l AS (SELECT *, sqrt(pow(p / 600.0, 2) + pow(q / 600.0, 2) + 1) AS l FROM n)
SELECT i, j, {sql_whole(('nx', 'p / 600.0 / l'), ('ny', '1 / l'), ('nz', 'q / 600.0 / l'))} FROM l"""))
def surface_normals(spark, d):
    return view.normals(grid(spark, d), 300.0).select("i", "j", *whole(("nx", F.col("nx")), ("ny", F.col("ny")), ("nz", F.col("nz"))))


@query(with_tables("grid", f""", s AS (SELECT max(j) + 1 AS n FROM grid), k AS (SELECT CAST(unnest(range(0, 40)) AS INTEGER) AS k), l AS (SELECT k, greatest(1, 64 >> k) AS w, greatest(1, CAST(n AS BIGINT) >> k) AS hh FROM k, s WHERE greatest(64 >> k, CAST(n AS BIGINT) >> k) > 0), b AS (SELECT k, i >> k AS i, j >> k AS j, avg(h) AS h FROM grid, l WHERE (i >> k) < w AND (j >> k) < hh GROUP BY 1, 2, 3)
SELECT CAST(k AS BIGINT) AS level, i, j, {rounded('h')} // 10 AS h FROM b"""))
def mip_chain(spark, d):
    g = grid(spark, d)
    return view.levels(g, 64, height(g)).select("level", "i", "j", F.floor(micro(F.col("h")) / 10).cast("long").alias("h"))


@query()
def drawn_mesh(spark, d):
    g = grid(spark, d)
    size, mesh = (64, height(g)), (22, 101)
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("id"), (F.pmod(k, F.lit(640)) / 10.0 - 0.3).alias("i"), (F.pmod(k * 7, F.lit(size[1] * 10)) / 10.0 - 0.3).alias("j"))
    drawn = view.mesh_heights(p, view.mesh_vertices(g, mesh, size), mesh, size)
    both = raster.bilinear(p, g, *size).join(drawn, "id")
    u, v = (F.col("i") + 0.5) / size[0], (F.col("j") + 0.5) / size[1]
    blend = view.seam_blend(F.col("drawn"), F.col("sample"), u, v, F.pmod("id", F.lit(12)).cast("double"))
    return both.select("id", *whole(("drawn", F.col("drawn")), ("blend", blend), digits=2))


@query()
def ray_hits(spark, d):
    g = grid(spark, d)
    s = spec(height(g))
    km, k = s.metres_per_cell / 1000, F.col("c_custkey")
    x, z = (F.pmod(k, F.lit(64)) - 31.5) * km, (F.pmod(k * 13, F.lit(s.height)) - s.height / 2) * km
    down, turn = F.radians(F.pmod(k, F.lit(80)) + 8.5), F.radians(F.pmod(k * 29, F.lit(360)).cast("double"))
    rays = table(spark, d, "customer").select(k.alias("ray"), x.alias("ox"), F.lit(4.0).alias("oy"), z.alias("oz"), (F.cos(down) * F.cos(turn)).alias("dx"), (-F.sin(down)).alias("dy"), (F.cos(down) * F.sin(turn)).alias("dz"))
    return view.first_hits(rays, g, s, 1.5).select("ray", *whole(*[(c, F.col(c)) for c in ("t", "x", "y", "z")], digits=3))


@query()
def hidden_markers(spark, d):
    g = grid(spark, d)
    s = spec(height(g))
    km, k = s.metres_per_cell / 1000, F.col("s_suppkey")
    m = table(spark, d, "supplier").select(k.alias("m"), ((F.pmod(k * 7, F.lit(64)) - 31.5) * km).alias("x"), F.lit(1.56).alias("y"), ((F.pmod(k * 13, F.lit(s.height)) - s.height / 2) * km).alias("z"))
    return view.occluded(m, (0.0, 2.6, 0.0), g, s, 1.0)


@query()
def shadow_map(spark, d):
    g = grid(spark, d)
    lit = view.shadows(g, 64, height(g), 0.3, SUN, 1.0, steps=48, step_km=0.15)
    return lit.select("i", "j", *whole(("lit", F.col("lit")), digits=2))


HASH = "(SELECT xor(w >> 22, w) FROM (SELECT CAST(CAST(xor(h >> CAST((h >> 28) + 4 AS BIGINT), h) AS HUGEINT) * 277803737 % 4294967296 AS BIGINT) AS w FROM (SELECT CAST((CAST({x} AS HUGEINT) * 747796405 + 2891336453) % 4294967296 AS BIGINT) AS h)))"


@query(with_tables("grid", f", s AS (SELECT row_number() OVER (ORDER BY j, i) - 1 AS idx, i, j FROM grid WHERE h >= 1300), c AS (SELECT count(*) AS n FROM s), a AS (SELECT c_custkey AS id, {HASH.format(x='c_custkey')} AS p, {HASH.format(x='7')} AS q FROM customer WHERE c_custkey % 3 = 0), b AS (SELECT id, xor(p, q) AS x FROM a), d AS (SELECT id, {HASH.format(x='b.x')} % n AS idx FROM b, c) SELECT id, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y, 0::DOUBLE AS age FROM d JOIN s USING (idx) UNION ALL SELECT c_custkey, 1.5::DOUBLE, 2.5::DOUBLE, 3::DOUBLE FROM customer WHERE c_custkey % 3 <> 0"))
def particle_respawn(spark, d):
    spawn = raster.numbered(grid(spark, d).where("h >= 1300"))
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("id"), F.lit(1.5).alias("x"), F.lit(2.5).alias("y"), F.lit(3.0).alias("age"), (k % 3 == 0).alias("dead"))
    return state.respawned(p, spawn, spawn.count(), 7).drop("dead")


# State


def ordered(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.row_number().over(w).cast("long").alias("n"), F.col("event_id"), F.col("value"))


def load_event():
    k = F.col("event_id") % 5
    return F.when(k == 0, "camera-in-range").when(k == 1, "load-start").when(k == 2, "load-ok").when(k == 3, "load-fail").otherwise("release")


def frames():
    return F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 7).cast("double") / 2 + 0.25)


def sheet_event():
    k, s = F.col("event_id") % 4, F.col("event_id") % 3
    return F.when(k == 0, "open-detail").when(k == 1, "close-detail").when(k == 2, "mode-snap").otherwise("detail-snap"), F.when(s == 0, "min").when(s == 1, "half").otherwise("full")


ORDERED = "o AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id, value FROM events)"


LOADED = ("WITH RECURSIVE " + ORDERED + """, e AS (SELECT key, n, CASE event_id % 5 WHEN 0 THEN 'camera-in-range' WHEN 1 THEN 'load-start' WHEN 2 THEN 'load-ok' WHEN 3 THEN 'load-fail' ELSE 'release' END AS event FROM o), c AS (SELECT key, max(n) AS last FROM e GROUP BY key),
f AS (SELECT key, CAST(0 AS BIGINT) AS n, 'idle' AS status FROM c UNION ALL SELECT f.key, e.n, CASE WHEN status IN ('idle', 'ready') AND event = 'camera-in-range' THEN 'requested' WHEN status = 'requested' AND event = 'load-start' THEN 'loading' WHEN status = 'loading' AND event = 'load-ok' THEN 'ready' WHEN status = 'loading' AND event = 'load-fail' THEN 'failed' WHEN status IN ('requested', 'ready') AND event = 'release' THEN 'idle' ELSE status END FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)
SELECT f.key, status FROM f JOIN c ON c.key = f.key AND f.n = c.last""")


@query(LOADED)
def loading_status(spark, d):
    return reducers.loading_status(ordered(spark, d).select("key", "n", load_event().alias("event")))


PENDING = ("WITH RECURSIVE " + ORDERED + ", e AS (SELECT key, n, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 7 AS DOUBLE) / 2 + 0.25 END AS frames FROM o), c AS (SELECT key, max(n) AS last FROM e GROUP BY key), f AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS p FROM c UNION ALL SELECT f.key, e.n, CAST(CASE WHEN frames IS NULL THEN greatest(p - 1, 0) WHEN frames >= 1 THEN greatest(p, floor(frames)) ELSE p END AS BIGINT) FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1) SELECT f.key, p AS pending FROM f JOIN c ON c.key = f.key AND f.n = c.last")


@query(PENDING)
def pending_frames(spark, d):
    return reducers.pending_frames(ordered(spark, d).select("key", "n", frames().alias("frames")))


@query("WITH RECURSIVE " + ORDERED + f", e AS (SELECT key, n, CAST(n * 50 + event_id % 400 * (n % 2) AS DOUBLE) AS t FROM o), c AS (SELECT key, max(n) AS last, any_value(t ORDER BY n) AS t0 FROM e WHERE true GROUP BY key), z AS (SELECT key, t AS t0 FROM e WHERE n = 1), f AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST(400 AS DOUBLE) AS m, t0 AS t FROM z UNION ALL SELECT f.key, e.n, CASE WHEN m + 3 * (least(120.0, e.t - f.t) / 1000) * 60 > 1100 THEN 390 + (m + 3 * (least(120.0, e.t - f.t) / 1000) * 60 - 1100) ELSE m + 3 * (least(120.0, e.t - f.t) / 1000) * 60 END, e.t FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1) SELECT f.key, {sql_whole(('minutes', 'm'))} FROM f JOIN c ON c.key = f.key AND f.n = c.last")
def playback_clock(spark, d):
    t = (F.col("n") * 50 + F.col("event_id") % 400 * (F.col("n") % 2)).cast("double")
    ticks = ordered(spark, d).select("key", "n", t.alias("t"))
    return reducers.playback(ticks, F.lit(400.0), F.lit(390.0), F.lit(1100.0), F.lit(3.0)).select("key", *whole(("minutes", F.col("minutes"))))


STACKED = ("WITH RECURSIVE " + ORDERED + """, e AS (SELECT key, n, CASE event_id % 4 WHEN 0 THEN 'open-detail' WHEN 1 THEN 'close-detail' WHEN 2 THEN 'mode-snap' ELSE 'detail-snap' END AS event, CASE event_id % 3 WHEN 0 THEN 'min' WHEN 1 THEN 'half' ELSE 'full' END AS snap FROM o), c AS (SELECT key, max(n) AS last FROM e GROUP BY key),
f AS (SELECT key, CAST(0 AS BIGINT) AS n, 'min' AS mode, false AS open, 'min' AS detail, 'half' AS resume FROM c UNION ALL SELECT f.key, e.n,
CASE event WHEN 'open-detail' THEN 'min' WHEN 'close-detail' THEN CASE WHEN open THEN resume ELSE mode END WHEN 'mode-snap' THEN CASE WHEN open AND snap = 'min' THEN 'min' ELSE snap END ELSE CASE WHEN NOT open THEN mode WHEN snap = 'min' THEN resume ELSE 'min' END END,
CASE event WHEN 'open-detail' THEN true WHEN 'close-detail' THEN false ELSE open END,
CASE event WHEN 'open-detail' THEN CASE WHEN open AND detail <> 'min' THEN detail ELSE 'half' END WHEN 'close-detail' THEN CASE WHEN open THEN 'min' ELSE detail END WHEN 'mode-snap' THEN CASE WHEN open AND snap <> 'min' THEN 'min' ELSE detail END ELSE CASE WHEN open THEN snap ELSE detail END END,
CASE event WHEN 'open-detail' THEN CASE WHEN open THEN resume ELSE mode END WHEN 'mode-snap' THEN CASE WHEN open AND snap <> 'min' THEN snap ELSE resume END ELSE resume END FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)
SELECT f.key, mode, open, detail, resume FROM f JOIN c ON c.key = f.key AND f.n = c.last""")


@query(STACKED)
def sheet_stack(spark, d):
    event, snap = sheet_event()
    return reducers.sheets(ordered(spark, d).select("key", "n", event.alias("event"), snap.alias("snap")))


def replay(spark, d, fold, types, out, **columns):
    """A fold over the events as a stream from files, run until it has read them all; events may be a year late."""
    at = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    # As a pattern, a path may be a file as well as a folder.
    e = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/[e]vents.parquet")
    e = e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("n"), *[c.alias(name) for name, c in columns.items()])
    return streams.replayed(streams.keyed(e, streams.Folded(fold, types), out, "366 days"), at)


@query(LOADED)
def loading_stream(spark, d):
    return replay(spark, d, folds.loading(), "event string", "status string", event=load_event())


@query(PENDING)
def pending_stream(spark, d):
    return replay(spark, d, folds.Pending(), "frames double", "pending long", frames=frames())


@query(STACKED)
def sheet_stream(spark, d):
    event, snap = sheet_event()
    return replay(spark, d, folds.sheets(), "event string, snap string", "mode string, open boolean, detail string, resume string", event=event, snap=snap)


@query()
def shadow_requests(spark, d):
    o = ordered(spark, d)
    return reducers.recomputed(o.select("key", "n", (F.col("n") * 0.11).alias("azimuth"), F.lit(30.0).alias("elevation"), (1 + F.floor(F.col("n") / 17) % 2).cast("double").alias("exaggeration"), (F.col("event_id") % 3 == 0).alias("final")))


@query("SELECT s_suppkey AS id FROM supplier, (SELECT count(*) AS c FROM supplier) WHERE ((s_suppkey - 1 - 11 * 4) % c + c) % c < 4")
def checked_markers(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") - 1).alias("idx"))
    return reducers.round_robin(s.withColumn("of", F.lit(s.count())), F.lit(11)).select("id")


@query("WITH " + ORDERED + f", s AS (SELECT key, n, CAST(n * 35 AS DOUBLE) AS t, value AS h FROM o), l AS (SELECT *, max(t) OVER (PARTITION BY key) AS last, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS k FROM s), u AS (SELECT * FROM l WHERE last - t <= 120 OR k <= 2), g AS (SELECT key, arg_min(t, n) AS t0, arg_min(h, n) AS h0, arg_max(t, n) AS t1, arg_max(h, n) AS h1 FROM u GROUP BY key) SELECT key, {sql_whole(('velocity', 'CASE WHEN t1 > t0 THEN (h1 - h0) / (t1 - t0) ELSE 0 END'))} FROM g")
def sheet_flings(spark, d):
    o = ordered(spark, d).select("key", "n", (F.col("n") * 35).cast("double").alias("t"), F.col("value").cast("double").alias("h"))
    return reducers.flings(o).select("key", *whole(("velocity", F.col("velocity"))))


@query("WITH " + ORDERED + f", m AS (SELECT key, n, CAST(event_id % 97 AS DOUBLE) AS ax, CAST(event_id % 89 AS DOUBLE) AS ay, CAST(event_id % 83 + 100 AS DOUBLE) AS bx, CAST(event_id % 79 AS DOUBLE) AS by_ FROM o), g AS (SELECT key, arg_min(ax, n) AS ax, arg_min(ay, n) AS ay, arg_min(bx, n) AS bx, arg_min(by_, n) AS by0, arg_max(ax, n) AS ax1, arg_max(ay, n) AS ay1, arg_max(bx, n) AS bx1, arg_max(by_, n) AS by1 FROM m GROUP BY key), t AS (SELECT *, degrees(atan2(by1 - ay1, bx1 - ax1) - atan2(by0 - ay, bx - ax)) AS turn FROM g) SELECT key, {sql_whole(('zoom', 'sqrt(pow(bx1 - ax1, 2) + pow(by1 - ay1, 2)) / sqrt(pow(bx - ax, 2) + pow(by0 - ay, 2))'), ('twist', 'fmod(turn + 540, 360) - 180'), ('pan_x', '(ax1 + bx1) / 2 - (ax + bx) / 2'), ('pan_y', '(ay1 + by1) / 2 - (ay + by0) / 2'), digits=2)} FROM t")
def pinch_gestures(spark, d):
    e = F.col("event_id")
    m = ordered(spark, d).select("key", "n", (e % 97).cast("double").alias("ax"), (e % 89).cast("double").alias("ay"), (e % 83 + 100).cast("double").alias("bx"), (e % 79).cast("double").alias("by"))
    return reducers.gestures(m).select("key", *whole(*[(c, F.col(c)) for c in ("zoom", "twist", "pan_x", "pan_y")], digits=2))
