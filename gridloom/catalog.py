"""Every query by name, over whole tables, each with the SQL that an independent engine runs for comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import geo, solar, text
from gridloom.functions.geo import GridSpec, micro
from gridloom.operators import hydro, joins, profile, raster
from gridloom.plans.iterate import checkpointed
from gridloom.registry import ORACLE_SQL, QUERIES, query, rounded
from gridloom.sources.tables import grid, height, points, samples, sites, table, tilted, with_tables, zones
from gridloom.streaming import state

DEM = GridSpec(10, 82048, 145664, 1024, 768)
LAT, LON = -24.1856, -65.2994

# Coordinates


@query(with_tables("points", f""", p AS (SELECT id, lon, lat, (lon + 180) / 360 * 262144.0 AS gx, (1 - asinh(tan(radians(lat))) / pi()) / 2 * 262144.0 AS gy FROM points),
g AS (SELECT *, (gx - {DEM.origin_x}) / 1.0 - 0.5 AS i, (gy - {DEM.origin_y}) / 1.0 - 0.5 AS j FROM p)
SELECT id, {rounded('radians(lon) * 6378137.0')} AS mx, {rounded('ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0')} // 1000 AS my, {rounded('i')} // 100 AS i, {rounded('j')} // 100 AS j,
{rounded('(i + 0.5 + ' + str(DEM.origin_x) + ') / 262144.0 * 360 - 180')} // 10 AS lon, {rounded('degrees(atan(sinh(pi() * (1 - 2 * (j + 0.5 + ' + str(DEM.origin_y) + ') / 262144.0))))')} // 10 AS lat,
i BETWEEN -0.5 AND {DEM.width} - 0.5 AND j BETWEEN -0.5 AND {DEM.height} - 0.5 AS inside FROM g"""))
def coord_roundtrip(spark, d):
    p = points(spark, d)
    mx, my = geo.mercator(F.col("lon"), F.col("lat"))
    i, j = DEM.of_lonlat(F.col("lon"), F.col("lat"))
    p = p.select("id", mx.alias("mx"), my.alias("my"), i.alias("i"), j.alias("j"))
    lon, lat = DEM.to_lonlat(F.col("i"), F.col("j"))
    cut = lambda x, n: (micro(x) / n).cast("long")
    return p.select("id", micro(F.col("mx")).alias("mx"), cut(F.col("my"), 1000).alias("my"), cut(F.col("i"), 100).alias("i"), cut(F.col("j"), 100).alias("j"), cut(lon, 10).alias("lon"), cut(lat, 10).alias("lat"), DEM.contains(F.col("i"), F.col("j")).alias("inside"))


@query(with_tables("points", f" SELECT id, {rounded('hypot((lon + 65.2994) * 111.0 * cos(radians(-24.1856)), (lat + 24.1856) * 111.0)'.replace('hypot(', 'sqrt(pow(').replace(', (lat', ', 2) + pow((lat').replace('* 111.0)', '* 111.0, 2))'))} // 10 AS km, {rounded('cos(radians(lat))')} // 10 AS ground FROM points"))
def world_distance(spark, d):
    km = geo.planar_km(F.lit(LON), F.lit(LAT), F.col("lon"), F.col("lat"))
    return points(spark, d).select("id", F.floor(micro(km) / 10).cast("long").alias("km"), F.floor(micro(F.cos(F.radians("lat"))) / 10).cast("long").alias("ground"))


# Rasters


@query(with_tables("grid", " SELECT i, j, CAST(((h * 7) % 256) * 256 + (h % 256) + ((i * 5) % 256) / 256.0 - 32768 AS DOUBLE) AS metres FROM grid"))
def terrarium_decode(spark, d):
    r, g, b = F.pmod(F.col("h") * 7, F.lit(256)), F.pmod("h", F.lit(256)), F.pmod(F.col("i") * 5, F.lit(256))
    return grid(spark, d).select("i", "j", (r * 256 + g + b / 256 - 32768).alias("metres"))


@query(with_tables("grid", " SELECT i, j, CAST(greatest(least(floor((h - 1000) * 60.5 + 0.5), 32767), -32768) AS BIGINT) AS code, CASE WHEN h - 700 <= 1 THEN 0 ELSE CAST(floor(log2(CAST(h - 700 AS DOUBLE)) * 256 + 0.5) AS BIGINT) END AS log_code FROM grid"))
def height_codec(spark, d):
    return grid(spark, d).select("i", "j", raster.int16((F.col("h") - 1000) * 60.5).alias("code"), raster.log_code(F.col("h") - 700).alias("log_code"))


@query(with_tables("grid", " SELECT i - 8 AS i, j - 100 AS j, h FROM grid WHERE i BETWEEN 8 AND 39 AND j BETWEEN 100 AND 163"))
def crop_window(spark, d):
    return raster.crop(grid(spark, d), 8, 100, 32, 64)


@query(with_tables("grid", f" SELECT i // 3 AS i, j // 3 AS j, {rounded('avg(h)')} AS h FROM grid GROUP BY 1, 2"))
def box_downsample(spark, d):
    return raster.box_downsample(grid(spark, d), 3).select("i", "j", micro(F.col("h")).alias("h"))


@query(with_tables("grid", " SELECT i, j, v FROM (SELECT i // 4 AS i, j // 4 AS j, (h // 100) % 4 AS v, row_number() OVER (PARTITION BY i // 4, j // 4 ORDER BY count(*) DESC, ((h // 100) % 4) <> 0 DESC, (h // 100) % 4) AS n FROM grid GROUP BY i // 4, j // 4, (h // 100) % 4) WHERE n = 1"))
def plurality_downsample(spark, d):
    cells = grid(spark, d).select("i", "j", F.pmod(F.floor(F.col("h") / 100), F.lit(4)).alias("v"))
    return raster.plurality_downsample(cells, 4)


@query(with_tables("grid", " SELECT min(h) AS min_h, max(h) AS max_h, round(avg(h), 2) AS mean_h, round(quantile_cont(h, 0.001), 6) AS p001, round(quantile_cont(h, 0.999), 6) AS p999 FROM grid"))
def elevation_stats(spark, d):
    s = raster.elevation_stats(grid(spark, d))
    return s.select("min_h", "max_h", F.round("mean_h", 2).alias("mean_h"), F.round("p001", 6).alias("p001"), F.round("p999", 6).alias("p999"))


BILINEAR = """SELECT {keys}, sum((CASE WHEN k % 2 = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN k >= 2 THEN fy ELSE 1 - fy END) * g.{v}) AS sample
FROM (SELECT *, i - floor(i) AS fx, j - floor(j) AS fy, unnest([0, 1, 2, 3]) AS k FROM clamped) p JOIN {cells} g ON g.i = least(floor(p.i) + k % 2, {w} - 1) AND g.j = least(floor(p.j) + k // 2, {h} - 1) GROUP BY {keys}"""


@query(with_tables("grid", ", hw AS (SELECT CAST(count(DISTINCT j) AS BIGINT) AS n FROM grid), half AS (SELECT i // 2 AS i, j // 2 AS j, avg(h) AS h FROM grid GROUP BY 1, 2), clamped AS (SELECT i AS fi, j AS fj, h AS full_h, greatest(least((i + 0.5) / 2 - 0.5, 31), 0) AS i, greatest(least((j + 0.5) / 2 - 0.5, (SELECT n FROM hw) // 2 - 1), 0) AS j FROM grid), s AS (" + BILINEAR.format(keys="fi, fj, full_h", cells="half", v="h", w=32, h="(SELECT n FROM hw) // 2") + ") SELECT round(max(abs(full_h - sample)), 6) AS max_e, round(avg(abs(full_h - sample)), 6) AS mean_e, round(quantile_cont(abs(full_h - sample), 0.99), 3) AS p99_e, round(avg(CASE WHEN abs(full_h - sample) > 20 THEN 1.0 ELSE 0.0 END), 4) AS share FROM s"))
def reconstruction_error(spark, d):
    g = grid(spark, d)
    e = raster.reconstruction_error(g, 64, g.select("j").distinct().count())
    return e.select(F.round("max_e", 6).alias("max_e"), F.round("mean_e", 6).alias("mean_e"), F.round("p99_e", 3).alias("p99_e"), F.round("share", 4).alias("share"))


@query(with_tables("grid", ", clamped AS (SELECT c_custkey AS id, greatest(least((c_custkey % 700) / 10.0 - 2, 63), 0) AS i, greatest(least((c_custkey % 21000) / 10.0 - 5, (SELECT max(j) FROM grid)), 0) AS j FROM customer) , s AS (" + BILINEAR.format(keys="id", cells="grid", v="h", w=64, h="(SELECT max(j) + 1 FROM grid)") + f") SELECT id, {rounded('sample')} AS sample FROM s"))
def bilinear_points(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("id"), (F.pmod(k, F.lit(700)) / 10.0 - 2).alias("i"), (F.pmod(k, F.lit(21000)) / 10.0 - 5).alias("j"))
    g = grid(spark, d)
    return raster.bilinear(p, g, 64, height(g)).select("id", micro(F.col("sample")).alias("sample"))


@query(with_tables("grid", """, n AS (SELECT i, j, h, coalesce(lag(h) OVER r, h) AS w, coalesce(lead(h) OVER r, h) AS e FROM grid WINDOW r AS (PARTITION BY j ORDER BY i)),
s AS (SELECT i, j, coalesce(lag(e - w) OVER c, e - w) + 2 * (e - w) + coalesce(lead(e - w) OVER c, e - w) AS dx, coalesce(lead(w + 2 * h + e) OVER c, w + 2 * h + e) - coalesce(lag(w + 2 * h + e) OVER c, w + 2 * h + e) AS dy FROM n WINDOW c AS (PARTITION BY i ORDER BY j)),
p AS (SELECT i, j, dx / 2400.0 AS p, dy / 2400.0 AS q FROM s)
SELECT i, j, CAST(floor(least(greatest((sin(radians(45.0)) - p * sin(radians(315.0)) * cos(radians(45.0)) + q * cos(radians(315.0)) * cos(radians(45.0))) / sqrt(p * p + q * q + 1), 0), 1) * 255 + 0.5) AS BIGINT) AS shade FROM p"""))
def hillshade(spark, d):
    return raster.hillshade(grid(spark, d), 300.0)


CLASSED = ", c AS (SELECT i, j, CASE WHEN h >= 1000 THEN 1 ELSE 0 END AS v FROM grid)"


def classed(spark, d):
    return grid(spark, d).select("i", "j", F.when(F.col("h") >= 1000, 1).otherwise(0).cast("long").alias("v"))


@query(with_tables("grid", CLASSED + " SELECT * FROM (SELECT i, j, coalesce(lead(v) OVER (PARTITION BY j ORDER BY i) <> v, false) AS east, coalesce(lead(v) OVER (PARTITION BY i ORDER BY j) <> v, false) AS south FROM c) WHERE east OR south"))
def class_borders(spark, d):
    return raster.borders(classed(spark, d))


@query(with_tables("grid", " SELECT min(i) AS min_i, min(j) AS min_j, max(i) AS max_i, max(j) AS max_j FROM grid WHERE h >= 1300"))
def cell_bounds(spark, d):
    return raster.bounds(grid(spark, d), F.col("h") >= 1300)


@query(with_tables("grid", """, s AS (SELECT i, j, h - 1000 AS a, lead(h - 1000) OVER (PARTITION BY j ORDER BY i) AS b FROM grid), q AS (SELECT i, j, a, b, lead(a) OVER w AS dd, lead(b) OVER w AS cc FROM s WINDOW w AS (PARTITION BY i ORDER BY j)),
k AS (SELECT i, j, CAST((a >= 0) AS BIGINT) + 2 * CAST((b >= 0) AS BIGINT) + 4 * CAST((cc >= 0) AS BIGINT) + 8 * CAST((dd >= 0) AS BIGINT) AS code FROM q WHERE b IS NOT NULL AND cc IS NOT NULL AND dd IS NOT NULL) SELECT * FROM k WHERE code BETWEEN 1 AND 14"""))
def outline_segments(spark, d):
    return raster.contour_segments(grid(spark, d).select("i", "j", (F.col("h") - 1000).alias("s")))


@query(with_tables("grid", """, w AS (SELECT i, j, h >= 1000 AS inside FROM grid ), m AS (SELECT a.i, a.j, a.inside, least(127, floor(sqrt(min((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j))) + 0.5)) AS d, greatest(-127, floor(-sqrt(min((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j))) + 0.5)) AS n FROM w a JOIN w b ON a.inside <> b.inside AND abs(a.j - b.j) <= 128 GROUP BY a.i, a.j, a.inside)
SELECT i, j, CAST(CASE WHEN inside THEN d ELSE n END AS BIGINT) AS s FROM m"""))
def sdf(spark, d):
    return raster.signed_distance(grid(spark, d).select("i", "j", (F.col("h") >= 1000).alias("inside")))


# Vectors


def zone_edges(spark, d):
    z = zones(spark, d)
    ring = F.array(*[F.struct(F.col(a).alias("x1"), F.col(b).alias("y1"), F.col(c).alias("x2"), F.col(e).alias("y2")) for a, b, c, e in (("x0", "y0", "x1", "y0"), ("x1", "y0", "x1", "y1"), ("x1", "y1", "x0", "y1"), ("x0", "y1", "x0", "y0"))])
    return z.select(F.col("cls").alias("ord"), F.lit(0).alias("poly"), F.explode(ring).alias("r")).select("ord", "poly", "r.*")


FILLED = ", f AS (SELECT i, j, max(cls) AS v FROM (SELECT cls, unnest(range(CAST(ceil(x0) AS BIGINT), CAST(ceil(x1) AS BIGINT))) AS i, j FROM (SELECT cls, x0, x1, unnest(range(CAST(ceil(y0) AS BIGINT), CAST(ceil(y1) AS BIGINT))) AS j FROM zones)) GROUP BY i, j)"


@query(with_tables("zones", FILLED + " SELECT * FROM f"))
def rasterize_zones(spark, d):
    return raster.rasterize(zone_edges(spark, d))


def cell_points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (F.pmod(k, F.lit(700)) / 10.0 - 2).alias("i"), (F.pmod(k, F.lit(5200)) / 10.0 - 5).alias("j"))


CELL_POINTS = ", p AS (SELECT c_custkey AS id, CAST((c_custkey % 700) / 10.0 - 2 AS DOUBLE) AS i, CAST((c_custkey % 5200) / 10.0 - 5 AS DOUBLE) AS j FROM customer)"


@query(with_tables("zones", FILLED + CELL_POINTS + """ SELECT id, coalesce(v, 0) AS cls, CASE WHEN f.v IS NULL THEN 'outside' ELSE coalesce(r_name, 'no region') END AS region
FROM p LEFT JOIN f ON f.i = floor(p.i + 0.5) AND f.j = floor(p.j + 0.5) LEFT JOIN zones z ON z.cls = f.v LEFT JOIN region ON r_regionkey = z.grp AND z.cls % 7 <> 0"""))
def zone_lookup(spark, d):
    cells = raster.rasterize(zone_edges(spark, d)).select(F.col("i").alias("ci"), F.col("j").alias("cj"), "v")
    p = cell_points(spark, d).withColumns({"ci": F.floor(F.col("i") + 0.5), "cj": F.floor(F.col("j") + 0.5)}).join(cells, ["ci", "cj"], "left")
    z = zones(spark, d).select(F.col("cls").alias("v"), F.when(F.col("cls") % 7 != 0, F.col("grp")).alias("grp"))
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("grp"), "r_name")
    out = p.join(z, "v", "left").join(r, "grp", "left")
    return out.select("id", F.coalesce("v", F.lit(0)).alias("cls"), F.when(F.col("v").isNull(), "outside").otherwise(F.coalesce("r_name", F.lit("no region"))).alias("region"))


@query(with_tables("zones", FILLED + " SELECT i, j, (z.grp * 50 + 40) % 256 AS r, (z.grp * 90) % 256 AS g, (z.grp * 130 + 20) % 256 AS b, 255 AS a FROM f JOIN zones z ON z.cls = f.v"))
def overlay(spark, d):
    z = zones(spark, d).select(F.col("cls").alias("v"), "grp")
    c = lambda m, o: F.pmod(F.col("grp") * m + o, F.lit(256))
    return raster.rasterize(zone_edges(spark, d)).join(z, "v").select("i", "j", c(50, 40).alias("r"), c(90, 0).alias("g"), c(130, 20).alias("b"), F.lit(255).alias("a"))


@query("SELECT CAST(n_nationkey AS BIGINT) + 1 AS cls, CAST(coalesce(r_regionkey, -1) AS BIGINT) AS grp FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 3 UNION ALL SELECT 0, -1")
def region_lut(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region").where("r_regionkey <> 3")
    lut = n.join(r, n.n_regionkey == r.r_regionkey, "left").select((F.col("n_nationkey").cast("long") + 1).alias("cls"), F.coalesce("r_regionkey", F.lit(-1)).cast("long").alias("grp"))
    return lut.unionByName(spark.range(1).select(F.col("id").alias("cls"), F.lit(-1).cast("long").alias("grp")))


@query("SELECT 'uncovered' AS problem, n_name AS name FROM nation WHERE n_regionkey = 3 UNION ALL SELECT 'unknown', r_name FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey // 2 FROM nation)")
def lut_violations(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    known = r.where("r_regionkey <> 3")
    uncovered = n.join(known, n.n_regionkey == known.r_regionkey, "left_anti").select(F.lit("uncovered").alias("problem"), F.col("n_name").alias("name"))
    used = n.select(F.floor(F.col("n_regionkey") / 2).alias("key"))
    return uncovered.unionByName(r.join(used, r.r_regionkey == used.key, "left_anti").select(F.lit("unknown").alias("problem"), F.col("r_name").alias("name")))


@query(with_tables("zones", CELL_POINTS + f""", m AS (SELECT id, cls, sqrt(pow(p.i - (x0 + x1) / 2, 2) + pow(p.j - (y0 + y1) / 2, 2)) AS d FROM p JOIN zones ON p.i BETWEEN x0 AND x1 AND p.j BETWEEN y0 AND y1),
g AS (SELECT a.id, a.cls, min(CASE WHEN b.cls IS NULL THEN NULL WHEN abs(b.d - a.d) > 0.001 THEN b.d - a.d WHEN b.cls < a.cls THEN -0.001 ELSE 0.001 END) AS margin FROM m a LEFT JOIN m b ON a.id = b.id AND a.cls <> b.cls GROUP BY a.id, a.cls), w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cls) AS n FROM g WHERE margin IS NULL OR margin >= 0) SELECT id, cls, {rounded('margin')} AS margin FROM w WHERE n = 1"""))
def voronoi_owner(spark, d):
    return joins.owner(joins.in_rectangles(cell_points(spark, d), zones(spark, d)), ["id"]).select("id", "cls", micro(F.col("margin")).alias("margin"))


@query(with_tables("zones", CELL_POINTS + " SELECT id, min(cls) AS cls FROM p JOIN zones ON p.i BETWEEN x0 AND x1 AND p.j BETWEEN y0 AND y1 GROUP BY id"))
def first_match_site(spark, d):
    return joins.first_match(joins.in_rectangles(cell_points(spark, d), zones(spark, d)), ["id"])


@query(with_tables("points sites", """, c AS (SELECT id, name, site, sqrt(pow((s.lon - p.lon) * 111.0 * cos(radians(p.lat)), 2) + pow((s.lat - p.lat) * 111.0, 2)) AS km FROM points p, sites s WHERE regexp_matches(s.name, '(?i)laguna|salar')),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, site) AS n FROM c WHERE km <= 25) SELECT points.id, coalesce(b.name, 'laguna o salar') AS name FROM points LEFT JOIN b ON b.id = points.id AND n = 1"""))
def nearest_named_site(spark, d):
    return joins.nearest_named(points(spark, d), sites(spark, d), "(?i)laguna|salar", 25.0, "laguna o salar")


TARGETS = ", t AS (SELECT tid, CAST(unnest([-5, 50, 130, 375, 1000, 99999]) AS DOUBLE) AS pos FROM (SELECT DISTINCT tid FROM samples))"


@query(with_tables("samples", TARGETS + f""", e AS (SELECT tid, min(distance) AS lo, max(distance) AS hi FROM samples GROUP BY tid), s AS (SELECT tid, distance AS d0, elevation AS e0, lead(distance) OVER w AS d1, lead(elevation) OVER w AS e1 FROM samples WINDOW w AS (PARTITION BY tid ORDER BY k)),
q AS (SELECT tid, pos, lo, least(greatest(pos, lo), hi) AS q FROM t JOIN e USING (tid)) SELECT q.tid, q.pos, {rounded('CASE WHEN s.d1 IS NULL OR q.q <= q.lo THEN s.e0 ELSE s.e0 + (s.e1 - s.e0) * (q.q - s.d0) / (s.d1 - s.d0) END')} AS elevation FROM q ASOF JOIN s ON q.tid = s.tid AND q.q >= s.d0"""))
def asof_sample(spark, d):
    s = samples(spark, d)
    t = s.select("tid").distinct().select("tid", F.explode(F.array(*[F.lit(float(x)) for x in (-5, 50, 130, 375, 1000, 99999)])).alias("at"))
    return joins.value_at(s, t, 100.0).select("tid", F.col("at").alias("pos"), micro(F.col("elevation")).alias("elevation"))


LINE = ", l AS (SELECT tid, k, CAST(k * 10 AS DOUBLE) AS x, coalesce(elevation, 0) AS y FROM samples)"


@query(with_tables("samples", LINE + f""", s AS (SELECT tid, k, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM l WINDOW w AS (PARTITION BY tid ORDER BY k)),
m AS (SELECT event_id AS id, k, pow(px - x - t * (x1 - x), 2) + pow(py - y - t * (y1 - y), 2) AS d2 FROM (SELECT *, greatest(0.0, least(1.0, ((px - x) * (x1 - x) + (py - y) * (y1 - y)) / ((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)))) AS t FROM (SELECT event_id, user_id, CAST(event_id % 97 AS DOUBLE) AS px, CAST(event_id % 211 AS DOUBLE) AS py FROM events) q JOIN s ON s.tid = q.user_id AND s.x1 IS NOT NULL))
SELECT id, min(k) AS k, {rounded('min(d2)')} AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, k) AS n FROM m) WHERE n = 1 GROUP BY id"""))
def polyline_nearest(spark, d):
    line = samples(spark, d).select("tid", "k", (F.col("k") * 10).cast("double").alias("x"), F.coalesce("elevation", F.lit(0.0)).alias("y"))
    e = table(spark, d, "events")
    targets = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("tid"), (F.col("event_id") % 97).cast("double").alias("px"), (F.col("event_id") % 211).cast("double").alias("py"))
    return joins.nearest_on_line(line, targets).select("id", "k", micro(F.col("d2")).alias("d2"))


NEAR = ", s AS (SELECT s_suppkey AS id, CAST((s_suppkey * 7919) % 1000 AS DOUBLE) AS x, CAST((s_suppkey * 104729) % 1000 AS DOUBLE) AS y FROM supplier), e AS (SELECT a.id AS u, b.id AS v FROM s a JOIN s b ON a.id <> b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 60)"


@query("WITH RECURSIVE " + NEAR[2:] + ", r AS (SELECT id AS node, id AS label FROM s UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.label) SELECT node, min(label) AS label FROM r GROUP BY node")
def proximity_components(spark, d):
    k = F.col("s_suppkey")
    p = table(spark, d, "supplier").select(k.alias("id"), F.pmod(k * 7919, F.lit(1000)).cast("double").alias("x"), F.pmod(k * 104729, F.lit(1000)).cast("double").alias("y"))
    return joins.proximity_labels(p, 60.0).withColumnRenamed("id", "node")


# Water

NEIGHBOURS = ", st AS (SELECT * FROM (VALUES (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, -1, 1), (5, -1, 0), (6, -1, -1), (7, 0, -1), (8, 1, -1)) AS v(code, di, dj))"
D8 = NEIGHBOURS + ", nb AS (SELECT a.i, a.j, a.h, b.h AS z, code, row_number() OVER (PARTITION BY a.i, a.j ORDER BY b.h, code) AS n FROM {g} a, st, {g} b WHERE b.i = a.i + di AND b.j = a.j + dj), d8 AS (SELECT i, j, CASE WHEN z < h THEN code ELSE 0 END AS dir FROM nb WHERE n = 1), ed AS (SELECT j * 64 + i AS src, CASE WHEN dir > 0 THEN j * 64 + i + dj * 64 + di END AS dst FROM d8 LEFT JOIN st ON code = dir)"
ACC = ", up AS (SELECT src AS node, dst FROM ed UNION ALL SELECT up.node, ed.dst FROM up JOIN ed ON ed.src = up.dst), acc AS (SELECT ed.src, 1 + count(up.node) AS acc FROM ed LEFT JOIN up ON up.dst = ed.src GROUP BY ed.src), term AS (SELECT up.node AS src, ed.src AS terminal FROM up JOIN ed ON up.dst = ed.src WHERE ed.dst IS NULL UNION ALL SELECT src, src FROM ed WHERE dst IS NULL)"


def flow(spark, d):
    return checkpointed(hydro.edges(hydro.d8(tilted(spark, d)), 64))


@query(with_tables("grid", D8.format(g="grid") + " SELECT i, j, CAST(dir AS BIGINT) AS dir FROM d8"))
def flow_d8(spark, d):
    return hydro.d8(grid(spark, d))


@query(with_tables("grid tilted", D8.format(g="tilted") + ACC + " SELECT src, acc FROM acc"))
def flow_accumulation(spark, d):
    return hydro.accumulation(flow(spark, d), 64)


@query(with_tables("grid tilted", D8.format(g="tilted") + ACC + " SELECT src, terminal FROM term"))
def flow_terminals(spark, d):
    return hydro.flow_terminals(flow(spark, d), 64)


@query(with_tables("grid tilted", D8.format(g="tilted") + ACC + " SELECT terminal, count(*) AS n_cells, any_value(acc.acc) AS outlet_acc FROM term JOIN acc ON acc.src = term.terminal GROUP BY terminal ORDER BY outlet_acc DESC, terminal LIMIT 8"))
def basin_labels(spark, d):
    g = flow(spark, d)
    return hydro.basins(hydro.flow_terminals(g, 64), hydro.accumulation(g, 64))


@query(with_tables("grid tilted", D8.format(g="tilted") + ACC + " SELECT CAST(acc AS DOUBLE) AS threshold FROM (SELECT acc, row_number() OVER (ORDER BY acc DESC) AS n, count(*) OVER () AS total FROM acc) WHERE n = ceil(total * 0.05)"))
def river_threshold(spark, d):
    return hydro.river_threshold(hydro.accumulation(flow(spark, d), 64), 0.05)


@query()
def fill_minimal(spark, d):
    g = grid(spark, d)
    return hydro.fill(g, 64, height(g), 0.0)


@query()
def fill_epsilon(spark, d):
    g = grid(spark, d)
    return hydro.fill(g, 64, height(g), 0.01).select("i", "j", F.round("f", 6).alias("f"))


@query()
def depressions(spark, d):
    cells = grid(spark, d)
    return hydro.depressions(cells, hydro.fill(cells, 64, height(cells), 0.0), 64)


@query(with_tables("grid", ", m AS (SELECT i, j, j * 64 + i AS id FROM grid WHERE h < 930), e AS (SELECT a.id AS u, b.id AS v FROM m a JOIN m b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1), r AS (SELECT id AS node, id AS label FROM m UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.label) SELECT node, min(label) AS label FROM r GROUP BY node"))
def cell_components(spark, d):
    return hydro.components(checkpointed(grid(spark, d).where("h < 930").select("i", "j")), 64)


# Series


@query(with_tables("samples", """, s AS (SELECT tid, elevation AS e, k, row_number() OVER (PARTITION BY tid ORDER BY k) AS n FROM samples WHERE elevation IS NOT NULL),
f AS (SELECT tid, n, e AS anchor, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down FROM s WHERE n = 1 UNION ALL SELECT s.tid, s.n, CASE WHEN abs(e - anchor) >= 25 THEN e ELSE anchor END, up + CASE WHEN e - anchor >= 25 THEN e - anchor ELSE 0 END, down + CASE WHEN anchor - e >= 25 THEN anchor - e ELSE 0 END FROM f JOIN s ON s.tid = f.tid AND s.n = f.n + 1),
b AS (SELECT tid, count(*) AS defined, min(e) AS min_e, max(e) AS max_e, arg_min(k, e * 1e6 + k) AS min_k, arg_max(k, e * 1e6 - k) AS max_k FROM s GROUP BY tid)
SELECT b.*, b.max_e - b.min_e AS span, (SELECT max(distance) FROM samples x WHERE x.tid = b.tid) AS total, f.up AS ascent, f.down AS descent FROM b JOIN f ON f.tid = b.tid AND f.n = b.defined WHERE defined >= 2"""))
def profile_stats(spark, d):
    return profile.profile_stats(samples(spark, d))


@query(with_tables("samples", LINE + f", st AS (SELECT tid, k, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM l WINDOW w AS (PARTITION BY tid ORDER BY k)) SELECT tid, k, {rounded('sum(step) OVER (PARTITION BY tid ORDER BY k)')} // 1000 AS along FROM st"))
def transect_distance(spark, d):
    line = samples(spark, d).select("tid", "k", (F.col("k") * 10).cast("double").alias("x"), F.coalesce("elevation", F.lit(0.0)).alias("y"))
    return profile.cumulative_distance(line).select("tid", "k", F.floor(micro(F.col("along")) / 1000).cast("long").alias("along"))


@query(with_tables("samples", f", l AS (SELECT tid, k, CAST(k * 3 AS DOUBLE) AS px, coalesce(elevation, 0) AS py, -20 - k / 50.0 AS lat FROM samples), st AS (SELECT tid, k, coalesce(sqrt(pow(px - lag(px) OVER w, 2) + pow(py - lag(py) OVER w, 2)) * 76.5 * cos(radians((lat + lag(lat) OVER w) / 2)), 0) AS step FROM l WINDOW w AS (PARTITION BY tid ORDER BY k)) SELECT tid, k, {rounded('sum(step) OVER (PARTITION BY tid ORDER BY k)')} // 10000 AS along FROM st"))
def transect_ground(spark, d):
    line = samples(spark, d).select("tid", "k", (F.col("k") * 3).cast("double").alias("px"), F.coalesce("elevation", F.lit(0.0)).alias("py"), (-20 - F.col("k") / 50.0).alias("lat"))
    return profile.ground_distance(line, 76.5).select("tid", "k", F.floor(micro(F.col("along")) / 10000).cast("long").alias("along"))


@query(with_tables("samples", """, r AS (SELECT tid, min(distance) AS ax, max(distance) - min(distance) AS sx, min(elevation) AS ay, max(elevation) - min(elevation) AS sy FROM samples GROUP BY tid), p AS (SELECT s.tid, k, elevation IS NOT NULL AS there, lag(elevation) OVER (PARTITION BY s.tid ORDER BY k) IS NOT NULL AS goes_on,
(distance - ax) / CASE WHEN sx > 0 THEN sx ELSE 1 END * 600 AS x, (1 - (elevation - ay + CASE WHEN sy > 0 THEN sy ELSE 1 END * 0.04) / (CASE WHEN sy > 0 THEN sy ELSE 1 END * 1.08)) * 160 AS y FROM samples s JOIN r USING (tid))
SELECT tid, coalesce(string_agg(CASE WHEN goes_on THEN 'L' ELSE 'M' END || printf('%.1f', floor(x * 10 + 0.5) / 10) || ',' || printf('%.1f', floor(y * 10 + 0.5) / 10), ' ' ORDER BY k) FILTER (there), '') AS path FROM p GROUP BY tid"""))
def chart_paths(spark, d):
    return profile.chart_path(samples(spark, d).select("tid", "k", F.col("distance").alias("x"), F.col("elevation").alias("y")), 600.0, 160.0)


@query("""WITH t AS (SELECT user_id AS key, epoch_us(ts) // 60000000 % 100000 AS t, event_id AS n FROM events), g AS (SELECT *, t - lag(t) OVER w AS gap FROM t WINDOW w AS (PARTITION BY key ORDER BY t, n)),
r AS (SELECT *, sum(CASE WHEN gap > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY t, n) AS run FROM g),
s AS (SELECT key, t, n, count(CASE WHEN gap <= 500 THEN gap END) OVER w AS intervals, sum(CASE WHEN gap <= 500 THEN gap END) OVER w AS total FROM r WINDOW w AS (PARTITION BY key, run ORDER BY t, n ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT key, t, n, intervals, CAST(CASE WHEN total > 0 THEN floor(intervals * 1000.0 / total * 1000 + 0.5) END AS BIGINT) AS fps FROM s""")
def frame_stats(spark, d):
    e = table(spark, d, "events")
    ticks = e.select(F.col("user_id").alias("key"), F.pmod(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60000000), F.lit(100000)).alias("t"), F.col("event_id").alias("n"))
    return profile.frame_stats(ticks).select("key", "t", "n", "intervals", F.floor(F.col("fps") * 1000 + 0.5).cast("long").alias("fps"))


@query("""WITH s AS (SELECT c_custkey AS id, c_acctbal AS low, c_acctbal + (c_custkey % 1000) AS high FROM customer), m AS (SELECT *, pow(10, floor(log10(nullif((high - low) / 5.0, 0)))) AS mag, (high - low) / 5.0 AS raw FROM s),
k AS (SELECT *, CASE WHEN high <= low THEN NULL WHEN mag * 10 <= raw THEN mag * 10 WHEN mag * 5 <= raw THEN mag * 5 WHEN mag * 2 <= raw THEN mag * 2 ELSE mag END AS step FROM m)
SELECT id, CAST(floor(step * 1e6 + 0.5) AS BIGINT) AS step, CAST(CASE WHEN high <= low THEN 1 ELSE greatest(floor((high + 1e-9) / step) - ceil(low / step - 1e-9) + 1, 0) END AS BIGINT) AS n_ticks FROM k""")
def nice_ticks(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("low"), (F.col("c_acctbal") + F.col("c_custkey") % 1000).alias("high"))
    guarded = profile.nice_ticks(c.where("high > low"), 5).unionByName(c.where("high <= low").select("*", F.lit(None).cast("double").alias("step"), F.array("low").alias("ticks")))
    return guarded.select("id", micro(F.col("step")).alias("step"), F.size("ticks").cast("long").alias("n_ticks"))


# The sun

GAMMA = "2 * pi() / (CASE WHEN year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0) THEN 366 ELSE 365 END) * (dayofyear(ts) - 1 + (hour(ts) + minute(ts) / 60.0 + floor(second(ts)) / 3600.0 - 12) / 24.0)"
DECL, EQT = solar.sql_series("g", solar.DECLINATION), solar.sql_series("g", solar.EQUATION_OF_TIME)


@query(f"""WITH a AS (SELECT event_id AS id, ts, {GAMMA} AS g FROM events), b AS (SELECT *, {DECL} AS decl, radians(((hour(ts) * 60 + minute(ts) + {EQT} + 4 * (-65.2994) + 1440) % 1440) / 4 - 180) AS ha FROM a),
c AS (SELECT id, degrees(acos(sin(radians(-24.1856)) * sin(decl) + cos(radians(-24.1856)) * cos(decl) * cos(ha))) AS zenith, -cos(decl) * sin(ha) AS east, cos(radians(-24.1856)) * sin(decl) - sin(radians(-24.1856)) * cos(decl) * cos(ha) AS north FROM b),
e AS (SELECT *, 90 - zenith AS el, tan(radians(90 - zenith)) AS t FROM c)
SELECT id, {rounded('zenith')} // 100 AS zenith, {rounded('(degrees(atan2(east, north)) + 360) % 360')} // 100 AS azimuth,
{rounded('el + CASE WHEN el > 85 THEN 0 WHEN el > 5 THEN (58.1 / t - 0.07 / pow(t, 3) + 0.000086 / pow(t, 5)) / 3600 WHEN el > -0.575 THEN (1735 + el * (-518.2 + el * (103.4 + el * (-12.79 + el * 0.711)))) / 3600 ELSE -20.772 / t / 3600 END')} // 100 AS elevation FROM e""")
def solar_position(spark, d):
    e, a, z = solar.position(F.col("ts"), LAT, LON)
    cut = lambda x: (micro(x) / 100).cast("long")
    t = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return t.select("id", cut(z).alias("zenith"), cut(a).alias("azimuth"), cut(e).alias("elevation"))


@query(f"""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR AS ts FROM events), a AS (SELECT day, {GAMMA} AS g FROM d), b AS (SELECT day, {DECL} AS decl, {EQT} AS eq FROM a),
h AS (SELECT *, degrees(acos(cos(radians(90.833)) / (cos(radians(-24.1856)) * cos(decl)) - tan(radians(-24.1856)) * tan(decl))) AS ha FROM b)
SELECT day, {rounded('720 - 4 * (-65.2994 + ha) - eq')} // 100 AS rise, {rounded('720 - 4 * (-65.2994 - ha) - eq')} // 100 AS set FROM h""")
def sunrise_sunset(spark, d):
    days = table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    rise, fall = solar.sunrise_sunset(F.col("day").cast("timestamp"), LAT, LON)
    return days.select("day", F.floor(micro(rise) / 100).cast("long").alias("rise"), F.floor(micro(fall) / 100).cast("long").alias("set"))


@query(f"""WITH h AS (SELECT y, m, unnest(range(-96, 96)) AS h FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders WHERE o_orderdate IS NOT NULL), (SELECT unnest([6, 12]) AS m)), t AS (SELECT y, m, h, make_timestamp(y, m, 21, 12, 0, 0) + h * INTERVAL 1 HOUR AS ts FROM h),
a AS (SELECT y, m, h, {GAMMA} AS g FROM t), s AS (SELECT y, m, sum({DECL} * CASE WHEN m = 6 THEN 1 ELSE -1 END * cos(2 * pi() / 8760 * h)) AS c, sum({DECL} * CASE WHEN m = 6 THEN 1 ELSE -1 END * sin(2 * pi() / 8760 * h)) AS s FROM a GROUP BY y, m)
SELECT CAST(y AS BIGINT) AS y, CAST(m AS BIGINT) AS m, CAST(floor(atan2(s, c) / (2 * pi() / 8760) + 0.5) AS BIGINT) AS hours FROM s""")
def solstice(spark, d):
    import math

    w = 2 * math.pi / 8760
    years = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("y")).where("y is not null").distinct()
    base = years.select("y", F.explode(F.array(F.lit(6).cast("long"), F.lit(12).cast("long"))).alias("m"))
    t = base.select("y", "m", F.explode(F.sequence(F.lit(-96), F.lit(95))).alias("h"))
    t = t.withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.make_timestamp("y", "m", F.lit(21), F.lit(12), F.lit(0), F.lit(0))) + F.col("h") * 3600))
    decl = solar.series(solar.fractional_year(F.col("ts")), solar.DECLINATION) * F.when(F.col("m") == 6, 1).otherwise(-1)
    s = t.groupBy("y", "m").agg(F.sum(decl * F.cos(w * F.col("h"))).alias("c"), F.sum(decl * F.sin(w * F.col("h"))).alias("s"))
    return s.select("y", "m", F.floor(F.atan2("s", "c") / w + 0.5).cast("long").alias("hours"))


# Records

WORDS = "SELECT doc_id, text, list_extract(string_split(text, ' '), 1) AS head FROM documents"


@query("SELECT doc_id, regexp_replace(strip_accents(lower(replace(text, 'ß', ''))), '[^a-z0-9]', '', 'g') AS key FROM documents")
def name_key(spark, d):
    # Sharp s has no base letter and falls to the pattern; in SQL it is taken out first, so that engines agree.
    return table(spark, d, "documents").select("doc_id", text.name_key(F.col("text")).alias("key"))


@query("SELECT doc_id FROM documents WHERE contains(strip_accents(lower(trim(text))), 'relement')")
def search_accentless(spark, d):
    return table(spark, d, "documents").where(text.matches(F.col("text"), " Rèlement ")).select("doc_id")


@query("""WITH u AS (SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=x' || CASE WHEN page_id % 2 = 0 THEN '&bar=2' ELSE '' END AS url FROM pages),
p AS (SELECT page_id, string_split(url, '?')[1] AS base, list_filter(string_split(substring(url, strpos(url, '?') + 1), '&'), lambda x: NOT starts_with(x, 'utm_')) AS q FROM u)
SELECT page_id, base || CASE WHEN array_to_string(q, '&') = '' OR len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS url FROM p""")
def clean_url(spark, d):
    u = F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_source=x"), F.when(F.col("page_id") % 2 == 0, "&bar=2").otherwise(""))
    return table(spark, d, "pages").select("page_id", text.strip_utm(u).alias("url"))


LICENCE = "CASE n_nationkey % 5 WHEN 0 THEN 'CC BY-SA 4.0' WHEN 1 THEN 'CC0' WHEN 2 THEN 'CC BY-NC 4.0' WHEN 3 THEN 'Public domain' ELSE 'CC BY 3' END"


@query(f"SELECT n_nationkey AS id, {LICENCE} AS licence, regexp_full_match({LICENCE}, '(CC BY(-SA)? \\d(\\.\\d)?|CC0|Public domain)') AS allowed, {LICENCE} LIKE 'CC BY%' AND n_regionkey = 2 AS dropped FROM nation")
def license_filter(spark, d):
    n = table(spark, d, "nation").withColumn("licence", F.expr(LICENCE))
    unattributed = F.col("licence").startswith("CC BY") & F.when(F.col("n_regionkey") == 2, F.lit(None)).otherwise(F.col("n_name")).isNull()
    return n.select(F.col("n_nationkey").alias("id"), "licence", text.licence_ok(F.col("licence")).alias("allowed"), unattributed.alias("dropped"))


@query("SELECT o_orderkey AS id, CAST(CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) WHEN 1 THEN -year(o_orderdate) END AS BIGINT) AS year FROM orders")
def wikidata_year(spark, d):
    y = F.date_format("o_orderdate", "yyyy")
    k = F.col("o_orderkey") % 3
    literal = F.when(k == 0, F.concat(F.lit("+"), y, F.lit("-00-00T00:00:00Z"))).when(k == 1, F.concat(F.lit("-"), y, F.lit("-01-01T00:00:00Z"))).otherwise(y)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.literal_year(literal).alias("year"))


@query(with_tables("points", " SELECT id, replace(format('{:,}', CAST(floor(CAST(id * 977 AS DOUBLE) / 2 + 0.5) AS BIGINT)), ',', '.') || ' m' AS metres, replace(printf('%.4f', abs(lat)), '.', ',') || CASE WHEN lat < 0 THEN '° S' ELSE '° N' END AS lat FROM points"))
def format_es(spark, d):
    return points(spark, d).select("id", text.metres_es((F.col("id") * 977).cast("double") / 2).alias("metres"), text.lat_es(F.col("lat")).alias("lat"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def orphans(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select(F.col("c_custkey").alias("id"))


@query("SELECT key, count(*) AS n FROM (SELECT s_suppkey AS key FROM supplier UNION ALL SELECT p_partkey * 3 FROM part) GROUP BY key HAVING count(*) > 1")
def duplicate_ids(spark, d):
    both = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key")).unionByName(table(spark, d, "part").select((F.col("p_partkey") * 3).alias("key")))
    return both.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(with_tables("points sites", f", o AS (SELECT site AS id, lon AS olon, lat AS olat FROM sites) SELECT points.id, CASE WHEN o.id IS NOT NULL AND coalesce(CASE WHEN points.id % 3 <> 0 THEN (points.id % 4) * 0.0005 END, 0) >= 0.001 THEN 'osm' ELSE 'wikidata' END AS source, {rounded('CASE WHEN o.id IS NOT NULL AND coalesce(CASE WHEN points.id % 3 <> 0 THEN (points.id % 4) * 0.0005 END, 0) >= 0.001 THEN olon ELSE lon END')} AS lon FROM points LEFT JOIN o ON o.id = points.id"))
def override_coordinate(spark, d):
    o = sites(spark, d).select(F.col("site").alias("id"), F.col("lon").alias("olon"), F.lit(True).alias("has"))
    precision = F.when(F.col("id") % 3 != 0, (F.col("id") % 4) * 0.0005)
    wins = F.col("has").isNotNull() & (F.coalesce(precision, F.lit(0.0)) >= 0.001)
    return points(spark, d).join(o, "id", "left").select("id", F.when(wins, "osm").otherwise("wikidata").alias("source"), micro(F.when(wins, F.col("olon")).otherwise(F.col("lon"))).alias("lon"))


@query("""WITH o AS (SELECT s_suppkey AS key, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier WHERE s_suppkey % 11 <> 0), n AS (SELECT s_suppkey AS key, CASE WHEN s_suppkey % 5 = 0 THEN s_name || '*' ELSE s_name END AS name, CAST(CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE s_nationkey END AS VARCHAR) AS nation FROM supplier WHERE s_suppkey % 13 <> 0),
f AS (SELECT key, unnest(['name', 'nation']) AS path, unnest([name, nation]) AS old FROM o), g AS (SELECT key, unnest(['name', 'nation']) AS path, unnest([name, nation]) AS new FROM n)
SELECT key, path, old, new FROM f FULL JOIN g USING (key, path) WHERE old IS DISTINCT FROM new""")
def record_diff(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    old = s.where("s_suppkey % 11 <> 0").select(k.alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    new = s.where("s_suppkey % 13 <> 0").select(k.alias("key"), F.when(k % 5 == 0, F.concat("s_name", F.lit("*"))).otherwise(F.col("s_name")).alias("name"), F.when(k % 9 == 0, 0).otherwise(F.col("s_nationkey")).alias("nation"))
    return joins.record_diff(old, new, "key")


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS bytes, CASE WHEN doc_id % 6 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'same' END AS verdict FROM documents")
def hash_verify(spark, d):
    docs = table(spark, d, "documents")
    manifest = docs.where("doc_id % 6 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("want"))
    verdict = F.when(F.col("want").isNull(), "missing").when(F.col("want") != F.col("sha256"), "changed").otherwise("same")
    have = docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
    return have.join(manifest, "doc_id", "left").select("doc_id", "sha256", "bytes", verdict.alias("verdict"))


@query("WITH b AS (SELECT source, doc_id // 1000 AS block, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h, count(*) AS n FROM documents GROUP BY source, block) SELECT source, sha256(string_agg(h, '' ORDER BY block)) AS input_hash, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY source")
def cache_verdict(spark, d):
    # A hash of the hashes of blocks of a thousand numbers, so that no list grows with a source.
    joined = lambda order, h: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, h))), lambda x: x["h"]), ""), 256)
    blocks = table(spark, d, "documents").withColumns({"block": F.floor(F.col("doc_id") / 1000), "h": F.sha2("text", 256)}).groupBy("source", "block").agg(joined("doc_id", "h").alias("h"), F.count(F.lit(1)).alias("n"))
    return blocks.groupBy("source").agg(joined("block", "h").alias("input_hash"), F.sum("n").alias("n"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey)
SELECT c_custkey AS id, c_name AS title, coalesce(n_name, 'none') AS place, coalesce(n, 0) AS photos, list_filter(['acct ' || CASE WHEN c_acctbal < 0 THEN 'minus' ELSE 'plus' END, CASE WHEN n IS NOT NULL THEN 'orders ' || n END], lambda x: x IS NOT NULL) AS facts, CAST(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 40 ELSE 25 END AS BIGINT) AS view_km
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON o_custkey = c_custkey""")
def place_cards(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(o, c.c_custkey == o.o_custkey, "left")
    facts = F.array_compact(F.array(F.concat(F.lit("acct "), F.when(F.col("c_acctbal") < 0, "minus").otherwise("plus")), F.concat(F.lit("orders "), F.col("n").cast("string"))))
    return j.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.coalesce("n_name", F.lit("none")).alias("place"), F.coalesce("n", F.lit(0)).alias("photos"), facts.alias("facts"), F.when(F.arrays_overlap(F.array("c_mktsegment"), F.array(F.lit("BUILDING"), F.lit("MACHINERY"))), 40).otherwise(25).cast("long").alias("view_km"))


# State


def wanted(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("item"), F.col("value").alias("d"))


@query("SELECT user_id AS key, event_id AS item, value AS d FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events) WHERE n <= 3")
def live_set(spark, d):
    return state.resident_set(wanted(spark, d), "key", 3)


@query("""WITH w AS (SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events) WHERE n <= 3),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS n FROM events WHERE (user_id, event_id) NOT IN (SELECT user_id, event_id FROM w)) SELECT user_id AS key, event_id AS item, n FROM f WHERE n <= 2""")
def evictions(spark, d):
    held = wanted(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("item"), F.col("ts").alias("used")), "item")
    return state.evictions(held, state.resident_set(wanted(spark, d), "key", 3), "key", 2)


@query(f"SELECT key, {rounded('sum(v)')} // 1000 AS peak FROM (SELECT user_id AS key, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 5 GROUP BY key")
def budget_peak(spark, d):
    w = Window.partitionBy("key").orderBy(F.desc("d"), "item")
    top = wanted(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 5")
    return top.groupBy("key").agg(F.floor(micro(F.sum("d")) / 1000).cast("long").alias("peak"))


@query(with_tables("grid", D8.format(g="grid") + f""", fl AS (SELECT d8.i, d8.j, dir, h - 400 AS acc FROM d8 JOIN grid USING (i, j)), p AS (SELECT c_custkey AS id, CAST(c_custkey % 63 AS DOUBLE) + 0.25 AS x, CAST(c_custkey % (SELECT max(j) FROM grid) AS DOUBLE) + 0.5 AS y, CAST(c_custkey % 95 AS DOUBLE) AS age FROM customer),
m AS (SELECT id, dir, x + coalesce(di, 0) * s AS x, y + coalesce(dj, 0) * s AS y, age + 0.5 AS age FROM (SELECT p.*, fl.dir, di, dj, 2.0 * (1 + CAST(0.1 AS DOUBLE) * log2(CAST(acc AS DOUBLE))) * 0.5 * CASE WHEN di <> 0 AND dj <> 0 THEN sqrt(0.5) ELSE 1 END AS s FROM p JOIN fl ON fl.i = floor(x) AND fl.j = floor(y) LEFT JOIN st ON code = fl.dir)),
a AS (SELECT *, x < 0 OR y < 0 OR x >= 63 OR y >= (SELECT max(j) FROM grid) AS off FROM m), b AS (SELECT id, x, y, off, CASE WHEN dir = 0 AND NOT off THEN greatest(age, 86) ELSE age END AS age FROM a)
SELECT id, {rounded('x')} AS x, {rounded('y')} AS y, CAST(age AS DOUBLE) AS age, off OR age >= 90 AS dead FROM b"""))
def particle_step(spark, d):
    g = grid(spark, d)
    rows = height(g)
    field = hydro.d8(g).join(g, ["i", "j"]).select("i", "j", "dir", (F.col("h") - 400).alias("acc"))
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("id"), (k % 63 + F.lit(0.25)).cast("double").alias("x"), (k % (rows - 1) + F.lit(0.5)).cast("double").alias("y"), (k % 95).cast("double").alias("age"))
    return state.particle_step(p, field, 64, rows, 0.5).select("id", micro(F.col("x")).alias("x"), micro(F.col("y")).alias("y"), "age", "dead")


@query("""WITH e AS (SELECT user_id AS key, epoch_us(ts) // 1000000 AS t, event_id AS n, CASE WHEN event_type IN ('click', 'view') THEN 'down' ELSE 'up' END AS kind, value AS v FROM events), p AS (SELECT *, lag(kind) OVER w AS was, lag(t) OVER w AS t0, lag(v) OVER w AS v0 FROM e WINDOW w AS (PARTITION BY key ORDER BY t, n))
SELECT key, t, n FROM p WHERE kind = 'up' AND was = 'down' AND t - t0 < 35000 AND abs(v - v0) < 80""")
def tap_detection(spark, d):
    e = table(spark, d, "events")
    p = e.select(F.col("user_id").alias("key"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"), F.col("event_id").alias("n"), F.when(F.col("event_type").isin("click", "view"), "down").otherwise("up").alias("kind"), F.col("value").alias("v"))
    return profile.taps(p, 35000, 80.0)


from gridloom import catalog_files, catalog_scene, catalog_view  # noqa: E402, F401

__all__ = ["ORACLE_SQL", "QUERIES"]
