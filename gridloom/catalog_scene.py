"""Queries of coordinates, scenes, strings, times, hashes, records and lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import geo, scene, text
from gridloom.functions.geo import GridSpec, micro
from gridloom.operators import screen
from gridloom.registry import query, rounded
from gridloom.sources.tables import grid, sites, table, with_tables

BASE = GridSpec(10, 82048, 145664, 1024, 768)
PATCH = GridSpec(14, 82200 * 16, 145700 * 16, 512, 384, 2)
AROUND, N10 = "40075016.685578488", "262144.0"
#: A view of the scene: column-major, something like a camera above and behind its middle.
VIEW = [1.2, 0.0, 0.0, 0.0, 0.0, 1.1, 0.6, 0.6, 0.0, -0.8, 0.8, 0.8, -3.0, 2.0, 40.0, 42.0]


def numbers(spark, d):
    """(id, e): customers, and an angle from -20 to 79.75."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.pmod("c_custkey", F.lit(400)) / 4 - 20).alias("e"))


NUMBERS = "WITH n AS (SELECT c_custkey AS id, CAST((c_custkey % 400) / 4 - 20 AS DOUBLE) AS e FROM customer)"


def whole(*columns, digits: int = 1):
    """Each (name, column) in units of 10**digits millionths, so that the last digits of two engines' functions do not matter."""
    return [F.floor(micro(c) / 10**digits).cast("long").alias(n) for n, c in columns]


def sql_whole(*columns, digits: int = 1) -> str:
    return ", ".join(f"CAST(floor({rounded(c)} / {10**digits}) AS BIGINT) AS {n}" for n, c in columns)


@query(NUMBERS + f", p AS (SELECT id, id % 1000 * 10000.0 - 5000000 AS x, id % 777 * 9000.0 - 3000000 AS y FROM n), q AS (SELECT *, (x / {AROUND} + 0.5) * {N10} AS px, (0.5 - y / {AROUND}) * {N10} AS py FROM p) SELECT id, {sql_whole(('px', 'px'), ('py', 'py'), ('x', f'(px / {N10} - 0.5) * {AROUND}'), ('y', f'(0.5 - py / {N10}) * {AROUND}'), ('metres', f'{AROUND} / {N10}'), digits=3)} FROM q")
def mercator_pixels(spark, d):
    p = numbers(spark, d).select("id", (F.pmod("id", F.lit(1000)) * 10000.0 - 5000000).alias("x"), (F.pmod("id", F.lit(777)) * 9000.0 - 3000000).alias("y"))
    px, py = geo.pixel_of_mercator(F.col("x"), F.col("y"), 10)
    q = p.select("id", px.alias("px"), py.alias("py"))
    x, y = geo.mercator_of_pixel(F.col("px"), F.col("py"), 10)
    return q.select("id", *whole(("px", F.col("px")), ("py", F.col("py")), ("x", x), ("y", y), ("metres", F.lit(geo.metres_per_pixel(10))), digits=3))


LAT = "degrees(atan(sinh(pi() * (1 - 2 * ({y}) / 262144.0))))"


GRIDS = "g AS (SELECT id, CAST(8 + id % 4 AS BIGINT) AS zoom, CAST(id * 37 % 40000 AS BIGINT) AS x, CAST(id * 91 % 40000 AS BIGINT) AS y, CAST(100 + id % 900 AS BIGINT) AS w, CAST(80 + id % 700 AS BIGINT) AS h, CAST(1 + id % 2 AS BIGINT) AS s FROM n), e AS (SELECT *, CAST(x + w * s AS DOUBLE) AS x1, CAST(y + h * s AS DOUBLE) AS y1, pow(2.0, zoom) * 256 AS px FROM g)"


@query(NUMBERS + f", {GRIDS} SELECT id, CAST(x AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0, x1, y1, {sql_whole(('west', 'x / px * 360 - 180'), ('south', 'degrees(atan(sinh(pi() * (1 - 2 * y1 / px))))'), ('east', 'x1 / px * 360 - 180'), ('north', 'degrees(atan(sinh(pi() * (1 - 2 * y / px))))'))}, id % 3 = 0 AS same, CAST(ceil(w / 3.0) AS BIGINT) AS coarse_width, CAST(y + ceil(h / 3.0) * s * 3 AS DOUBLE) AS coarse_bottom FROM e")
def grid_extent(spark, d):
    """Extents of grids in two units, whether a grid of the next zoom covers the same ground, and a coarser grid of each."""
    k = F.col("id")
    whole_ = lambda c: c.cast("long")
    g = geo.Grids(whole_(8 + k % 4), whole_(k * 37 % 40000), whole_(k * 91 % 40000), whole_(100 + k % 900), whole_(80 + k % 700), whole_(1 + k % 2))
    finer = geo.Grids(g.zoom + 1, g.origin_x * 2 + k % 3, g.origin_y * 2, g.width * 2, g.height * 2, g.scale)
    coarse = g.coarser(3)
    return numbers(spark, d).select("id", *[c.alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), g.extent_pixels())], *whole(*zip(("west", "south", "east", "north"), g.extent_degrees())), g.same_ground(finer).alias("same"), coarse.width.alias("coarse_width"), coarse.extent_pixels()[3].alias("coarse_bottom"))


CELL_KM = f"({AROUND} / 262144.0 * cos(radians({LAT.format(y='145664 + 384')})) / 1000)"


@query(NUMBERS + f", g AS (SELECT id, id % 1100 - 20.0 AS i, id % 800 - 10.0 AS j FROM n), w AS (SELECT *, (i + 0.5 - 512) * {CELL_KM} AS x, (j + 0.5 - 384) * {CELL_KM} AS z FROM g) SELECT id, {sql_whole(('x', 'x'), ('z', 'z'), ('i', f'x / {CELL_KM} + 511.5'), ('j', f'z / {CELL_KM} + 383.5'), ('wide', f'{CELL_KM} * 1024'), digits=2)} FROM w")
def world_grid(spark, d):
    g = numbers(spark, d).select("id", (F.pmod("id", F.lit(1100)) - 20.0).alias("i"), (F.pmod("id", F.lit(800)) - 10.0).alias("j"))
    x, z = BASE.to_world(F.col("i"), F.col("j"))
    w = g.select("id", x.alias("x"), z.alias("z"))
    i, j = BASE.of_world(F.col("x"), F.col("z"))
    return w.select("id", *whole(("x", F.col("x")), ("z", F.col("z")), ("i", i), ("j", j), ("wide", F.lit(BASE.size_km[0])), digits=2))


@query(NUMBERS + """, g AS (SELECT id, CAST(id % 512 AS DOUBLE) AS gi, CAST(id % 384 AS DOUBLE) AS gj FROM n), b AS (SELECT *, (gi + 0.5) * 0.125 + (82200 - 82048) - 0.5 AS bi, (gj + 0.5) * 0.125 + (145700 - 145664) - 0.5 AS bj FROM g)
SELECT id, bi, bj, (bi + 0.5 - 152) * 8 - 0.5 AS gi, (bj + 0.5 - 36) * 8 - 0.5 AS gj, 151.5::DOUBLE AS x0, 35.5::DOUBLE AS y0, 215.5::DOUBLE AS x1, 83.5::DOUBLE AS y1, 183.5::DOUBLE AS cx, 59.5::DOUBLE AS cy FROM b""")
def patch_maps(spark, d):
    k, cx, cy = PATCH.patch_on(BASE)
    g = numbers(spark, d).select("id", F.pmod("id", F.lit(512)).cast("double").alias("gi"), F.pmod("id", F.lit(384)).cast("double").alias("gj"))
    b = g.select("id", ((F.col("gi") + 0.5) * k + cx).alias("bi"), ((F.col("gj") + 0.5) * k + cy).alias("bj"))
    names = zip(("x0", "y0", "x1", "y1", "cx", "cy"), (*PATCH.rect_on(BASE), *PATCH.centre_on(BASE)))
    return b.select("id", "bi", "bj", ((F.col("bi") - cx) / k - 0.5).alias("gi"), ((F.col("bj") - cy) / k - 0.5).alias("gj"), *[F.lit(v).alias(n) for n, v in names])


SITES = "r AS (SELECT id, id % 7 + 10 AS zf, id % 5 + 8 AS zc, CAST(1000 + id % 300 AS BIGINT) AS fx, CAST(1000 + id % 300 + id % 4 - CASE WHEN id % 50 = 0 THEN 9 ELSE 0 END AS BIGINT) AS fx1, CAST(900 + id % 200 AS BIGINT) AS fy, CAST(900 + id % 200 + id % 3 AS BIGINT) AS fy1 FROM n), t AS (SELECT *, pow(2, least(greatest(zf - zc, 0), 8)) AS f FROM r), c AS (SELECT *, CAST(floor(fx / f) AS BIGINT) AS cx, CAST(floor(fx1 / f) AS BIGINT) + id % 2 AS cx1, CAST(floor(fy / f) AS BIGINT) + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS cy, CAST(floor(fy1 / f) AS BIGINT) + 1 AS cy1 FROM t), h AS (SELECT *, CAST(floor(fx * 256 / f) AS BIGINT) AS hx, CAST(floor(fy * 256 / f) AS BIGINT) AS hy, CAST(floor((fx1 - fx + 1) * 256 / f) AS BIGINT) AS hw, CAST(floor((fy1 - fy + 1) * 256 / f) AS BIGINT) AS hh FROM c)"


@query(NUMBERS + f""", {SITES}, p AS (SELECT *, CASE WHEN fx1 < fx OR fy1 < fy OR cx1 < cx OR cy1 < cy THEN 'invalid tile range' WHEN zf < zc OR zf - zc > 8 THEN 'zooms do not divide a tile' WHEN hx < cx * 256 OR hy < cy * 256 OR hx - cx * 256 + hw > (cx1 - cx + 1) * 256 OR hy - cy * 256 + hh > (cy1 - cy + 1) * 256 THEN 'the image is not covered' END AS problem FROM h)
SELECT id, problem, fx * 256 AS image_x, (fx1 - fx + 1) * 256 AS image_width, hy AS heights_y, hh AS heights_height, cx * 256 AS mosaic_x, (cy1 - cy + 1) * 256 AS mosaic_height, CASE WHEN problem IS NULL THEN hx - cx * 256 END AS window_x, CASE WHEN problem IS NULL THEN hy - cy * 256 END AS window_y FROM p""")
def site_windows(spark, d):
    """Image, heights and mosaic of sites given by their tile ranges, and what is wrong with those."""
    k = F.col("id")
    r = numbers(spark, d).select("id", (k % 7 + 10).cast("int").alias("zf"), (k % 5 + 8).cast("int").alias("zc"), (1000 + k % 300).alias("fx"), (1000 + k % 300 + k % 4 - F.when(k % 50 == 0, 9).otherwise(0)).alias("fx1"), (900 + k % 200).alias("fy"), (900 + k % 200 + k % 3).alias("fy1"))
    down = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.least(F.greatest(F.col("zf") - F.col("zc"), F.lit(0)), F.lit(8))))
    r = r.select("*", down("fx").alias("cx"), (down("fx1") + k % 2).alias("cx1"), (down("fy") + F.when(k % 11 == 0, 1).otherwise(0)).alias("cy"), (down("fy1") + 1).alias("cy1"))
    w = geo.site_windows(tuple(map(F.col, ("zf", "fx", "fx1", "fy", "fy1"))), tuple(map(F.col, ("zc", "cx", "cx1", "cy", "cy1"))))
    s = r.select("id", *[c.alias(n) for n, c in w.items()])
    ok = F.col("problem").isNull()
    return s.select("id", "problem", F.col("image.x").alias("image_x"), F.col("image.width").alias("image_width"), F.col("heights.y").alias("heights_y"), F.col("heights.height").alias("heights_height"), F.col("mosaic.x").alias("mosaic_x"), F.col("mosaic.height").alias("mosaic_height"), F.when(ok, F.col("window.x")).alias("window_x"), F.when(ok, F.col("window.y")).alias("window_y"))


@query(with_tables("zones", " SELECT cls, CAST(floor((ceil(x0) - 0.5 + 0.5) / 3 - 0.5 + 0.5) AS BIGINT) AS i0, CAST(floor((ceil(y0) - 0.5 + 0.5) / 3 - 0.5 + 0.5) AS BIGINT) AS j0, CAST(ceil((floor(x1) + 0.5 + 0.5) / 3 - 0.5 - 0.5) AS BIGINT) AS i1, CAST(ceil((floor(y1) + 0.5 + 0.5) / 3 - 0.5 - 0.5) AS BIGINT) AS j1 FROM zones"))
def box_on_grid(spark, d):
    from gridloom.sources.tables import zones

    box = (F.ceil("x0"), F.ceil("y0"), F.floor("x1"), F.floor("y1"))
    return zones(spark, d).select("cls", *[c.cast("long").alias(n) for n, c in zip(("i0", "j0", "i1", "j1"), BASE.box_on(BASE.coarser(3), box))])


@query(NUMBERS + f", c AS (SELECT *, e * 30 AS sdf, id % 5000 + 100.0 AS m FROM n) SELECT id, {sql_whole(('drawn', 'CASE WHEN sdf >= 0 THEN m ELSE ((26 / 1000.0 * 1.5 - 10 + 0.6) * 1000 / 1.5 + m * 0.2) END'), ('cut', 'm / 1000 * 1.5'), ('rim', '26 / 1000.0 * 1.5 - 10 + 0.6 + m / 1000 * 1.5 * 0.2'), ('si', '(id % 64 + 0.5) * 32 / 64 - 0.5'), ('sj', '(id % 500 + 0.5) * 250 / 500 - 0.5'), ('margin', '26 - ((26 / 1000.0 * 1.5 - 10 + 0.6) * 1000 / 1.5 + 26 * 0.2)'))} FROM c")
def context_flatten(spark, d):
    m = (F.pmod("id", F.lit(5000)) + 100.0).cast("double")
    cut, rim = scene.wall_tops(m, 26.0, 1.5)
    si, sj = geo.sdf_cell(F.pmod("id", F.lit(64)), F.pmod("id", F.lit(500)), (64, 500), (32, 250))
    return numbers(spark, d).select("id", *whole(("drawn", scene.drawn_metres(m, F.col("e") * 30, 26.0, 1.5)), ("cut", cut), ("rim", rim), ("si", si), ("sj", sj), ("margin", F.lit(scene.flat_margin(26.0, 1.5)))))


def sql_smooth(a: float, b: float, x: str) -> str:
    t = f"least(greatest(({x} - ({a})) / ({b} - ({a})), 0.0), 1.0)"
    return f"({t} * {t} * (3 - 2 * {t}))"


@query(NUMBERS + f""", s AS (SELECT id, e, radians(CAST(id % 360 AS DOUBLE)) AS az, radians(e) AS el, {sql_smooth(-1, 5, 'e')} AS st, {sql_smooth(-1, 35, 'e')} AS wh, {sql_smooth(-6, 4, 'e')} AS da, 1 - {sql_smooth(-2, 28, 'e')} AS wa, {sql_smooth(-8, -1, 'e')} AS sk FROM n)
SELECT id, {sql_whole(('east', 'sin(az) * cos(el)'), ('up', 'sin(el)'), ('south', '-cos(az) * cos(el)'), ('green', '(0.38 + 0.62 * wh) * st * 0.85'), ('blue', '(0.1 + 0.9 * wh) * st * 0.85'), ('air', '0.05 + 0.37 * da'), ('sky', '0.28 + (1 + (0.42 - 1) * wa * 0.8 - 0.28) * sk + 1.3e-7'), ('apart', 'degrees(acos(least(greatest(sin(el), -1), 1)))'), digits=2)} FROM s""")
def sun_look(spark, d):
    s = numbers(spark, d).select("id", scene.look(F.pmod("id", F.lit(360)).cast("double"), F.col("e")).alias("l"))
    at = lambda name, k: F.get(F.col(f"l.{name}"), F.lit(k))
    ways = [at("direction", k) for k in range(3)]
    apart = scene.angle_between(ways, (F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    return s.select("id", *whole(*zip(("east", "up", "south"), ways), ("green", at("sun", 1)), ("blue", at("sun", 2)), ("air", at("air", 0)), ("sky", at("sky", 2) + 1.3e-7), ("apart", apart), digits=2))


@query(NUMBERS + f", p AS (SELECT id, CAST(id % 720 - 360 AS DOUBLE) AS a, CAST(id * 7 % 720 - 360 AS DOUBLE) AS b, (id % 101) / 100.0 AS t FROM n) SELECT id, {sql_whole(('angle', 'a + ((b - a + 540) - 360 * trunc((b - a + 540) / 360) - 180) * t'), ('eased', 'CASE WHEN t < 0.5 THEN 4 * t * t * t ELSE 1 - pow(2 - 2 * t, 3) / 2 END'))} FROM p")
def pose_path(spark, d):
    p = numbers(spark, d).select("id", (F.pmod("id", F.lit(720)) - 360).cast("double").alias("a"), (F.pmod(F.col("id") * 7, F.lit(720)) - 360).cast("double").alias("b"), (F.pmod("id", F.lit(101)) / 100.0).alias("t"))
    return p.select("id", *whole(("angle", scene.angle_lerp(F.col("a"), F.col("b"), F.col("t"))), ("eased", scene.ease(F.col("t")))))


@query("SELECT c_custkey AS id, CAST(CASE WHEN c_acctbal > 0 THEN least(greatest(ceil(c_acctbal * 10 / 45.0) + 1, 96), 2048) ELSE 96 END AS BIGINT) AS samples, CASE WHEN c_acctbal <= 0 THEN 12.0 WHEN c_custkey % 9 = 0 THEN c_acctbal ELSE least(c_acctbal, greatest(12.0, c_acctbal * (c_custkey % 9 * 10) / 66)) END AS km FROM customer")
def sampling_sizes(spark, d):
    b, k = F.col("c_acctbal"), F.pmod("c_custkey", F.lit(9))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), scene.sample_count(b * 10, F.lit(90.0)).alias("samples"), scene.zoom_distance(b, (k * 10).cast("double")).alias("km"))


def _row(r: int) -> str:
    return f"({VIEW[r]} * x + {VIEW[4 + r]} * y + {VIEW[8 + r]} * z + {VIEW[12 + r]})"


@query(NUMBERS + f", w AS (SELECT id, CAST(id % 90 - 45 AS DOUBLE) AS x, CAST(id % 7 AS DOUBLE) AS y, CAST(id % 140 - 90 AS DOUBLE) AS z FROM n), p AS (SELECT *, {_row(3)} AS w, {_row(0)} AS a, {_row(1)} AS b FROM w), s AS (SELECT *, CASE WHEN w > 0 THEN (a / w + 1) / 2 * 800 END AS sx, CASE WHEN w > 0 THEN (1 - b / w) / 2 * 600 END AS sy FROM p) SELECT id, {sql_whole(('sx', 'sx'), ('sy', 'sy'))}, coalesce(sx BETWEEN -24 AND 824 AND sy BETWEEN -24 AND 624, false) AS shown, sqrt(pow(x - 5, 2) + pow(z - 9, 2)) < 30 AS near FROM s")
def projected_markers(spark, d):
    w = numbers(spark, d).select("id", (F.pmod("id", F.lit(90)) - 45).cast("double").alias("x"), F.pmod("id", F.lit(7)).cast("double").alias("y"), (F.pmod("id", F.lit(140)) - 90).cast("double").alias("z"))
    x, y = scene.projected(VIEW, F.col("x"), F.col("y"), F.col("z"), 800.0, 600.0)
    near = scene.within(F.col("x"), F.col("z"), F.lit(5.0), F.lit(9.0), 30.0)
    return w.select("id", *whole(("sx", x), ("sy", y)), scene.on_screen(x, y, 800.0, 600.0).alias("shown"), near.alias("near"))


def _planes() -> str:
    rows = ["(1, 3, 0)", "(-1, 3, 0)", "(1, 3, 1)", "(-1, 3, 1)", "(1, 2, NULL)", "(-1, 3, 2)"]
    m = ", ".join(f"({r}, {VIEW[r]}, {VIEW[4 + r]}, {VIEW[8 + r]}, {VIEW[12 + r]})" for r in range(4))
    return f"m AS (SELECT * FROM (VALUES {m}) v(r, a, b, c, d)), pl AS (SELECT row_number() OVER () AS p, u.a + s * coalesce(v.a, 0) AS a, u.b + s * coalesce(v.b, 0) AS b, u.c + s * coalesce(v.c, 0) AS c, u.d + s * coalesce(v.d, 0) AS d FROM (VALUES {', '.join(rows)}) x(s, r1, r2) JOIN m u ON u.r = r1 LEFT JOIN m v ON v.r = r2)"


@query(NUMBERS + ", " + _planes() + ", k AS (SELECT id, id % 90 - 45 + sx * (1.0 + id % 5) AS x, y, id % 140 - 90 + sz * (1.0 + id % 3) AS z FROM n, (VALUES (-1), (1)) a(sx), (VALUES (-1), (1)) b(sz), (VALUES (0.5), (6.0)) c(y)), e AS (SELECT id, p, max(a * x + b * y + c * z + d) AS best FROM k, pl GROUP BY id, p) SELECT id, min(best) >= 0 AS seen FROM e GROUP BY id")
def boxes_in_view(spark, d):
    i = F.col("id")
    seen = scene.in_frustum(VIEW, (F.pmod(i, F.lit(90)) - 45).cast("double"), (F.pmod(i, F.lit(140)) - 90).cast("double"), F.pmod(i, F.lit(5)) + 1.0, F.pmod(i, F.lit(3)) + 1.0, F.lit(0.5), F.lit(6.0))
    return numbers(spark, d).select("id", seen.alias("seen"))


@query("WITH RECURSIVE s AS (SELECT p_partkey AS id, CAST(p_size * 37 AS BIGINT) AS w, CAST(p_size * 11 + 1 AS BIGINT) AS h FROM part), l AS (SELECT id, w, h, 1 AS level, w * h * 4 AS bytes FROM s UNION ALL SELECT id, greatest(1, w // 2), greatest(1, h // 2), level + 1, greatest(1, w // 2) * greatest(1, h // 2) * 4 FROM l WHERE w > 1 OR h > 1), t AS (SELECT id, max(level) AS levels, sum(bytes) AS bytes FROM l GROUP BY id) SELECT id, CAST(levels AS BIGINT) AS levels, CAST(bytes AS BIGINT) AS bytes, CAST(sum(bytes) OVER () AS BIGINT) AS total FROM t")
def memory_report(spark, d):
    w, h = (F.col("p_size") * 37).cast("long"), (F.col("p_size") * 11 + 1).cast("long")
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), scene.mip_levels(w, h).alias("levels"), scene.texture_bytes(w, h).alias("bytes"))
    return t.join(F.broadcast(t.agg(F.sum("bytes").alias("total")).withColumn("one", F.lit(1))), F.lit(1) == F.col("one")).select("id", "levels", "bytes", "total")


@query(NUMBERS + f" SELECT id, {sql_whole(('gi', 'id % 300 * (1024 / 299.0) - 0.5'), ('gj', 'id % 200 * (768 / 199.0) - 0.5'), ('near', 'e * 1.6'), ('far', 'e * 2.6'))} FROM n")
def mesh_uniforms(spark, d):
    near, far = scene.haze_range(F.col("e"))
    mesh = lambda m, k, size: F.pmod("id", F.lit(m)) * (size / (m - 1)) - 0.5  # noqa: E731, ARG005
    return numbers(spark, d).select("id", *whole(("gi", mesh(300, 0, 1024)), ("gj", mesh(200, 1, 768)), ("near", near), ("far", far)))


# Strings


@query("""WITH p AS (SELECT page_id, substr(html, 1, 40) AS t, url FROM pages), u AS (SELECT *, 'https://x/thumb/a/' || (page_id % 900) || 'px-File_' || page_id || '.jpg' AS thumb FROM p)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(thumb, '/thumb/', '/t/') ELSE 'https://x/thumb/a/' || least(1600, greatest(1, page_id % 4000)) || 'px-File_' || page_id || '.jpg' END AS full_url,
CASE page_id % 3 WHEN 0 THEN 'cc0' WHEN 1 THEN 'cc by-sa 4.0' ELSE '' END AS licence, 'https://c.org/by/' || (page_id % 5) AS licence_url, CASE page_id % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'W' ELSE 'R' END || page_id AS element,
'Atlas ' || page_id || ' (Office)' AS label, CASE WHEN page_id * 997 >= 1048576 THEN printf('%.1f MiB', page_id * 997 / 1048576.0) WHEN page_id * 997 >= 1024 THEN printf('%.1f KiB', page_id * 997 / 1024.0) ELSE page_id * 997 || ' B' END AS bytes,
'https://es.wikipedia.org/wiki/Caf%C3%A9_%26_(' || page_id || ')!' AS article, coalesce(CASE WHEN page_id % 2 = 0 THEN 'es ' || page_id END, 'en ' || page_id) AS name FROM u""")
def string_rules(spark, d):
    k, s = F.col("page_id"), F.col("page_id").cast("string")
    thumb = F.concat(F.lit("https://x/thumb/a/"), (k % 900).cast("string"), F.lit("px-File_"), s, F.lit(".jpg"))
    thumb = F.when(k % 3 == 0, F.replace(thumb, F.lit("/thumb/"), F.lit("/t/"))).otherwise(thumb)
    licence = F.when(k % 3 == 0, " CC0  1.0 ").when(k % 3 == 1, "CC BY-SA\t4.0")
    url = F.concat(F.lit("http://C.org/by/"), (k % 5).cast("string"), F.lit("/deed.es"))
    kind = F.when(k % 3 == 0, "node/").when(k % 3 == 1, "way/").otherwise("relation/")
    return table(spark, d, "pages").select(
        "page_id", text.full_image_url(thumb, k % 4000).alias("full_url"), text.licence_key(licence).alias("licence"), text.licence_url_key(url).alias("licence_url"), text.element_id(F.concat(kind, s)).alias("element"),
        text.source_label(F.concat(F.lit("Atlas "), s, F.lit(" — second part")), F.lit("Office")).alias("label"), text.byte_size(k * 997).alias("bytes"), text.article_url(F.concat(F.lit("Café & ("), s, F.lit(")!"))).alias("article"),
        text.display_name(F.when(k % 2 == 0, F.concat(F.lit("es "), s)), F.concat(F.lit("en "), s), k).alias("name"))


@query("""WITH b AS (SELECT c_custkey AS id, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS c, c_acctbal AS v FROM customer), w AS (SELECT *, replace(format('{:,}', abs(c) // 100), ',', '.') AS g, abs(c) % 100 AS f FROM b)
SELECT id, CASE WHEN c < 0 THEN '-' ELSE '' END || g || CASE WHEN f = 0 THEN '' WHEN f % 10 = 0 THEN ',' || f // 10 ELSE ',' || lpad(CAST(f AS VARCHAR), 2, '0') END AS amount, CASE WHEN v < 0 THEN '-' ELSE '' END || replace(format('{:,}', CAST(abs(floor(v + 0.5)) AS BIGINT)), ',', '.') AS n, upper(substr('ñandú', 1, 1)) || 'andú ' || id AS word FROM w""")
def numbers_es(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.decimal_es(b).alias("amount"), text.count_es(b).alias("n"), text.capital(F.concat(F.lit("ñandú "), F.col("c_custkey").cast("string"))).alias("word"))


@query("""WITH e AS (SELECT event_id AS id, ts, CAST(ts - INTERVAL 3 HOUR AS DATE) AS day FROM events), m AS (SELECT *, (epoch_us(ts) - epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP))) / 60e6 - 180 AS minutes FROM e)
SELECT id, day, CAST(floor(minutes * 1000 + 0.5) AS BIGINT) AS minutes, lpad(CAST(CAST(floor(minutes + 0.5 + 1440) AS BIGINT) % 1440 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(minutes + 0.5 + 1440) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock, epoch_us(ts) AS back, CASE WHEN id % 4 = 0 THEN NULL ELSE 2024 * 10000 + (id % 12 + 1) * 100 + 31 END AS parsed FROM m""")
def local_time(spark, d):
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id")
    minutes = text.local_minutes(ts, F.to_date("ts"))
    value = F.concat(F.lit("2024-"), F.lpad(F.when(k % 4 == 0, F.lit(13)).otherwise(k % 12 + 1).cast("string"), 2, "0"), F.lit("-31 "))
    p = text.day_of(value)
    back = F.unix_micros(text.utc_of_local(F.to_date("ts"), minutes))
    return table(spark, d, "events").select(k.alias("id"), text.local_day(ts).alias("day"), F.floor(minutes * 1000 + 0.5).cast("long").alias("minutes"), text.hour_minute(minutes).alias("clock"), back.alias("back"), (p["year"] * 10000 + p["month"] * 100 + p["day"]).cast("long").alias("parsed"))


@query("""WITH h AS (SELECT c_custkey AS id, (CAST(c_custkey AS HUGEINT) * 747796405 + 2891336453) % 4294967296 AS h, (CAST(c_custkey AS HUGEINT) * 1664525 + 1013904223) % 4294967296 AS s FROM customer), w AS (SELECT *, xor(CAST(h AS BIGINT) >> CAST((CAST(h AS BIGINT) >> 28) + 4 AS BIGINT), CAST(h AS BIGINT)) AS x FROM h), m AS (SELECT *, CAST(CAST(x AS HUGEINT) * 277803737 % 4294967296 AS BIGINT) AS word FROM w)
SELECT id, xor(word >> 22, word) AS pcg, CAST((s * 1664525 + 1013904223) % 4294967296 AS BIGINT) AS lcg2 FROM m""")
def word_hashes(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.pcg(F.col("c_custkey")).alias("pcg"), text.lcg(F.col("c_custkey"), 2).alias("lcg2"))


# Records and lists


@query("SELECT n_nationkey AS id, n_name AS name, row_number() OVER (ORDER BY regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g')) AS ord FROM nation")
def name_order(spark, d):
    # One row for each class of an index raster: a bounded list.
    key = text.name_key(F.col("n_name"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.row_number().over(Window.orderBy(key)).cast("long").alias("ord"))


@query("SELECT ps.s_suppkey AS id, x.n_nationkey IS NOT NULL AS dropped, CASE WHEN x.n_nationkey IS NOT NULL THEN 'listed ' || x.n_name END AS reason FROM supplier ps LEFT JOIN nation x ON x.n_nationkey = ps.s_nationkey AND x.n_nationkey % 5 = 1 AND ps.s_suppkey % 2 = 0")
def editorial_exclusions(spark, d):
    listed = table(spark, d, "nation").where("n_nationkey % 5 = 1").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(0).cast("long").alias("odd"), F.concat(F.lit("listed "), "n_name").alias("reason"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey", (F.col("s_suppkey") % 2).alias("odd"))
    kept, dropped = screen.excluded(s, listed, ["s_nationkey", "odd"])
    return kept.select("id", F.lit(False).alias("dropped"), F.lit(None).cast("string").alias("reason")).unionByName(dropped.select("id", F.lit(True).alias("dropped"), "reason"))


@query("SELECT n_regionkey AS grp, count(*) AS records, count(*) FILTER (n_nationkey % 3 = 0) AS with_text, CAST(sum(n_nationkey % 4) AS BIGINT) AS photos FROM nation GROUP BY n_regionkey")
def record_counts(spark, d):
    n = table(spark, d, "nation").select("n_regionkey", F.when(F.col("n_nationkey") % 3 == 0, "t").alias("text"), F.expr("sequence(1, n_nationkey % 4 + 1)").alias("photos"))
    return n.groupBy(F.col("n_regionkey").alias("grp")).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("text").isNotNull()).alias("with_text"), F.sum(F.size("photos") - 1).alias("photos"))


@query(with_tables("sites", """, s AS (SELECT site, site % 7 AS grp, CASE WHEN site % 5 = 0 THEN 'laguna o salar' ELSE 'L' || site % 11 END AS name FROM sites), f AS (SELECT grp, name, min(site) AS o FROM s WHERE name <> 'laguna o salar' GROUP BY grp, name), l AS (SELECT grp, list(name ORDER BY o) AS a FROM f GROUP BY grp)
SELECT grp, CASE WHEN len(a) = 1 THEN a[1] ELSE array_to_string(a[1:len(a) - 1], ', ') || ' y ' || a[len(a)] END AS names FROM l"""))
def sink_names(spark, d):
    s = sites(spark, d).select("site", F.pmod("site", F.lit(7)).alias("grp"), F.when(F.col("site") % 5 == 0, "laguna o salar").otherwise(F.concat(F.lit("L"), (F.col("site") % 11).cast("string"))).alias("name"))
    first = s.where("name <> 'laguna o salar'").groupBy("grp", "name").agg(F.min("site").alias("o"))
    names = first.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "name"))), lambda x: x["name"]).alias("a"))
    return names.select("grp", text.joined_es(F.col("a")).alias("names"))


TAPS = "m AS (SELECT s_suppkey AS m, CAST(s_suppkey * 7919 % 800 AS DOUBLE) AS x, CAST(s_suppkey * 104729 % 600 AS DOUBLE) AS y FROM supplier)"


def markers(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("m"), F.pmod(k * 7919, F.lit(800)).cast("double").alias("x"), F.pmod(k * 104729, F.lit(600)).cast("double").alias("y"))


@query("WITH " + TAPS + ", t AS (SELECT c_custkey AS id, CAST(c_custkey * 31 % 800 AS DOUBLE) AS tx, CAST(c_custkey * 17 % 600 AS DOUBLE) AS ty FROM customer), c AS (SELECT id, m, row_number() OVER (PARTITION BY id ORDER BY pow(x - tx, 2) + pow(y - ty, 2), m DESC) AS n FROM t JOIN m ON pow(x - tx, 2) + pow(y - ty, 2) <= 484) SELECT id, m FROM c WHERE n = 1")
def tapped_marker(spark, d):
    k = F.col("c_custkey")
    taps = table(spark, d, "customer").select(k.alias("id"), F.pmod(k * 31, F.lit(800)).cast("double").alias("tx"), F.pmod(k * 17, F.lit(600)).cast("double").alias("ty"))
    return screen.nearest_marker(taps, markers(spark, d), 22.0)


@query("WITH RECURSIVE " + TAPS + ", e AS (SELECT a.m AS u, b.m AS v FROM m a JOIN m b ON a.m <> b.m AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 484), r AS (SELECT m AS node, m AS label FROM m UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.label), l AS (SELECT node, min(label) AS label FROM r GROUP BY node), g AS (SELECT label, m.* FROM l JOIN m ON m.m = node), f AS (SELECT a.label, max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS spread FROM g a JOIN g b USING (label) GROUP BY a.label) SELECT label, count(*) AS members, " + sql_whole(("x", "avg(x)"), ("y", "avg(y)"), ("spread", "any_value(spread)")) + " FROM g JOIN f USING (label) GROUP BY label")
def screen_clusters(spark, d):
    c = screen.clusters(markers(spark, d), 22.0)
    return c.select("label", "members", *whole(("x", F.col("x")), ("y", F.col("y")), ("spread", F.col("spread"))))


@query("""WITH RECURSIVE r AS (SELECT user_id AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CAST(event_id * 37 % 500 AS BIGINT) AS x, CAST(event_id * 91 % 300 AS BIGINT) AS y FROM events), b AS (SELECT * FROM r),
k AS (SELECT v, n, [{'x': x, 'y': y}] AS kept, true AS shown FROM b WHERE n = 1 UNION ALL SELECT b.v, b.n, CASE WHEN len(list_filter(kept, lambda q: b.x < q.x + 64 AND q.x < b.x + 64 AND b.y < q.y + 24 AND q.y < b.y + 24)) > 0 THEN kept ELSE list_append(kept, {'x': b.x, 'y': b.y}) END, len(list_filter(kept, lambda q: b.x < q.x + 64 AND q.x < b.x + 64 AND b.y < q.y + 24 AND q.y < b.y + 24)) = 0 FROM k JOIN b ON b.v = k.v AND b.n = k.n + 1)
SELECT v, CAST(n AS BIGINT) AS n, shown FROM k""")
def decluttered_labels(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("v"), F.row_number().over(w).cast("long").alias("n"), F.pmod(F.col("event_id") * 37, F.lit(500)).cast("double").alias("x"), F.pmod(F.col("event_id") * 91, F.lit(300)).cast("double").alias("y"))
    return screen.declutter(e.withColumns({"width": F.lit(60.0), "height": F.lit(20.0)}), ["v"], "n", 4.0)


@query("""WITH o AS (SELECT s_suppkey AS id, CAST(s_suppkey AS DOUBLE) / 7 AS lon, 'CC BY 4.0' AS lic, 'https://c.org/by/4.0' AS url FROM supplier), f AS (SELECT s_suppkey AS id, CAST(s_suppkey AS DOUBLE) / 7 + CASE WHEN s_suppkey % 3 = 0 THEN 1e-3 ELSE 1e-12 END AS lon, CASE WHEN s_suppkey % 5 = 0 THEN 'cc0' ELSE 'cc  by 4.0' END AS lic, CASE WHEN s_suppkey % 10 = 0 THEN 'x' ELSE 'http://c.org/by/4.0/deed.es' END AS url FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT o.id, CASE WHEN f.id IS NULL THEN 'missing' WHEN abs(o.lon - f.lon) > 1e-9 THEN 'moved' WHEN f.id % 5 = 0 AND f.id % 10 = 0 THEN 'licence' END AS problem FROM o LEFT JOIN f USING (id) WHERE f.id IS NULL OR abs(o.lon - f.lon) > 1e-9 OR (f.id % 10 = 0)""")
def tolerant_diff(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    old = s.select(k.alias("id"), (k.cast("double") / 7).alias("lon"), F.lit("CC BY 4.0").alias("licence"), F.lit("https://c.org/by/4.0").alias("url"))
    new = s.where("s_suppkey % 4 <> 0").select(k.alias("id"), (k.cast("double") / 7 + F.when(k % 3 == 0, 1e-3).otherwise(1e-12)).alias("lon"), F.when(k % 5 == 0, "cc0").otherwise("cc  by 4.0").alias("licence"), F.when(k % 10 == 0, "x").otherwise("http://c.org/by/4.0/deed.es").alias("url"))
    return screen.tolerant_diff(old, new, "id", 1e-9)


@query("SELECT p_partkey AS tile FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)")
def unused_tiles(spark, d):
    declared, used = table(spark, d, "part"), table(spark, d, "lineitem")
    return declared.join(used, declared.p_partkey == used.l_partkey, "left_anti").select(F.col("p_partkey").alias("tile"))


@query(with_tables("grid", " SELECT i // 2 AS i, j // 2 AS j, CAST(floor(avg(h % 256) + 0.5) AS BIGINT) AS r, CAST(floor(avg(h * 3 % 256) + 0.5) AS BIGINT) AS g, CAST(floor(avg((h + i) % 256) + 0.5) AS BIGINT) AS b, 255::BIGINT AS a FROM grid GROUP BY 1, 2"))
def rgba_downsample(spark, d):
    from gridloom.operators import raster

    px = grid(spark, d).select("i", "j", F.pmod("h", F.lit(256)).alias("r"), F.pmod(F.col("h") * 3, F.lit(256)).alias("g"), F.pmod(F.col("h") + F.col("i"), F.lit(256)).alias("b"), F.lit(255).cast("long").alias("a"))
    return raster.rgba_downsample(px, 2)


@query(with_tables("grid", " SELECT count(*) AS cells, count(*) FILTER (h >= 1000) AS inside, CAST(floor(avg(CASE WHEN h >= 1000 THEN 1.0 ELSE 0.0 END) * 1e6 + 0.5) AS BIGINT) AS share, max(CASE WHEN h >= 1000 THEN h * 2 END) AS most, count(*) FILTER (h < 800) AS raised FROM grid"))
def build_counters(spark, d):
    g = grid(spark, d)
    return g.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("h") >= 1000).alias("inside"), micro(F.avg((F.col("h") >= 1000).cast("double"))).alias("share"), F.max(F.when(F.col("h") >= 1000, F.col("h") * 2)).alias("most"), F.count_if(F.col("h") < 800).alias("raised"))


@query(with_tables("grid", " SELECT j * 64 + i AS cell FROM grid WHERE h >= 1300"))
def spawn_cells(spark, d):
    # In the order of cells when written; a result has no order of its own.
    return grid(spark, d).where("h >= 1300").select((F.col("j") * 64 + F.col("i")).alias("cell"))
