"""What has no SQL, against brute force: outlines, routing, rays, shadows, meshes, files and their errors, folds."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import catalog
from gridloom.functions import geo
from gridloom.operators import hydro, validate, vectors, view
from gridloom.sources import files, rasters
from gridloom.streaming import reducers

SF = "/root/testdata/sf0.001"


def relief(spark, h):
    return spark.createDataFrame([(i, j, float(v)) for j, row in enumerate(h) for i, v in enumerate(row)], "i long, j long, h double")


def bilinear(h, i, j):
    n, m = h.shape
    x, y = min(max(i, 0), m - 1), min(max(j, 0), n - 1)
    a, b = int(x), int(y)
    c, d = min(a + 1, m - 1), min(b + 1, n - 1)
    top, low = h[b, a] + (h[b, c] - h[b, a]) * (x - a), h[d, a] + (h[d, c] - h[d, a]) * (x - a)
    return top + (low - top) * (y - b)


def noise(seed, height, width):
    rng = np.random.default_rng(seed)
    s = np.round(rng.normal(size=(height, width)) * 4) + 0.5
    s[0, :] = s[-1, :] = s[:, 0] = s[:, -1] = -1.5
    return s


def field(spark, s):
    return spark.createDataFrame([(i, j, float(s[j, i])) for j in range(s.shape[0]) for i in range(s.shape[1])], "i long, j long, s double")


def lines(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.ring, r.place)):
        out.setdefault(r.ring, []).append((r.x, r.y))
    return out


def walked(segments):
    """Rings by walking from segment to segment, whichever way each runs."""
    around, place = {}, {}
    for r in segments:
        around.setdefault(r.a, []).append(r.b)
        around.setdefault(r.b, []).append(r.a)
        place[r.a], place[r.b] = (r.ax, r.ay), (r.bx, r.by)
    out, seen = {}, set()
    for start in sorted(around):
        if start in seen:
            continue
        chain, todo = {start}, [start]
        while todo:
            for n in around[todo.pop()]:
                if n not in chain:
                    chain.add(n)
                    todo.append(n)
        seen |= chain
        if len(chain) < 3 or any(len(around[e]) != 2 for e in chain):
            continue
        order, before, at = [start], start, around[start][0]
        while at != start:
            order.append(at)
            before, at = at, around[at][0] if around[at][0] != before else around[at][1]
        p = [place[e] for e in order]
        if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) < 0:
            p = p[:1] + p[:0:-1]
        out[start] = p
    return out


@pytest.mark.parametrize("tile,edge", [(5, True), (3, False), (256, False)])
def test_rings_by_walk(spark, tile, edge):
    """Rings across tiles, their order, direction and measures; where the raster's edge cuts chains open, those are left out."""
    s = noise(tile, 21, 26)
    if edge:
        s[0, :] = s[:, -1] = 2.5
    segments = vectors.crossings(field(spark, s))
    vertices, measures = vectors.rings(segments, tile)
    want = walked(segments.collect())
    assert lines(vertices.collect()) == want and len(want) > 10
    for r in measures.collect():
        p = want[r.ring]
        assert r.n == len(p)
        assert r.area == pytest.approx(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2)
        assert r.length == pytest.approx(sum(math.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(p, p[1:] + p[:1])))
    top = max(want, key=lambda k: (sum(math.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(want[k], want[k][1:] + want[k][:1])), -k))
    assert vectors.longest(measures).first().ring == top


def test_a_ring_through_many_tiles(spark):
    """One spiral-like comb: its pieces are far more than a round of doubling knows."""
    s = np.full((40, 40), -1.0)
    s[2:-2, 2:-2] = 1.0
    for i in range(4, 36, 4):
        s[2 : -6 if i % 8 else -2, i] = -1.0
        s[6 if i % 8 == 0 else 2 : -2, i] = -1.0 if i % 8 == 0 else s[6 if i % 8 == 0 else 2 : -2, i]
    segments = vectors.crossings(field(spark, s))
    vertices, _ = vectors.rings(segments, 2)
    assert lines(vertices.collect()) == walked(segments.collect())


def test_rings_close_around_what_is_inside(spark):
    s = noise(5, 18, 23)
    df = field(spark, s)
    found = lines(vectors.rings(vectors.crossings(df), 7)[0].collect())
    # Everything is closed since the rim is outside: every segment is in one ring.
    assert sum(map(len, found.values())) == vectors.crossings(df).count()
    inside = np.zeros(s.shape, int)
    for p in found.values():
        for j in range(18):
            for i in range(23):
                crossed = sum((a[1] > j) != (b[1] > j) and i < a[0] + (j - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(p, p[1:] + p[:1]))
                inside[j, i] += crossed % 2
    assert ((inside % 2 == 1) == (s >= 0)).all()


def simplified(p, tolerance):
    """Splitting at the farthest vertex, by recursion."""
    def split(line):
        (ax, ay), (bx, by) = line[0], line[-1]
        dx, dy = bx - ax, by - ay
        far, at = -1.0, 0
        for k, (x, y) in enumerate(line[1:-1], 1):
            t = min(1, max(0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx * dx + dy * dy > 1e-18 else 0
            d = math.hypot(x - ax - t * dx, y - ay - t * dy)
            if d > far:
                far, at = d, k
        return split(line[: at + 1])[:-1] + split(line[at:]) if far > tolerance else [line[0], line[-1]]

    if len(p) <= 3 or tolerance <= 0:
        return set(p)
    far = lambda k: max(range(len(p)), key=lambda q: (math.hypot(p[q][0] - p[k][0], p[q][1] - p[k][1]), -q))
    a = far(0)
    b = far(a)
    line = p[a:] + p[: a + 1]
    m = (b - a) % len(p)
    kept = split(line[: m + 1])[:-1] + split(line[m:])[:-1]
    return set(kept) if len(kept) >= 3 else set(p)


@pytest.mark.parametrize("most", [4096, 6])
def test_simplified_rings(spark, most):
    """In one task each, and cut into parts of a few vertices over several rounds."""
    rng = random.Random(3)
    shapes = {1: [(10 * math.cos(t / 90 * 2 * math.pi) + rng.random() * 0.7, 10 * math.sin(t / 90 * 2 * math.pi) + rng.random() * 0.7) for t in range(90)], 2: [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], 3: [(float(k), 0.01 * (k % 2)) for k in range(40)], 4: [(rng.random() * 20, rng.random() * 20) for _ in range(60)]}
    df = spark.createDataFrame([(r, k, *p, len(v)) for r, v in shapes.items() for k, p in enumerate(v)], "ring long, place long, x double, y double, n long")
    got = vectors.simplify(df, 0.5, most)
    rows = got.collect()
    assert {r: {(q.x, q.y) for q in rows if q.ring == r} for r in shapes} == {r: simplified(p, 0.5) for r, p in shapes.items()}
    for ring, p in lines(rows).items():
        nexts = {(q.x, q.y): (q.to_x, q.to_y) for q in rows if q.ring == ring}
        assert all(nexts[a] == b for a, b in zip(p, p[1:] + p[:1]))
    for r in vectors.line_measures(got).collect():
        p = lines(rows)[r.ring]
        assert r.n == len(p) and r.area == pytest.approx(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2)


def test_rays_by_march(spark):
    rng = np.random.default_rng(8)
    h = np.round(rng.random((30, 24)) * 900)
    spec = geo.GridSpec(10, 82048, 145664, 24, 30)
    km, ex = spec.metres_per_cell / 1000, 2.0
    rays, want = [], {}
    for n in range(60):
        o = [rng.uniform(-2, 2), rng.uniform(0.3, 4), rng.uniform(-2, 2)]
        d = rng.normal(size=3)
        d = d / np.linalg.norm(d) if n % 9 else np.array([0.0, -1.0, 0.0])
        rays.append((n, *map(float, o), *map(float, d)))
        above = lambda t: o[1] + d[1] * t - bilinear(h, (o[0] + d[0] * t) / km + 11.5, (o[2] + d[2] * t) / km + 14.5) / 1000 * ex  # noqa: B023, E731
        t0, t1 = 0.0, math.inf
        for k, (a, b) in enumerate(((-12 * km, 12 * km), (h.min() / 1000 * ex, h.max() / 1000 * ex), (-15 * km, 15 * km))):
            if abs(d[k]) < 1e-12:
                t1 = t1 if a <= o[k] <= b else -1
                continue
            p, q = sorted(((a - o[k]) / d[k], (b - o[k]) / d[k]))
            t0, t1 = max(t0, p), min(t1, q)
        if t1 < t0:
            continue
        level = math.hypot(d[0], d[2])
        step = km * 0.5 / level if level > 1e-9 else t1 - t0
        ts = [t0] + [min(t0 + s * step, t1) for s in range(1, math.ceil((t1 - t0) / step) + 1 if step else 1)]
        f = [above(t) for t in ts]
        for s in range(len(ts)):
            if f[s] == 0:
                want[n] = ts[s]
                break
            if s and f[s - 1] * f[s] < 0:
                lo, hi = ts[s - 1], ts[s]
                while (hi - lo) * max(level, abs(d[1])) > 0.001:
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if (above(mid) > 0) == (f[s - 1] > 0) else (lo, mid)
                want[n] = (lo + hi) / 2
                break
    df = spark.createDataFrame(rays, "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {r.ray: r.t for r in view.first_hits(df, relief(spark, h), spec, ex).collect()}
    assert set(got) == set(want) and len(want) > 20
    assert all(abs(got[n] - want[n]) < 1e-6 for n in want)


def test_wall_hides_what_lies_behind(spark):
    h = np.zeros((21, 21))
    h[:, 10] = 1000
    spec = geo.GridSpec(10, 82048, 145664, 21, 21)
    km = spec.metres_per_cell / 1000
    m = spark.createDataFrame([(1, 8 * km, 0.06, 0.0), (2, -4 * km, 0.06, 0.0), (3, 8 * km, 3.0, 0.0), (4, -9 * km, 0.3, 0.0)], "m long, x double, y double, z double")
    hidden = {r.m: r.hidden for r in view.occluded(m, (-9 * km, 0.3, 0.0), relief(spark, h), spec, 1.0).collect()}
    assert hidden == {1: True, 2: False, 3: False, 4: False}


@pytest.mark.parametrize("tile", [7, 64])
def test_shadows_by_march(spark, tile):
    rng = np.random.default_rng(4)
    h = np.round(rng.random((25, 31)) ** 4 * 3000)
    sun, cell, pen, bias = (0.7 * math.cos(0.3), math.sin(0.3), -math.sqrt(1 - 0.49) * math.cos(0.3)), 0.2, 8.0, 0.01
    want = np.ones(h.shape)
    flat = math.hypot(sun[0], sun[2])
    for j in range(25):
        for i in range(31):
            t, lit = 0.1, 1.0
            for s in range(30):
                x, y = i + sun[0] / flat * t / cell, j + sun[2] / flat * t / cell
                if lit <= 0 or t > 4 or not (-0.5 <= x <= 30.5 and -0.5 <= y <= 24.5):
                    break
                lit = min(lit, pen * (h[j, i] / 1000 + bias + t * sun[1] / flat - bilinear(h, x, y) / 1000) / t)
                t += 0.1 * (1 + 0.05 * s)
            want[j, i] = min(max(lit, 0), 1)
    got = view.shadows(relief(spark, h), 31, 25, cell, sun, steps=30, max_km=4.0, tile=tile).collect()
    assert len(got) == h.size and max(abs(want[r.j, r.i] - r.lit) for r in got) < 1e-9 and 0.05 < np.mean(want < 0.5) < 0.95
    assert {r.lit for r in view.shadows(relief(spark, h), 31, 25, cell, (1.0, 0.0, 0.0)).collect()} == {0.0}


def test_drawn_mesh_is_flat_on_triangles(spark):
    rng = np.random.default_rng(3)
    h = np.round(rng.random((12, 16)) * 100)
    mesh, size = (5, 4), (16, 12)
    at = lambda a, b: bilinear(h, a * 16 / 4 - 0.5, b * 12 / 3 - 0.5)
    points, want = [], {}
    for n in range(80):
        i, j = rng.uniform(-0.5, 15.5), rng.uniform(-0.5, 11.5)
        points.append((n, float(i), float(j)))
        x, y = (i + 0.5) * 4 / 16, (j + 0.5) * 3 / 12
        a, b = min(int(x), 3), min(int(y), 2)
        fx, fy = x - a, y - b
        if fx + fy <= 1:
            want[n] = at(a, b) + (at(a + 1, b) - at(a, b)) * fx + (at(a, b + 1) - at(a, b)) * fy
        else:
            want[n] = at(a + 1, b + 1) + (at(a, b + 1) - at(a + 1, b + 1)) * (1 - fx) + (at(a + 1, b) - at(a + 1, b + 1)) * (1 - fy)
    vertices = view.mesh_vertices(relief(spark, h), mesh, size)
    got = {r.id: r.drawn for r in view.mesh_heights(spark.createDataFrame(points, "id long, i double, j double"), vertices, mesh, size).collect()}
    assert got == pytest.approx(want)
    u = lambda *v: [F.lit(float(x)) for x in v]
    row = spark.range(1).select(view.seam_blend(*u(10, 20, 0.5, 0.5, 100)), view.seam_blend(*u(10, 20, 0, 0.5, 100)), view.seam_blend(*u(10, 20, 0.5, 0.5, -1)), view.seam_blend(*u(10, 20, 0.5, 0.025, 4))).first()
    assert tuple(row) == (20, 10, 10, pytest.approx(12.5))


def test_routing_and_basins_by_brute_force(spark):
    rng = np.random.default_rng(12)
    n, m = 26, 30
    h = np.round(rng.random((n, m)) * 3, 1) + 50 + np.arange(n)[:, None] * 0.2
    h[3:13, 4:14] -= 20 + rng.random((10, 10))
    h[15:24, 15:27] -= 12 + rng.random((9, 12))
    h[18:20, 3:5] -= 9
    cells = relief(spark, h)
    minimal, filled = (hydro.checkpointed(hydro.fill(cells, m, n, e, tile=8)) for e in (0.0, 0.01))
    found = hydro.checkpointed(hydro.depressions(cells, minimal, m))
    members = hydro.checkpointed(hydro.components(cells.join(minimal, ["i", "j"]).where(F.col("f") - F.col("h") > 0.01), m, tile=8))
    low = np.array([[0.0] * m] * n)
    for r in minimal.collect():
        low[r.j, r.i] = r.f
    around = lambda j, i: [(j + b, i + a) for b in (-1, 0, 1) for a in (-1, 0, 1) if (a or b) and 0 <= j + b < n and 0 <= i + a < m]
    of, pools = {}, []
    for j in range(n):
        for i in range(m):
            if low[j, i] - h[j, i] > 0.01 and (j, i) not in of:
                queue, of[j, i] = [(j, i)], len(pools)
                for c in queue:
                    for k in around(*c):
                        if low[k] - h[k] > 0.01 and k not in of:
                            of[k] = len(pools)
                            queue.append(k)
                pools.append(queue)
    keep = [len(p) >= 64 and max(low[c] - h[c] for c in p) >= 3 for p in pools]
    got = {r.label: r for r in found.collect()}
    assert len(got) == len(pools) and sum(keep) == 2
    bottoms = []
    for p in pools:
        r = got[min(j * m + i for j, i in p)]
        bottom = min(p, key=lambda c: (h[c], c))
        bottoms.append(bottom)
        assert (r.n_cells, r.bottom, r.retained) == (len(p), bottom[0] * m + bottom[1], keep[of[bottom]]) and r.max_depth == pytest.approx(max(low[c] - h[c] for c in p))
    z = np.zeros((n, m))
    for r in filled.collect():
        z[r.j, r.i] = np.float32(r.f)
    for p, bottom, kept in zip(pools, bottoms, keep):
        if kept:
            hops, queue = {bottom: 0}, [bottom]
            for c in queue:
                for k in around(*c):
                    if of.get(k) == of[bottom] and k not in hops:
                        hops[k] = hops[c] + 1
                        queue.append(k)
            step = min(0.01, 0.5 * max(low[c] - h[c] for c in p) / len(p))
            for c in p:
                z[c] = np.float32(min(h[c] + step * hops[c], low[bottom] - 0.01))
    surface = hydro.checkpointed(hydro.routing(cells, filled, minimal, found, members, m))
    for r in surface.collect():
        assert r.z == pytest.approx(z[r.j, r.i], abs=1e-5)
    graph = hydro.checkpointed(hydro.edges(hydro.d8(surface, "z"), m))
    down, ends, acc = {r.src: r.dst for r in graph.collect()}, {}, {}
    for c in down:
        k = c
        acc[k] = acc.get(k, 0) + 1
        while down[k] is not None:
            k = down[k]
            acc[k] = acc.get(k, 0) + 1
        ends[c] = k
    inside = {c for c in down if 2 <= c % m < m - 2 and c // m >= 2}
    key = lambda t: (1, of[divmod(t, m)]) if divmod(t, m) in of and keep[of[divmod(t, m)]] else (0, t)
    groups = {}
    for c in sorted(inside):
        groups.setdefault(key(ends[c]), []).append(c)
    first = lambda k: bottoms[k[1]][0] * m + bottoms[k[1]][1] if k[0] else k[1]
    ranked = sorted(groups, key=lambda k: (-max(acc[c] for c in groups[k]), k[0], first(k)))[:8]
    basins, labels = hydro.outlets(hydro.flow_terminals(graph), hydro.accumulation(graph), spark.createDataFrame([(c,) for c in inside], "src long"), found, members)
    want = [(n + 1, first(k), max(groups[k], key=lambda c: (acc[c], -c)), max(acc[c] for c in groups[k]), len(groups[k]), "cerrada" if k[0] or k[1] in inside else "abierta") for n, k in enumerate(ranked)]
    assert sorted(tuple(r) for r in basins.collect()) == want
    assert {r.src: r.basin for r in labels.collect()} == {c: 255 if c not in inside else ranked.index(key(ends[c])) + 1 if key(ends[c]) in ranked else 0 for c in down}


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(1)
    for c in (3, 4):
        p = rng.integers(0, 256, (9, 13, c), dtype=np.uint8)
        assert (files.png_pixels(files.png_bytes(p)) == p).all()
    import struct
    import zlib

    p = rng.integers(0, 256, (10, 6, 3), dtype=np.int64)
    rows = b""
    for j in range(10):
        kind, line = j % 5, bytearray()
        for x in range(18):
            here, left = p[j].ravel()[x], p[j].ravel()[x - 3] if x >= 3 else 0
            up, corner = (p[j - 1].ravel()[x], p[j - 1].ravel()[x - 3] if x >= 3 else 0) if j else (0, 0)
            guess = left + up - corner
            paeth = min(((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner)))[2]
            line.append(int(here - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        rows += bytes([kind]) + bytes(line)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 10, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (files.png_pixels(data) == p).all()
    with pytest.raises(ValueError):
        files.png_pixels(data[:-20] + b"x" + data[-19:])
    with pytest.raises((RuntimeError, OSError)):
        files.jpeg_pixels(b"none")


def test_files_that_are_not_as_declared_fail(spark, tmp_path):
    cells = spark.createDataFrame([("a", i, j, float(i - j * 40_000)) for i in range(3) for j in range(2)], "name string, i long, j long, v double")
    made = files.encoded(cells, "int16-le", 3, 2)
    manifest = rasters.written(made, str(tmp_path / "f"))
    assert {(r.i, r.j): r.v for r in files.dataset(spark, str(tmp_path / "f"), manifest).collect()} == {(i, j): max(i - j * 40_000, -32768) for i in range(3) for j in range(2)}
    bad = {
        "another hash": manifest.withColumn("sha256", F.lit("0" * 64)),
        "another size": manifest.withColumn("bytes", F.lit(7).cast("long")),
        "is missing": manifest.withColumn("name", F.lit("b")),
        "cells of 2": manifest.withColumn("width", F.lit(4).cast("long")),
    }
    for message, m in bad.items():
        with pytest.raises(Exception, match=message):
            files.dataset(spark, str(tmp_path / "f"), m).collect()
    with pytest.raises(Exception, match="declared twice"):
        files.merged_manifests([manifest, manifest]).collect()
    with pytest.raises(Exception, match="5 cells"):
        files.encoded(cells.where("i + j < 3"), "uint8", 3, 2).collect()
    with pytest.raises(Exception, match="no tile"):
        files.mosaic(spark.createDataFrame([("3-0-0.png", bytearray(files.png_bytes(np.zeros((4, 4, 3), np.uint8))))], "name string, content binary"), 3, (0, 1), (0, 0), 4).collect()
    assert files.published(spark.createDataFrame([("a",), ("debug-a",), ("b.debug.png",)], "name string")).count() == 1


def test_documents_that_are_not_as_declared_fail(spark):
    doc = lambda v: spark.createDataFrame([(json.dumps(v),)], "content string")
    good = {"schemaVersion": 2, "places": [{"id": "Q1", "lon": 1.5}]}
    assert tuple(files.records(doc(good), "places", "id string, lon double", 2).first()) == ("Q1", 1.5)
    for value, message in (({**good, "schemaVersion": 1}, "version 2"), ({"schemaVersion": 2}, "no list"), ({"schemaVersion": 2, "places": [{"id": "Q1", "x": 1}]}, "unknown key x"), ({"schemaVersion": 2, "places": [{"id": "Q1", "lon": "east"}]}, "(?i)malformed|parse")):
        with pytest.raises(Exception, match=message):
            files.records(doc(value), "places", "id string, lon double", 2).collect()
    with pytest.raises(Exception, match="FeatureCollection"):
        files.feature_collection(doc({"type": "Feature"})).collect()
    rows = spark.createDataFrame([("Q7", "n", 1.0, 2.0, None, None), ("Q07", "n", 1.0, 2.0, "way/5", "http://x")], "id string, name string, lon double, lat double, element string, url string")
    assert validate.checked(rows.limit(1), validate.places(), "id").count() == 1
    with pytest.raises(Exception, match="Q07: id has another form, url has another form"):
        validate.checked(rows, validate.places(), "id").collect()
    calls, waits = [], []

    def fetch():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("later")
        return "there"

    assert files.with_retries(fetch, sleep=waits.append) == "there" and waits == [5.0, 10.0]
    with pytest.raises(OSError):
        files.with_retries(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)
    assert files.batches_of(list(range(45))) == [list(range(20)), list(range(20, 40)), list(range(40, 45))]
    with pytest.raises(ValueError):
        geo.site_grids((14, 5, 4, 0, 0), (12, 1, 1, 0, 0))
    with pytest.raises(ValueError):
        geo.site_grids((14, 4, 5, 0, 0), (12, 0, 0, 0, 0))


def test_requests_that_are_covered_are_left_out(spark):
    rng = random.Random(5)
    rows = [(k, n, 10 + n * 0.1 + rng.random() * 0.1, 30.0, float(rng.randrange(2)), rng.random() < 0.5) for k in range(5) for n in range(60)]
    want, last = set(), {}
    for k, n, az, el, ex, final in rows:
        if k in last:
            a, b = last[k], (math.radians(az), math.radians(el))
            dot = math.sin(a[1]) * math.sin(b[1]) + math.cos(a[1]) * math.cos(b[1]) * math.cos(a[0] - b[0])
            if (a[3] or not final) and a[2] == ex and math.degrees(math.acos(min(1, dot))) < 0.25:
                continue
        last[k] = (math.radians(az), math.radians(el), ex, final)
        want.add((k, n))
    df = spark.createDataFrame(rows, "key long, n long, azimuth double, elevation double, exaggeration double, final boolean")
    assert {tuple(r) for r in reducers.recomputed(df).collect()} == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"fill_minimal", "fill_epsilon"}))
def test_queries_without_sql_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
