"""Tiles with rims, hulls and box hierarchies against brute force, with tiles far smaller than the raster."""

import math
import random

import numpy as np
import pytest

from gridloom.operators import joins, raster, screen, tiles, view


def cells(spark, v, name="h", kind="double"):
    return spark.createDataFrame([(i, j, v[j][i]) for j in range(len(v)) for i in range(len(v[0]))], f"i long, j long, {name} {kind}")


def rows(df, *names):
    return {(r.i, r.j): tuple(r[n] for n in names) for r in df.collect()}


@pytest.fixture(scope="module")
def relief():
    rng = np.random.default_rng(3)
    return np.round(rng.random((23, 31)) * 900).tolist()


@pytest.mark.parametrize("tile", [1, 4, 256])
def test_hillshade_and_normals(spark, relief, tile):
    n, m = len(relief), len(relief[0])
    at = lambda i, j, o: relief[j][i] if 0 <= i < m and 0 <= j < n else o
    shade, normal = {}, {}
    az, alt = math.radians(315), math.radians(45)
    light = (math.sin(az) * math.cos(alt), -math.cos(az) * math.cos(alt), math.sin(alt))
    for j in range(n):
        for i in range(m):
            line = lambda y: (lambda y: (at(i - 1, y, relief[y][i]), relief[y][i], at(i + 1, y, relief[y][i])))(y if 0 <= y < n else j)  # noqa: B023, E731
            (a, b, c), (d, e, f), (g, h, k) = (line(j + s) for s in (-1, 0, 1))
            p, q = ((c - a) + 2 * (f - d) + (k - g)) / 240, ((g + 2 * h + k) - (a + 2 * b + c)) / 240
            x = (light[2] - p * light[0] - q * light[1]) / math.sqrt(p * p + q * q + 1)
            shade[i, j] = (math.floor(min(max(x, 0), 1) * 255 + 0.5),)
            own = relief[j][i]
            p, q = (at(i - 1, j, own) - at(i + 1, j, own)) / 60, (at(i, j - 1, own) - at(i, j + 1, own)) / 60
            size = math.sqrt(p * p + q * q + 1)
            normal[i, j] = (pytest.approx(p / size), pytest.approx(1 / size), pytest.approx(q / size))
    assert rows(raster.hillshade(cells(spark, relief), 30.0, tile=tile), "shade") == shade
    assert rows(view.normals(cells(spark, relief), 30.0, tile=tile), "nx", "ny", "nz") == normal


@pytest.mark.parametrize("tile", [3, 256])
def test_borders_and_corners(spark, tile):
    rng = random.Random(4)
    v = [[rng.randrange(3) for _ in range(13)] for _ in range(9)]
    want = {}
    for j in range(9):
        for i in range(13):
            east, south = i < 12 and v[j][i + 1] != v[j][i], j < 8 and v[j + 1][i] != v[j][i]
            if east or south:
                want[i, j] = (east, south)
    df = cells(spark, v, "v", "long")
    assert rows(raster.borders(df, tile=tile), "east", "south") == want
    # A missing cell has no squares and is nobody's neighbour.
    holed = df.where("i <> 5 or j <> 4")
    assert rows(tiles.corners(holed, "v", tile), "tl", "tr", "bl", "br") == {(i, j): (v[j][i], v[j][i + 1], v[j + 1][i], v[j + 1][i + 1]) for j in range(8) for i in range(12) if not (i in (4, 5) and j in (3, 4))}
    assert tiles.corners(df.limit(0), "v").count() == 0


@pytest.mark.parametrize("clamp,tile", [(5, 5), (5, 9), (127, 256)])
def test_signed_distance(spark, clamp, tile):
    rng = random.Random(clamp)
    v = [[rng.random() < 0.06 or (i > 20 and j > 9) for i in range(33)] for j in range(21)]
    df = cells(spark, v, "inside", "boolean")
    for kind in (df, df.selectExpr("i", "j", "false as inside")):
        held = {(r.i, r.j): r.inside for r in kind.collect()}
        got = rows(raster.signed_distance(kind, clamp=clamp, tile=tile), "s")
        for (i, j), own in held.items():
            d = min((math.hypot(a - i, b - j) for (a, b), other in held.items() if other != own), default=math.inf)
            d = d if own else -d
            assert got[i, j] == (clamp if d == math.inf else -clamp if d == -math.inf else max(-clamp, min(clamp, math.floor(d + 0.5))),)


def test_hulls_and_diameters():
    rng = random.Random(6)
    sets = [[(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(1, 40))] for _ in range(200)]
    sets += [[(math.cos(t / 40 * math.pi) * 7, math.sin(t / 40 * math.pi) * 7) for t in range(80)], [(k, 2 * k) for k in range(30)], [(1, 1)] * 5, [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(500)]]
    for p in sets:
        want = max(math.hypot(a[0] - b[0], a[1] - b[1]) for a in p for b in p)
        assert screen.diameter(screen.hull(np.array(p, float))) == pytest.approx(want)


def test_spreads_of_clusters_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(screen, "HELD", 40)
    rng = random.Random(7)
    p = [(rng.choice([1, 1, 1, 2, 3]), rng.gauss(0, 5), rng.gauss(0, 5)) for _ in range(3000)] + [(9, 4.0, 4.0)]
    got = {r.label: r.spread for r in screen.spreads(spark.createDataFrame(p, "label long, x double, y double").repartition(7)).collect()}
    for label in (1, 2, 3, 9):
        q = np.array([(x, y) for n, x, y in p if n == label])
        assert got[label] == pytest.approx(np.hypot(q[:, None, 0] - q[:, 0], q[:, None, 1] - q[:, 1]).max())
    assert set(got) == {1, 2, 3, 9}


def test_nearest_on_long_and_short_lines(spark):
    rng = random.Random(8)
    line = {1: [(math.cos(k / 30) * k, math.sin(k / 30) * k) for k in range(1500)], 2: [(0.0, 0.0), (5.0, 5.0)], 3: [(1.0, 1.0), (1.0, 1.0), (4.0, 1.0), (1.0, 1.0)], 4: [(2.0, 2.0)]}
    targets = [(n, rng.choice([1, 1, 2, 3, 4, 5]), rng.uniform(-900, 900), rng.uniform(-900, 900)) for n in range(150)] + [(500, 3, 2.0, 0.0)]

    def d2(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return (p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2

    want = {}
    for n, tid, x, y in targets:
        v = line.get(tid, [])
        found = [(d2((x, y), a, b), k) for k, (a, b) in enumerate(zip(v, v[1:]))]
        if found:
            want[n] = min(found)
    lines = spark.createDataFrame([(tid, k, *p) for tid, v in line.items() for k, p in enumerate(v)], "tid long, k long, x double, y double")
    got = {r.id: (r.d2, r.k) for r in joins.nearest_on_line(lines, spark.createDataFrame(targets, "id long, tid long, px double, py double")).collect()}
    assert set(got) == set(want)
    for n, (d, k) in want.items():
        assert got[n][0] == pytest.approx(d, abs=1e-9) and (got[n][1] == k or abs(d - got[n][0]) < 1e-9)
