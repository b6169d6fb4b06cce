"""Registered queries that SQL cannot say, over their whole tables, against brute force."""

import math

import numpy as np
import pytest

from gridloom import catalog
from gridloom.catalog_view import signed, spec
from gridloom.operators import vectors
from gridloom.sources.tables import grid
from tests.test_view import bilinear, simplified, walked
from tests.test_water import filled

SF = "/root/testdata/sf0.001"


def whole(x, digits):
    return math.floor(math.floor(x * 1e6 + 0.5) / 10**digits)


def raster(spark, value="h", df=None):
    rows = (grid(spark, SF) if df is None else df).collect()
    out = np.zeros((max(r.j for r in rows) + 1, max(r.i for r in rows) + 1))
    for r in rows:
        out[r.j, r.i] = r[value]
    return out


def near(got, want, slack=1):
    assert set(got) == set(want)
    assert all(abs(a - b) <= slack for k in want for a, b in zip(got[k], want[k]))


def measures(p):
    pairs = list(zip(p, p[1:] + p[:1]))
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in pairs) / 2, sum(math.hypot(a[0] - b[0], a[1] - b[1]) for a, b in pairs)


def test_outlines(spark):
    rings = walked(vectors.crossings(signed(spark, SF)).collect())
    want = {}
    for ring, p in rings.items():
        kept = simplified(p, 0.5)
        q = [x for x in p if x in kept]
        area, length = measures(q)
        want[ring] = (len(q), whole(area, 2), whole(length, 2))
    near({r.ring: (r.n_points, r.area, r.length) for r in catalog.QUERIES["outline_rings"](spark, SF).collect()}, want)
    top = max(rings, key=lambda k: (measures(rings[k])[1], -k))
    near({r.ring: (r.n_points, r.length) for r in catalog.QUERIES["longest_outline"](spark, SF).collect()}, {top: (len(rings[top]), whole(measures(rings[top])[1], 2))})


@pytest.mark.parametrize("name,epsilon", [("fill_minimal", 0.0), ("fill_epsilon", 0.01)])
def test_fills(spark, name, epsilon):
    df = catalog.QUERIES[name](spark, SF)
    column = next(c for c in df.columns if c not in "ij")
    got = {(r.i, r.j): r[column] for r in df.collect()}
    from gridloom.sources.tables import tilted

    want = [filled(raster(spark, df=tilted(spark, SF)), epsilon), filled(raster(spark), epsilon)]
    scale = [lambda x: x, lambda x: math.floor(x * 1e6 + 0.5)]
    assert any(all(abs(got[i, j] - s(w[j, i])) <= 1e-6 * max(1.0, abs(s(w[j, i]))) for i, j in got) for w in want for s in scale) and len(got) == want[0].size


def test_ray_hits(spark):
    h = raster(spark)
    n, m = h.shape
    s = spec(n)
    km, ex, want = s.metres_per_cell / 1000, 1.5, {}
    for k in [r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").collect()]:
        o = ((k % 64 - 31.5) * km, 4.0, (k * 13 % n - n / 2) * km)
        down, turn = math.radians(k % 80 + 8.5), math.radians(k * 29 % 360)
        d = (math.cos(down) * math.cos(turn), -math.sin(down), math.cos(down) * math.sin(turn))
        at = lambda t: bilinear(h, (o[0] + d[0] * t) / km + (m - 1) / 2, (o[2] + d[2] * t) / km + (n - 1) / 2) / 1000 * ex  # noqa: B023, E731
        above = lambda t: o[1] + d[1] * t - at(t)  # noqa: B023, E731
        t0, t1 = 0.0, math.inf
        for a, b, axis in ((-m / 2 * km, m / 2 * km, 0), (h.min() / 1000 * ex, h.max() / 1000 * ex, 1), (-n / 2 * km, n / 2 * km, 2)):
            if abs(d[axis]) < 1e-12:
                t1 = t1 if a <= o[axis] <= b else -1.0
                continue
            p, q = sorted(((a - o[axis]) / d[axis], (b - o[axis]) / d[axis]))
            t0, t1 = max(t0, p), min(t1, q)
        if t1 < t0:
            continue
        flat = math.hypot(d[0], d[2])
        step = km * 0.5 / flat if flat > 1e-9 else t1 - t0
        last, before = t0, above(t0)
        for i in range(1, math.ceil((t1 - t0) / step) + 1 if step else 1):
            t = min(t0 + i * step, t1)
            f = above(t)
            if before * f < 0:
                lo, hi = last, t
                while (hi - lo) * max(flat, abs(d[1])) > 0.001:
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if above(mid) * before > 0 else (lo, mid)
                t = (lo + hi) / 2
                want[k] = (whole(t, 3), whole(o[0] + d[0] * t, 3), whole(at(t), 3), whole(o[2] + d[2] * t, 3))
                break
            last, before = t, f
    near({r.ray: (r.t, r.x, r.y, r.z) for r in catalog.QUERIES["ray_hits"](spark, SF).collect()}, want)
    assert len(want) > 50
