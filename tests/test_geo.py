"""Vectors of the operators, brute force for the iterative ones, and every catalogued query against its SQL."""

import heapq
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom import catalog
from gridloom.functions import geo, solar, text
from gridloom.operators import hydro, joins, profile, ranks, raster
from gridloom.streaming import state

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def cells(spark, rows, name="h"):
    flat = [(i, j, float(v)) for j, row in enumerate(rows) for i, v in enumerate(row)]
    return spark.createDataFrame(flat, f"i long, j long, {name} double")


def as_rows(df, name, width):
    found = {(r.j, r.i): r[name] for r in df.collect()}
    return [[found[j, i] for i in range(width)] for j in range(len(found) // width)]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_coordinates(spark):
    spec = geo.GridSpec(10, 100, 200, 10, 10)
    assert one(spark, *spec.to_pixel(F.lit(0), F.lit(0)), *spec.to_pixel(F.lit(3), F.lit(2))) == (100.5, 200.5, 103.5, 202.5)
    assert one(spark, *spec.of_pixel(F.lit(100), F.lit(200))) == (-0.5, -0.5)
    lon, lat = spec.to_lonlat(*spec.of_lonlat(F.lit(-65.35), F.lit(-23.205)))
    assert one(spark, lon, lat) == pytest.approx((-65.35, -23.205), abs=1e-9)
    x, y = geo.unmercator(*geo.mercator(F.lit(-64.5), F.lit(-24.0)))
    assert one(spark, x, y) == pytest.approx((-64.5, -24.0), abs=1e-9)
    assert one(spark, geo.half_up(F.lit(-2.5)), raster.int16(F.lit(99999.0)))[0] == -2
    assert spec.coarser(3) == geo.GridSpec(10, 100, 200, 4, 4, 3)


#: Instants (UTC) with the sun's elevation and azimuth there by an independent almanac.
ALMANAC = [("2026-06-21 15:30:00", 40.6886, 16.1047), ("2026-06-21 21:00:00", 7.8012, 300.0409), ("2026-12-21 15:30:00", 78.7021, 88.7096), ("2026-10-03 16:00:00", 69.8125, 7.3467)]
SUNRISE, SUNSET = 11 * 60 + 2.63, 21 * 60 + 43.48


def test_sun(spark):
    t = spark.createDataFrame(ALMANAC, "t string, e double, a double").withColumn("t", F.to_timestamp("t"))
    e, a, _ = solar.position(F.col("t"), -24.1856, -65.2994)
    for r in t.select("e", "a", e.alias("x"), a.alias("y")).collect():
        assert abs(r.e - r.x) < 0.5 and abs(r.a - r.y) < 0.5
    rise, fall = solar.sunrise_sunset(F.to_timestamp(F.lit("2026-06-21")), -24.1856, -65.2994)
    assert one(spark, rise, fall) == pytest.approx((SUNRISE, SUNSET), abs=3)


def noise(seed, width, height, most=60):
    rng = random.Random(seed)
    return [[float(rng.randrange(most)) for _ in range(width)] for _ in range(height)]


def test_downsampling_by_brute_force(spark):
    h = noise(1, 11, 7)
    blocks = {}
    for j, row in enumerate(h):
        for i, v in enumerate(row):
            blocks.setdefault((j // 3, i // 3), []).append(v)
    got = raster.box_downsample(cells(spark, h), 3).collect()
    assert {(r.j, r.i): r.h for r in got} == pytest.approx({k: sum(v) / len(v) for k, v in blocks.items()})
    few = noise(2, 11, 7, 3)
    groups = {}
    for j, row in enumerate(few):
        for i, v in enumerate(row):
            groups.setdefault((j // 3, i // 3), []).append(v)
    want = {k: min(set(v), key=lambda x: (-v.count(x), x == 0, x)) for k, v in groups.items()}  # noqa: B023
    assert {(r.j, r.i): r.v for r in raster.plurality_downsample(cells(spark, few, "v"), 3).collect()} == want


def test_statistics_by_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ranks, "READ", 5)
    monkeypatch.setattr(ranks, "BINS", 7)
    h = noise(3, 13, 9, 500)
    flat = np.array(h).ravel()
    s = raster.elevation_stats(cells(spark, h)).first()
    assert tuple(s) == pytest.approx((flat.min(), flat.max(), flat.mean(), *np.percentile(flat, [0.1, 99.9])))
    coarse = {(j, i): np.mean([h[y][x] for y in range(2 * j, min(2 * j + 2, 9)) for x in range(2 * i, min(2 * i + 2, 13))]) for j in range(5) for i in range(7)}
    off = []
    for j in range(9):
        for i in range(13):
            x, y = min(max((i + 0.5) / 2 - 0.5, 0), 6), min(max((j + 0.5) / 2 - 0.5, 0), 4)
            a, b = int(x), int(y)
            at = lambda di, dj: coarse[min(b + dj, 4), min(a + di, 6)]  # noqa: B023, E731
            top, low = at(0, 0) + (at(1, 0) - at(0, 0)) * (x - a), at(0, 1) + (at(1, 1) - at(0, 1)) * (x - a)
            off.append(abs(h[j][i] - (top + (low - top) * (y - b))))
    want = (max(off), np.mean(off), np.percentile(off, 99), np.mean(np.array(off) > 20))
    assert tuple(raster.reconstruction_error(cells(spark, h), 13, 9).first()) == pytest.approx(want)
    values = spark.createDataFrame([(float(v),) for v in flat], "v double")
    assert ranks.at_ranks(values, F.col("v"), [0, 50, 116]) == [sorted(flat)[k] for k in (0, 50, 116)]


def test_hillshade_of_a_plain(spark):
    flat = as_rows(raster.hillshade(cells(spark, [[31] * 5] * 4), 25.0), "shade", 5)
    assert flat == [[math.floor(math.sin(math.pi / 4) * 255 + 0.5)] * 5] * 4


def test_signed_distance_by_brute_force(spark):
    rng = random.Random(9)
    kind = [[rng.random() < 0.2 for _ in range(17)] for _ in range(12)]
    block = spark.createDataFrame([(i, j, kind[j][i]) for i in range(17) for j in range(12)], "i long, j long, inside boolean")
    got = as_rows(raster.signed_distance(block), "s", 17)
    for j in range(12):
        for i in range(17):
            d = min(math.hypot(i - x, j - y) for x in range(17) for y in range(12) if kind[y][x] != kind[j][i])
            assert got[j][i] == math.floor((d if kind[j][i] else -d) + 0.5)
    line = spark.createDataFrame([(i, 0, True) for i in range(300)], "i long, j long, inside boolean")
    assert {r.s for r in raster.signed_distance(line).collect()} == {127}
    with pytest.raises(ValueError):
        raster.crop(block, 10, 0, 8, 4, (17, 12))


def test_rasterize_hole(spark):
    def ring(a, b, poly=0):
        c = [(a, a), (b, a), (b, b), (a, b), (a, a)]
        return [(1, poly, *c[k], *c[k + 1]) for k in range(4)]

    e = spark.createDataFrame(ring(0.5, 5.5) + ring(2.5, 3.5), "ord long, poly long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.i, r.j) for r in raster.rasterize(e).collect()}
    assert len(got) == 24 and (3, 3) not in got


def flood(h, eps):
    """Priority flood from the edge."""
    n, m = len(h), len(h[0])
    f = [[None] * m for _ in range(n)]
    heap = []
    for j in range(n):
        for i in range(m):
            if j in (0, n - 1) or i in (0, m - 1):
                f[j][i] = h[j][i]
                heapq.heappush(heap, (f[j][i], j, i))
    while heap:
        z, j, i = heapq.heappop(heap)
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                y, x = j + a, i + b
                if 0 <= y < n and 0 <= x < m and f[y][x] is None:
                    f[y][x] = h[y][x] if h[y][x] > z else z + eps
                    heapq.heappush(heap, (f[y][x], y, x))
    return f


@pytest.mark.parametrize("eps", [0.0, 0.25])
def test_fill_is_priority_flood(spark, eps):
    rng = random.Random(6)
    h = [[float(rng.randrange(12)) for _ in range(19)] for _ in range(14)]
    assert as_rows(hydro.fill(cells(spark, h), 19, 14, eps, tile=6), "f", 19) == flood(h, eps)


@pytest.mark.parametrize("name, eps", [("fill_minimal", 0.0), ("fill_epsilon", 0.01)])
def test_fill_queries_read_the_whole_raster(spark, name, eps):
    h = as_rows(catalog.grid(spark, SF), "h", 64)
    assert len(h) == spark.read.parquet(f"{SF}/embeddings.parquet").count() > 40
    assert as_rows(catalog.QUERIES[name](spark, SF), "f", 64) == [[round(x, 6) for x in row] for row in flood(h, eps)]


def test_flow(spark):
    ramp = cells(spark, [[4, 3, 2, 1, 0]] * 3)
    g = hydro.edges(hydro.d8(ramp), 5)
    acc = {r.src: r.acc for r in hydro.accumulation(g).collect()}
    assert sum(acc[r.src] for r in g.where("dst is null").collect()) == 15
    pit = cells(spark, [[9, 9, 9], [9, 0, 9], [8, 8, 8]])
    g = hydro.edges(hydro.d8(pit), 3)
    assert {r.terminal for r in hydro.flow_terminals(g).collect()} == {4}
    assert hydro.river_threshold(spark.createDataFrame([(x,) for x in (10, 8, 6, 4, 2)], "acc long"), 0.4).first()[0] == 8


def test_profiles_by_brute_force(spark):
    rng = random.Random(4)
    lines = {t: [None if rng.random() < 0.1 else float(rng.randrange(0, 200)) for _ in range(rng.randrange(1, 40))] for t in range(12)}
    rows = [(t, k, k * 70.0, v) for t, line in lines.items() for k, v in enumerate(line)]
    base = spark.createDataFrame(rows, "tid long, k long, distance double, elevation double")
    want = {}
    for t, line in lines.items():
        known = [(k, v) for k, v in enumerate(line) if v is not None]
        if len(known) < 2:
            continue
        anchor, up, down = known[0][1], 0.0, 0.0
        for _, v in known:
            if abs(v - anchor) >= 25:
                up, down, anchor = up + max(v - anchor, 0), down + max(anchor - v, 0), v
        low, high = min(v for _, v in known), max(v for _, v in known)
        want[t] = (len(known), low, high, next(k for k, v in known if v == low), next(k for k, v in known if v == high), up, down)
    got = {r.tid: (r.defined, r.min_e, r.max_e, r.min_k, r.max_k, r.ascent, r.descent) for r in profile.profile_stats(base).collect()}
    assert got == want
    asked = [(t, x) for t in lines for x in (-3.0, 0.0, 35.0, 77.0, 350.0, 1e6)]
    for r in joins.value_at(base, spark.createDataFrame(asked, "tid long, at double"), 100.0).collect():
        line, q = lines[r.tid], min(max(r.at, 0.0), 70.0 * (len(lines[r.tid]) - 1))
        k = min(int(q // 70), len(line) - 1)
        a, b, f = line[k], line[min(k + 1, len(line) - 1)], q / 70 - k
        assert r.elevation == (a if q in (0, 70.0 * (len(line) - 1)) else None if a is None or b is None else pytest.approx(a + (b - a) * f))


def test_text(spark):
    u, f = text.strip_utm, F.lit
    assert one(spark, u(f("https://m.org/p?utm_id=9&q=1&utm_term=b&z=")), u(f("https://m.org/p?utm_id=9")), u(f("https://m.org/p"))) == ("https://m.org/p?q=1&z=", "https://m.org/p", "https://m.org/p")
    y = text.literal_year
    assert one(spark, *[y(f(x)) for x in ("+1987-00-00T00:00:00Z", "-0044-03-15T00:00:00Z", "1987")]) == (1987, -44, None)
    assert one(spark, text.name_key(f("Señora Íñiguez, 2ª")), text.metres_es(f(7654321.5))) == ("senorainiguez2", "7.654.322 m")


def test_stream_keeps_what_batch_finds(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("item"), F.col("value").alias("d"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = state.resident_stream(stream, idle_days=4000).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
    last = {}
    q = query.foreachBatch(lambda df, n: last.update({r.key: set(r["items"]) for r in df.collect()})).start()
    q.processAllAvailable()
    q.stop()
    want = {}
    for r in state.resident_set(e, "key", 3).collect():
        want.setdefault(r.key, set()).add(r.item)
    assert last == want


def test_rules_that_fail(spark):
    for c, message in ((text.licence_required(F.lit("CC BY-NC 4.0")), "licence not allowed"), (text.year_required(F.lit("1987")), "not a time"), (text.element_id(F.lit("area/5")), "bad element"), (text.display_name(F.lit(None), F.lit(None), F.lit("Q5")), "Q5 has no name")):
        with pytest.raises(Exception, match=message):
            spark.range(1).select(c).collect()
    assert one(spark, text.licence_required(F.lit("CC0")), text.year_required(F.lit("-0044-03-15T00:00:00Z")), text.description(F.lit("d"), F.lit("Q1"), ["Q1"]), text.description(F.lit("d"), F.lit("Q2"), ["Q1"])) == ("CC0", -44, None, "d")


def test_nested_records_differ_by_path(spark):
    schema = "key long, a struct<b:array<struct<c:int>>,m:map<string,int>>, t string"
    old = spark.createDataFrame([(1, ([(1,), (2,)], {"x": 1}), "same"), (2, None, "gone")], schema)
    new = spark.createDataFrame([(1, ([(1,), (3,), (4,)], {"x": 1, "y": 2}), "same")], schema)
    got = {(r.key, r.path, r.old, r.new) for r in joins.record_diff(old, new, "key").collect()}
    assert got == {(1, "a.b[1].c", "2", "3"), (1, "a.b[2].c", None, "4"), (1, "a.m.y", None, "2"), (2, "t", "gone", None)}
    assert joins.record_diff(old, new, "key", 2).count() == 2


def value(x):
    if isinstance(x, (list, tuple)):
        return tuple(value(v) for v in x)
    return x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    rows = sorted(repr(tuple(value(r[c]) for c in order)) for r in df.collect())
    at = [want.columns.index(c) for c in order]
    assert rows == sorted(repr(tuple(value(r[k]) for k in at)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
