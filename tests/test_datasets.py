"""Datasets loaded by their documents: what is read, and each contradiction that fails."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import kinds
from gridloom.sources import datasets, files, rasters
from tests.test_schema import FINE, GOOD, GRID

W, H = GRID["width"], GRID["height"]


def put(spark, at, layers, documents):
    """Rasters (name, array, encoding) and documents; gives the rasters' entries."""
    rows = [(n, i, j, float(v[j, i]), e) for n, v, e in layers for j in range(H) for i in range(W)]
    df = spark.createDataFrame(rows, "name string, i long, j long, v double, e string")
    made = None
    for e in sorted({e for _, _, e in layers}):
        part = files.encoded(df.where(F.col("e") == e), e, W, H)
        made = part if made is None else made.unionByName(part)
    entries = {r.name: {"file": r.name, "bytes": r.bytes, "sha256": r.sha256} for r in rasters.written(made, at).collect()}
    for name, value in documents(entries).items():
        with open(f"{at}/{name}", "w") as f:
            json.dump(value, f)
    return entries


def held(df, *names):
    return {(r.i, r.j): tuple(r[n] for n in names) for r in df.collect()}


@pytest.fixture(scope="module")
def scene(spark, tmp_path_factory):
    at, rng = str(tmp_path_factory.mktemp("scene")), np.random.default_rng(1)
    v = {"h.bin": rng.integers(-900, 900, (H, W)), "x.bin": rng.integers(0, 17, (H, W)), "s.bin": rng.integers(-128, 128, (H, W)), "flow-dir.bin": rng.integers(0, 9, (H, W)), "flow-acc.bin": rng.integers(0, 3000, (H, W)), "flow-basins.bin": rng.integers(0, 9, (H, W))}
    kind = {"h.bin": "int16-le", "s.bin": "int8", "flow-acc.bin": "uint16-le"}
    ring = np.array([[0, 0], [3, 0], [3, 4], [0, 5]], "<f4")
    with open(f"{at}/ring.bin", "wb") as f:
        f.write(ring.tobytes())

    def documents(e):
        entry = {"file": "ring.bin", "bytes": 32, "sha256": hashlib.sha256(ring.tobytes()).hexdigest(), "points": 4}
        level = {"heights": e["h.bin"] | {"grid": GRID}, "satellite": {"file": "i.jpg", "bytes": 1, "sha256": "0", "grid": FINE}, "departments": {"index": e["x.bin"] | {"grid": GRID}, "sdf": e["s.bin"], "outline": entry, "provinceBBoxGrid": [0, 0, 1, 1]}}
        bare = {k: x for k, x in level.items() if k != "departments"}
        site = GOOD["detail"]["sites"][0] | {k: bare[k] for k in ("heights", "satellite")}
        return {
            "terrain.json": GOOD["terrain"] | {"levels": {"default": level, "high": bare}}, "departments.json": GOOD["departments"], "manifest.json": GOOD["detail"] | {"sites": [site]},
            "flow.json": GOOD["flow"] | {"files": {n: e[n] for n in GOOD["flow"]["files"]}}, "places.json": GOOD["places"],
        }

    put(spark, at, [(n, x, kind.get(n, "uint8")) for n, x in v.items()], documents)
    return at, v


def test_everything_loads(spark, scene):
    at, v = scene
    of = lambda *names: {(i, j): tuple(int(v[n][j, i]) for n in names) for j in range(H) for i in range(W)}
    assert held(datasets.terrain(spark, at).cells, "height", "department", "sdf") == of("h.bin", "x.bin", "s.bin")
    assert held(datasets.terrain(spark, at, "high").cells, "height") == of("h.bin")
    known = datasets.departments(spark, at)
    assert held(known.cells, "department", "sdf") == of("x.bin", "s.bin")
    assert {r["index"]: r["name"] for r in known.records.collect()} == {k: str(k) for k in range(1, 17)}
    assert [(r.place, r.x, r.y) for r in known.ring.orderBy("place").collect()] == [(0, 0, 0), (1, 3, 0), (2, 3, 4), (3, 0, 5)]
    flow = datasets.flow(spark, at)
    assert held(datasets.flow(spark, at, rows="2:4").cells, "dir") == {k: x for k, x in of("flow-dir.bin").items() if 2 <= k[1] < 4}
    assert held(flow.cells.where("j >= 2 and j < 4"), "dir", "basin") == {k: x for k, x in of("flow-dir.bin", "flow-basins.bin").items() if 2 <= k[1] < 4}
    assert {k: x[0] for k, x in held(flow.cells, "acc").items()} == {k: pytest.approx(2 ** (x[0] / 256) if x[0] else 1) for k, x in of("flow-acc.bin").items()}
    assert flow.records.first()["sinkName"] == "s" and datasets.flow(spark, at, ["basin"]).cells.columns == ["i", "j", "basin"]
    assert held(datasets.detail(spark, at, "a").cells, "height") == of("h.bin")
    place = datasets.places(spark, at).records.first()
    assert place.id == "Q1" and place.photos[0].license == "CC0" and place.facts.population.year == 2022


def test_layers_are_read_in_ranges(spark, scene, monkeypatch):
    at, v = scene
    monkeypatch.setattr(rasters, "PART_BYTES", 2 * W)
    monkeypatch.setattr(rasters, "BATCH_CELLS", W)
    reader = rasters.LayerReader(at, [{"name": "x", "file": "x.bin", "encoding": "uint8", "bytes": W * H}], W, H, (1, 99))
    assert [(p.low, p.high) for p in reader.partitions()] == [(1, 3), (3, 5), (5, 6)]
    got = [x for p in reader.partitions() for b in reader.read(p) for x in b.column(2).to_pylist()]
    assert got == v["x.bin"][1:].ravel().tolist()


def test_contradictions_fail(spark, scene, tmp_path):
    at, v = scene
    import shutil

    def changed(name, edit, raw=None):
        to = str(tmp_path / f"c{len(list(tmp_path.iterdir()))}")
        shutil.copytree(at, to)
        if raw is not None:
            with open(f"{to}/{raw[0]}", "wb") as f:
                f.write(raw[1])
        if name:
            doc = json.load(open(f"{to}/{name}"))
            edit(doc)
            json.dump(doc, open(f"{to}/{name}", "w"))
        return to

    level = lambda d: d["levels"]["default"]
    cases = [
        (lambda to: datasets.terrain(spark, to).cells.collect(), changed(None, None, ("h.bin", b"12")), "h.bin has another size"),
        (lambda to: datasets.terrain(spark, to).cells.collect(), changed(None, None, ("h.bin", bytes(W * H * 2))), "h.bin has another hash"),
        (lambda to: datasets.terrain(spark, to), changed("terrain.json", lambda d: level(d)["heights"]["grid"].update(height=H + 1, originPx=[100, 200])), "does not cover the heights' ground"),
        (lambda to: datasets.terrain(spark, to), changed("terrain.json", lambda d: (level(d)["heights"]["grid"].update(height=H * 2), level(d)["satellite"]["grid"].update(height=H * 4))), "bytes are not 4 x 12"),
        (lambda to: datasets.terrain(spark, to, "low"), at, "no level low"), (lambda to: datasets.departments(spark, to, "high"), at, "before departments"),
        (lambda to: datasets.flow(spark, to, ["speed"]), at, "no layer speed"), (lambda to: datasets.flow(spark, to), changed("flow.json", lambda d: d.update(schemaVersion=9)), "schemaVersion is not 2"),
        (lambda to: datasets.detail(spark, to, "b"), at, "0 sites b"), (lambda to: datasets.departments(spark, to), changed("departments.json", lambda d: d["departments"][3].update(index=2)), r"departments\[3\] repeats index"),
        (lambda to: datasets.departments(spark, to).ring.collect(), changed("terrain.json", lambda d: level(d)["departments"]["outline"].update(points=5)), "bytes are not 5 points"),
        (lambda to: datasets.places(spark, to).records.collect(), changed("places.json", lambda d: d["places"][0].update(lat="x")), r"places\[0\]\.lat is not a number"),
    ]
    for load, to, message in cases:
        with pytest.raises(Exception, match=message):
            load(to)
    flipped = np.array([[0, 0], [0, 5], [3, 4], [3, 0]], "<f4").tobytes()
    to = changed("terrain.json", lambda d: level(d)["departments"]["outline"].pop("sha256"), ("ring.bin", flipped))
    with pytest.raises(Exception, match="wrong way round"):
        datasets.outline(spark, to, {"file": "ring.bin", "bytes": 32, "points": 4}).collect()
    assert set(kinds.KINDS) == set(GOOD)
