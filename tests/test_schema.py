"""Declared documents: good ones of every kind, and each rule broken once, named with its path."""

import json

import pytest

from gridloom.operators import kinds, schema

PHOTO = {"file": "a.jpg", "pageUrl": "p", "thumbUrl": "t", "thumbWidth": 1, "thumbHeight": 2.5, "width": 10, "height": 20, "license": "CC BY-SA 4.0", "licenseUrl": None, "author": None, "credit": "c", "description": None, "isMain": True}
FILE = {"file": "f.bin", "bytes": 12, "sha256": "00"}
GRID = {"zoom": 10, "originPx": [100, 200.0], "width": 4, "height": 6, "scale": 1}
FINE = {"zoom": 11, "originPx": [200, 400], "width": 8, "height": 12, "scale": 1}
LEVEL = {"heights": FILE | {"grid": GRID, "elevation": {}}, "satellite": FILE | {"grid": FINE}}
PLACE = {"id": "Q1", "name": "n", "description": None, "lat": -23.1, "lon": -65, "elevationMeters": 2.5, "elevationSource": "dem", "demElevationMeters": 3, "coordinateSource": "osm", "osmElementUrl": "u", "department": "d", "wikidataUrl": "w", "eswikiUrl": None, "extract": None, "photos": [{"thumbUrl": "t", "fullUrl": "f", "width": 1, "height": 1, "author": None, "credit": None, "license": "CC0", "licenseUrl": None, "pageUrl": "p", "description": None}], "facts": {"instanceOf": ["town"], "population": {"amount": 5, "year": 2022}, "areaKm2": None, "heritage": [], "foundedYear": None}}
GOOD = {
    "raw-places": {"license": "CC0", "places": [{"id": "Q7", "lastrevid": 1, "url": "u", "label": {"es": "a", "en": None}, "description": {"es": None, "en": None}, "coordinates": {"lat": 1, "lon": 2.5}, "eswiki": None}]},
    "osm-coordinates": {"places": [{"id": "Q7", "name": "n", "wikidataCoordinate": {"lat": 1, "lon": 2, "precision": None}, "osm": {"element": "node/5", "type": "lake", "lat": 1.5, "lon": 2.5, "url": "https://www.openstreetmap.org/node/5"}}]},
    "commons-photos": {"places": [{"id": "Q7", "commonsCategory": None, "photos": [PHOTO, PHOTO]}]},
    "depicts-photos": {"places": [{"id": "Q7", "photos": [PHOTO | {"selection": "wikidata-P18"}]}]},
    "extracts": {"places": [{"id": "Q7", "title": "t", "revision": "123", "url": "u", "extract": "e", "license": "l", "licenseUrl": "v"}]},
    "facts": {"places": [{"id": "Q7", "lastrevid": 2, "instanceOf": ["x", "y"], "population": {"amount": 7, "date": "+2022-00-00T00:00:00Z"}, "areaKm2": 1.5, "heritage": [], "inception": None}]},
    "places": {"schemaVersion": 5, "pipelineVersion": 3, "inputSha256": "s", "sources": {"any": 1}, "places": [PLACE]},
    "departments": {"schemaVersion": 2, "attribution": "a", "departments": [{"index": k, "name": str(k)} for k in range(1, 17)]},
    "regions": {"schemaVersion": 1, "source": {"title": "t", "publisher": "p", "url": "u"}, "regions": [{"id": i, "name": "n", "quote": "q", "departments": ["d"], "description": {"text": "t", "quote": "q"}} for i in kinds.REGION_IDS]},
    "flow": {"schemaVersion": 2, "pipelineVersion": 1, "grid": GRID, "riverAcc": 9, "sources": {"attribution": "a"}, "files": {n: {"file": n, "bytes": 1} for n in ("flow-dir.bin", "flow-acc.bin", "flow-basins.bin")}, "basins": [{"id": 1, "kind": "cerrada", "cells": 2, "outletAcc": 3, "outletDepartmentIndex": 4, "outlet": [1, 2], "outletLonLat": [1.5, 2], "terminal": [1, 2], "terminalLonLat": [0, 0], "sinkName": "s"}]},
    "detail": {"schemaVersion": 2, "pipelineVersion": 1, "inputSha256": "s", "sites": [{"id": "a", "name": "n", "wikidata": "Q1", "lon": 1, "lat": 2, "source": {"url": "u"}, "sizeKm": [1, 2]} | LEVEL]},
    "terrain": {"schemaVersion": 1, "pipelineVersion": 1, "levels": {"default": LEVEL, "high": LEVEL}, "sources": {"attribution": "a"}},
}
MISSING = object()
#: (kind, where, new value, path, problem)
BROKEN = [
    ("raw-places", ("places", 0, "id"), "Q07", "places[0].id", "has another form"), ("raw-places", ("places", 0, "lastrevid"), "1", "places[0].lastrevid", "is not a number"), ("raw-places", ("places", 0, "label", "es"), 4, "places[0].label.es", "is not text"),
    ("raw-places", ("places", 0, "label", "es"), MISSING, "places[0].label.es", "is missing"), ("raw-places", ("places", 0, "label"), None, "places[0].label", "is not an object"), ("raw-places", ("places", 0, "coordinates", "alt"), 1, "places[0].coordinates.alt", "is unknown"),
    ("raw-places", ("places", 0, "extra"), None, "places[0].extra", "is unknown"), ("raw-places", ("places",), {}, "places", "is not a list"), ("raw-places", ("places",), MISSING, "places", "is missing"), ("raw-places", ("places", 0), 3, "places[0]", "is not an object"),
    ("osm-coordinates", ("places", 0, "osm", "element"), "node/05", "places[0].osm.element", "has another form"), ("osm-coordinates", ("places", 0, "osm", "url"), "https://www.openstreetmap.org/way/5", "places[0].osm.url", "is not the element's page"),
    ("commons-photos", ("places", 0, "photos", 1, "license"), "CC BY-NC 4.0", "places[0].photos[1].license", "has another form"), ("commons-photos", ("places", 0, "photos", 0, "width"), 0, "places[0].photos[0].width", "is out of range"), ("commons-photos", ("places", 0, "photos", 0, "isMain"), "true", "places[0].photos[0].isMain", "is not true or false"),
    ("commons-photos", ("places", 0, "photos", 0, "selection"), "wikidata-P18", "places[0].photos[0].selection", "is unknown"), ("depicts-photos", ("places", 0, "photos", 0, "selection"), "other", "places[0].photos[0].selection", "is none of wikidata-P18, commons-depicts-P180"),
    ("extracts", ("places", 0, "revision"), "12a", "places[0].revision", "has another form"), ("facts", ("places", 0, "population", "date"), "2022", "places[0].population.date", "has another form"), ("facts", ("places", 0, "instanceOf", 1), None, "places[0].instanceOf[1]", "is not text"), ("facts", ("places", 0, "inception"), MISSING, "places[0].inception", "is missing"),
    ("places", ("schemaVersion",), 4, "schemaVersion", "is not 5"), ("places", ("places", 0, "osmElementUrl"), MISSING, "places[0].osmElementUrl", "does not go with the source"), ("places", ("places", 0, "coordinateSource"), "wikidata", "places[0].osmElementUrl", "does not go with the source"),
    ("places", ("places", 0, "elevationSource"), "gps", "places[0].elevationSource", "is none of dem, detail-dem"), ("places", ("places", 0, "detailElevationMeters"), None, "places[0].detailElevationMeters", "is not a number"), ("places", ("places", 0, "facts", "population", "year"), "2022", "places[0].facts.population.year", "is not a number"),
    ("departments", ("departments", 3, "index"), 17, "departments[3].index", "is out of range"), ("departments", ("departments", 3, "index"), 2, "departments[3]", "repeats index"), ("departments", ("departments", 15), MISSING, "departments", "has not 16 items"),
    ("regions", ("regions", 1, "id"), "puna", "regions[1]", "repeats id"), ("regions", ("regions", 0, "name"), "", "regions[0].name", "is empty"), ("regions", ("regions", 0, "nuance"), 1, "regions[0].nuance", "is not text"), ("regions", ("source",), [], "source", "is not an object"),
    ("flow", ("files", "flow-acc.bin"), MISSING, "files.flow-acc.bin", "is missing"), ("flow", ("basins", 0, "kind"), "open", "basins[0].kind", "is none of cerrada, abierta"), ("flow", ("grid", "originPx", 1), "7", "grid.originPx[1]", "is not a number"),
    ("detail", ("sites", 0, "sizeKm"), [1], "sites[0].sizeKm", "has not 2 items"), ("detail", ("sites", 0, "satellite", "grid", "originPx", 0), 203, "sites[0].satellite.grid", "does not cover the heights' ground"), ("terrain", ("levels", "high"), MISSING, "levels.high", "is missing"),
    ("terrain", ("levels", "default", "satellite", "grid", "width"), 20, "levels.default.satellite.grid", "does not cover the heights' ground"),
]


def broken(doc, where, value):
    out = json.loads(json.dumps(doc))
    at = out
    for step in where[:-1]:
        at = at[step]
    if value is MISSING:
        del at[where[-1]]
    else:
        at[where[-1]] = value
    return out


def found(spark, kind, docs):
    df = spark.createDataFrame([(n, d) for n, d in enumerate(docs)], "name long, content string")
    out = {}
    for r in schema.document_problems(df, kinds.KINDS[kind]).collect():
        out.setdefault(r.name, []).append((r.path, r.problem))
    return out


@pytest.mark.parametrize("kind", list(GOOD))
def test_each_kind(spark, kind):
    cases = [b for b in BROKEN if b[0] == kind]
    docs = [json.dumps(GOOD[kind]), None, "{not json", "[]", "null", *[json.dumps(broken(GOOD[kind], where, value)) for _, where, value, _, _ in cases]]
    got = found(spark, kind, docs)
    assert got.pop(1) == [("", "is missing")] and got.pop(2) == [("", "is not JSON")] and got.pop(3) == got.pop(4) == [("", "is not an object")]
    assert got == {5 + n: [(path, problem)] for n, (*_, path, problem) in enumerate(cases)} and len(cases) > 0


def test_checked_documents_and_their_items(spark):
    df = spark.createDataFrame([("good", json.dumps(GOOD["facts"])), ("bad", json.dumps(broken(GOOD["facts"], ("places", 0, "id"), "x")))], "name string, content string")
    good = schema.checked_documents(df.where("name = 'good'"), kinds.FACTS)
    rows = schema.items_of(good, "places", "id string, instanceOf array<string>, population struct<amount:double,date:string>").collect()
    assert [(r.id, r.instanceOf, r.population.amount) for r in rows] == [("Q7", ["x", "y"], 7.0)]
    with pytest.raises(Exception, match=r"bad: places\[0\]\.id has another form"):
        schema.checked_documents(df, kinds.FACTS).collect()
    assert schema.document_problems(df.limit(0), kinds.FACTS).count() == 0


def test_all_problems_at_once_and_repeated_items(spark):
    doc = {"a": [1, 2, 1, "x", 2], "b": 1, "c": 2}
    node = schema.Record(keys={"a": schema.Listed(item=schema.Number(), unique=""), "b": schema.Text()})
    df = spark.createDataFrame([(1, json.dumps(doc))], "name long, content string")
    assert sorted((r.path, r.problem) for r in schema.document_problems(df, node).collect()) == [("a[2]", "repeats an item"), ("a[3]", "is not a number"), ("a[4]", "repeats an item"), ("b", "is not text"), ("c", "is unknown")]
