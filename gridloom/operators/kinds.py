"""The kinds of documents that a scene is made of, as closed declarations."""

from __future__ import annotations

from gridloom.functions.text import LICENCES
from gridloom.operators.schema import Flag, Listed, Number, Record, Text
from gridloom.operators.validate import ELEMENT, ITEM_ID

#: Forms, versions and counts that documents have.
TIME = r"^[+-]\d+-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
DIGITS = r"^\d+$"
OSM_PAGE = "https://www.openstreetmap.org/"
SELECTIONS = ("wikidata-P18", "commons-depicts-P180")
REGION_IDS = ("puna", "quebrada", "valles", "yungas")
DEPARTMENTS = 16
VERSIONS = {"places": 5, "departments": 2, "regions": 1, "flow": 2, "detail": 2, "terrain": 1}

_text, _maybe, _number, _id = Text(), Text(null=True), Number(), Text(ITEM_ID)
_point = {"lat": _number, "lon": _number, "precision": Number(null=True)}
_languages = Record(keys={"es": _maybe, "en": _maybe})
_file = {"file": _text, "bytes": _number, "sha256": _text}


def _download(item: Record) -> Record:
    """What every downloaded list has around its places."""
    heads = ("description", "license", "licenseUrl", "attribution", "downloaded", "by")
    return Record(keys={**{h: _text for h in heads}, "places": Listed(item=item)}, optional=frozenset(heads), open_=True)


RAW_PLACES = _download(Record(keys={"id": _id, "lastrevid": _number, "url": _text, "label": _languages, "description": _languages, "coordinates": Record(keys=_point, optional=frozenset({"precision"})), "eswiki": _maybe}))

OSM_COORDINATES = _download(
    Record(keys={
        "id": _id, "name": _text, "wikidataCoordinate": Record(keys=_point, optional=frozenset({"precision"})),
        "osm": Record(keys={"element": Text(ELEMENT), "type": _text, "lat": _number, "lon": _number, "url": _text}, also=(("url", "is not the element's page", f"variant_get({{0}}, '$.url', 'string') = concat('{OSM_PAGE}', variant_get({{0}}, '$.element', 'string'))"),)),
    })
)

_photo = {"file": _text, "pageUrl": _text, "thumbUrl": _text, "thumbWidth": _number, "thumbHeight": _number, "width": Number(above=0), "height": Number(above=0), "license": Text(LICENCES), "licenseUrl": _maybe, "author": _maybe, "credit": _maybe, "description": _maybe, "isMain": Flag()}
COMMONS_PHOTOS = _download(Record(keys={"id": _id, "commonsCategory": _maybe, "photos": Listed(item=Record(keys=_photo))}))
DEPICTS_PHOTOS = _download(Record(keys={"id": _id, "photos": Listed(item=Record(keys=_photo | {"selection": Text(among=SELECTIONS)}))}))

EXTRACTS = _download(Record(keys={"id": _id, "title": _text, "revision": Text(DIGITS), "url": _text, "extract": _text, "license": _text, "licenseUrl": _text}))

FACTS = _download(Record(keys={"id": _id, "lastrevid": _number, "instanceOf": Listed(item=_text), "population": Record(null=True, keys={"amount": _number, "date": Text(TIME)}), "areaKm2": Number(null=True), "heritage": Listed(item=_text), "inception": Text(TIME, null=True)}))


_OSM_PAGE = "(variant_get({0}, '$.coordinateSource', 'string') = 'osm') = (variant_get({0}, '$.osmElementUrl', 'variant') is not null)"

PLACES = Record(open_=True, keys={
    "schemaVersion": Number(equal=VERSIONS["places"]), "pipelineVersion": _number, "inputSha256": _text, "sources": Record(open_=True),
    "places": Listed(item=Record(open_=True, optional=frozenset({"detailElevationMeters", "osmElementUrl"}), also=(("osmElementUrl", "does not go with the source", _OSM_PAGE),), keys={
        "id": _text, "name": _text, "description": _maybe, "lat": _number, "lon": _number, "elevationMeters": _number, "elevationSource": Text(among=("dem", "detail-dem")), "demElevationMeters": _number, "detailElevationMeters": _number,
        "coordinateSource": Text(among=("wikidata", "osm")), "osmElementUrl": _text, "department": _text, "wikidataUrl": _text, "eswikiUrl": _maybe,
        "photos": Listed(item=Record(open_=True, keys={"thumbUrl": _text, "fullUrl": _text, "width": _number, "height": _number, "author": _maybe, "credit": _maybe, "license": Text(LICENCES), "licenseUrl": _maybe, "pageUrl": _text, "description": _maybe})),
        "extract": Record(null=True, open_=True, keys={"text": _text, "url": _text, "revision": _text, "license": _text, "licenseUrl": _text}),
        "facts": Record(null=True, open_=True, keys={"instanceOf": Listed(item=_text), "population": Record(null=True, open_=True, keys={"amount": _number, "year": _number}), "areaKm2": Number(null=True), "heritage": Listed(item=_text), "foundedYear": Number(null=True)}),
    })),
})

DEPARTMENT_LIST = Record(open_=True, keys={"schemaVersion": Number(equal=VERSIONS["departments"]), "departments": Listed(count=DEPARTMENTS, unique="index", item=Record(open_=True, keys={"index": Number(low=1, high=DEPARTMENTS), "name": _text})), "attribution": _text})

_filled = Text(filled=True)
REGIONS = Record(open_=True, keys={
    "schemaVersion": Number(equal=VERSIONS["regions"]), "source": Record(open_=True, keys={"title": _filled, "publisher": _filled, "url": _filled}),
    "regions": Listed(count=len(REGION_IDS), unique="id", item=Record(open_=True, optional=frozenset({"nuance"}), keys={"id": Text(among=REGION_IDS), "name": _filled, "quote": _filled, "nuance": _filled, "departments": Listed(item=_filled), "description": Record(open_=True, keys={"text": _filled, "quote": _filled})})),
})

_pixels = Listed(item=_number, count=2)
GRID = Record(open_=True, keys={"zoom": _number, "originPx": _pixels, "width": _number, "height": _number, "scale": _number})
FLOW = Record(open_=True, keys={
    "schemaVersion": Number(equal=VERSIONS["flow"]), "pipelineVersion": _number, "grid": GRID, "riverAcc": _number, "sources": Record(open_=True, keys={"attribution": _text}),
    "files": Record(open_=True, keys={n: Record(open_=True, keys={"file": _text, "bytes": _number}) for n in ("flow-dir.bin", "flow-acc.bin", "flow-basins.bin")}),
    "basins": Listed(item=Record(open_=True, optional=frozenset({"sinkName"}), keys={"id": _number, "kind": Text(among=("cerrada", "abierta")), "cells": _number, "outletAcc": _number, "outletDepartmentIndex": _number, "outlet": _pixels, "outletLonLat": _pixels, "terminal": _pixels, "terminalLonLat": _pixels, "sinkName": _text})),
})


def _edge(at: str, axis: int, far: bool) -> str:
    """A grid's edge in parts of the world's side."""
    n = lambda key: f"variant_get({{0}}, '$.{at}.grid.{key}', 'double')"
    cells = f" + {n(('width', 'height')[axis])} * {n('scale')}" if far else ""
    return f"({n(f'originPx[{axis}]')}{cells}) / pow(2, {n('zoom')})"


#: Whether a site's heights and image cover the same ground, to half a pixel of the finer zoom.
_HALF = "0.5 / pow(2, greatest(variant_get({0}, '$.heights.grid.zoom', 'double'), variant_get({0}, '$.satellite.grid.zoom', 'double')))"
_SAME_GROUND = " and ".join(f"abs({_edge('heights', axis, far)} - {_edge('satellite', axis, far)}) <= {_HALF}" for axis in (0, 1) for far in (False, True))
_with_grid = Record(open_=True, keys=_file | {"grid": GRID})
DETAIL = Record(open_=True, keys={
    "schemaVersion": Number(equal=VERSIONS["detail"]), "pipelineVersion": _number, "inputSha256": _text,
    "sites": Listed(item=Record(open_=True, also=(("satellite.grid", "does not cover the heights' ground", _SAME_GROUND),), keys={"id": _text, "name": _text, "wikidata": _text, "lon": _number, "lat": _number, "source": Record(open_=True, keys={"url": _text}), "sizeKm": _pixels, "heights": _with_grid, "satellite": _with_grid})),
})

_level = Record(open_=True, optional=frozenset({"departments"}), also=(("satellite.grid", "does not cover the heights' ground", _SAME_GROUND),), keys={"heights": _with_grid, "satellite": _with_grid, "departments": Record(open_=True, keys={"index": _with_grid, "sdf": Record(open_=True, keys=_file), "provinceBBoxGrid": Listed(item=_number, count=4)})})
TERRAIN = Record(open_=True, keys={"schemaVersion": Number(equal=VERSIONS["terrain"]), "pipelineVersion": _number, "levels": Record(open_=True, keys={"default": _level, "high": _level}), "sources": Record(open_=True, keys={"attribution": _text})})

KINDS = {"raw-places": RAW_PLACES, "osm-coordinates": OSM_COORDINATES, "commons-photos": COMMONS_PHOTOS, "depicts-photos": DEPICTS_PHOTOS, "extracts": EXTRACTS, "facts": FACTS, "places": PLACES, "departments": DEPARTMENT_LIST, "regions": REGIONS, "flow": FLOW, "detail": DETAIL, "terrain": TERRAIN}
