"""Datasets of a folder: a checked document, and the rasters, rings and records that it names.

A document is read by Spark, checked against its declared kind and, but for its lists of records, held by the driver: it
names a handful of files. Rasters are one scan of the layers that are asked for; files' hashes are compared in one
job before, where the document has them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import kinds, schema
from gridloom.operators.raster import log_decode
from gridloom.sources import files, rasters

#: How layers are kept.
HEIGHTS, INDEX, SDF, DIRECTIONS, ACCUMULATION = "int16-le", "uint8", "int8", "uint8", "uint16-le"


@dataclass(frozen=True)
class Dataset:
    """What a document says (as a dict), and tables of what it names."""

    said: dict
    cells: DataFrame | None = None
    records: DataFrame | None = None
    ring: DataFrame | None = None


def document(spark: SparkSession, path: str, kind: str) -> tuple[dict, DataFrame]:
    """A document of a declared kind and its row (name, content); one that breaks a rule fails with all its problems."""
    rows = files.documents(spark, path).select(F.lit(path.rsplit("/", 1)[-1]).alias("name"), "content")
    good = schema.checked_documents(rows, kinds.KINDS[kind])
    return json.loads(good.first()["content"]), good


def _verified(spark: SparkSession, folder: str, entries: list[dict]) -> None:
    """Files (file, bytes, sha256) are as their manifest says, each hashed by a task; the first that is not fails."""
    said = spark.createDataFrame([(e["file"], int(e["bytes"]), e["sha256"]) for e in entries if "sha256" in e], "name string, bytes long, sha256 string")

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                if wrong := rasters.problem(folder, r["name"], r["bytes"], r["sha256"]):
                    raise ValueError(f"{r['name']} {wrong}")
            yield b

    said.mapInArrow(run, said.schema).write.format("noop").mode("overwrite").save()


def _layer(name: str, entry: dict, encoding: str) -> dict:
    return {"name": name, "file": entry["file"], "encoding": encoding, "bytes": int(entry["bytes"])}


def _cells(spark: SparkSession, folder: str, named: dict[str, tuple[dict, str]], grid: dict, wanted: list[str] | None, rows: str = ":") -> DataFrame:
    chosen = {n: x for n, x in named.items() if wanted is None or n in wanted}
    if wanted and set(wanted) - set(named):
        raise ValueError(f"no layer {', '.join(sorted(set(wanted) - set(named)))}")
    _verified(spark, folder, [e for e, _ in chosen.values()])
    return rasters.layers(spark, folder, [_layer(n, e, k) for n, (e, k) in chosen.items()], int(grid["width"]), int(grid["height"]), rows)


def terrain(spark: SparkSession, folder: str, level: str = "default", layers: list[str] | None = None, rows: str = ":") -> Dataset:
    """terrain.json and the rasters of one of its levels: ``height``, and ``department`` and ``sdf`` where it has them."""
    said, _ = document(spark, f"{folder}/terrain.json", "terrain")
    if level not in said["levels"]:
        raise ValueError(f"no level {level}")
    at = said["levels"][level]
    named = {"height": (at["heights"], HEIGHTS)}
    if "departments" in at:
        named |= {"department": (at["departments"]["index"], INDEX), "sdf": (at["departments"]["sdf"], SDF)}
    return Dataset(said, _cells(spark, folder, named, at["heights"]["grid"], layers, rows))


def departments(spark: SparkSession, folder: str, level: str = "default") -> Dataset:
    """departments.json's list (index, name), and a level's index, distances and outline; a terrain without them fails."""
    known = terrain(spark, folder, level)
    if "departments" not in known.said["levels"][level]:
        raise ValueError("the terrain was built before departments")
    said, rows = document(spark, f"{folder}/departments.json", "departments")
    at = known.said["levels"][level]["departments"]
    ring = outline(spark, folder, at["outline"]) if "outline" in at else None
    return Dataset(said, known.cells.select("i", "j", "department", "sdf"), schema.items_of(rows, "departments", "index long, name string"), ring)


def outline(spark: SparkSession, folder: str, entry: dict) -> DataFrame:
    """(place, x, y) of a ring of 32-bit pairs; its size must be that of its points, and its area positive."""
    if entry["bytes"] != 8 * entry["points"] or entry["points"] < 3:
        raise ValueError(f"{entry['file']}: {entry['bytes']} bytes are not {entry['points']} points")
    _verified(spark, folder, [entry])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                p = np.frombuffer(bytes(content), "<f4").reshape(-1, 2).astype(float)
                q = np.roll(p, -1, axis=0)
                if (p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() <= 0:
                    raise ValueError("the ring runs the wrong way round")
                yield pd.DataFrame({"place": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1]})

    return files.binary(spark, folder, entry["file"]).select("content").mapInPandas(run, "place long, x double, y double")


def flow(spark: SparkSession, folder: str, layers: list[str] | None = None, rows: str = ":") -> Dataset:
    """flow.json, its basins, and cells of ``rows`` with ``dir``, ``acc`` (cells upstream, decoded) and ``basin``."""
    said, content = document(spark, f"{folder}/flow.json", "flow")
    of = said["files"]
    named = {"dir": (of["flow-dir.bin"], DIRECTIONS), "acc": (of["flow-acc.bin"], ACCUMULATION), "basin": (of["flow-basins.bin"], INDEX)}
    cells = _cells(spark, folder, named, said["grid"], layers, rows)
    if "acc" in cells.columns:
        cells = cells.withColumn("acc", F.when(F.col("acc") > 0, log_decode(F.col("acc"))).otherwise(1.0))
    basins = schema.items_of(content, "basins", "id long, kind string, cells long, outletAcc double, outletDepartmentIndex long, outlet array<double>, outletLonLat array<double>, terminal array<double>, terminalLonLat array<double>, sinkName string")
    return Dataset(said, cells, basins)


def detail(spark: SparkSession, folder: str, site: str) -> Dataset:
    """manifest.json of the sites, and the heights of one of them."""
    said, rows = document(spark, f"{folder}/manifest.json", "detail")
    found = [s for s in said["sites"] if s["id"] == site]
    if len(found) != 1:
        raise ValueError(f"{len(found)} sites {site}")
    at = found[0]["heights"]
    return Dataset(said, _cells(spark, folder, {"height": (at, HEIGHTS)}, at["grid"], None), schema.items_of(rows, "sites", "id string, name string, wikidata string, lon double, lat double, sizeKm array<double>"))


PLACE = "id string, name string, description string, lat double, lon double, elevationMeters double, elevationSource string, demElevationMeters double, detailElevationMeters double, coordinateSource string, osmElementUrl string, department string, wikidataUrl string, eswikiUrl string"


def places(spark: SparkSession, folder: str) -> Dataset:
    """places.json's records, with their photos, extracts and facts."""
    photo = "struct<thumbUrl:string,fullUrl:string,width:double,height:double,author:string,credit:string,license:string,licenseUrl:string,pageUrl:string,description:string>"
    extract = "struct<text:string,url:string,revision:string,license:string,licenseUrl:string>"
    facts = "struct<instanceOf:array<string>,population:struct<amount:double,year:long>,areaKm2:double,heritage:array<string>,foundedYear:long>"
    rows = schema.checked_documents(files.documents(spark, f"{folder}/places.json").withColumn("name", F.lit("places.json")), kinds.PLACES)
    return Dataset({}, records=schema.items_of(rows, "places", f"{PLACE}, photos array<{photo}>, extract {extract}, facts {facts}"))
