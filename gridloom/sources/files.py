"""Sources and sinks of binary rasters, images, GeoJSON and JSON documents, with manifests that are checked.

Files are read by Spark's own readers (binaryFile, text, json), so any store that Spark reaches will do. A raster file
is decoded where it is read, a file a row; what a task holds is one file. Folders with a committed manifest are written
and read in parts by ``rasters``.
"""

from __future__ import annotations

import json
import struct
import time
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.rasters import BATCH_CELLS, CELLS, ENCODINGS


# Codecs


def png_bytes(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB or RGBA image (rows, columns, channels) as PNG."""
    h, w, c = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * c)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray:
    """(rows, columns, channels) of a plain 8-bit PNG: gray, RGB or RGBA, not interlaced. Anything else fails."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a PNG chunk is damaged")
        head, packed = (struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head), packed + (body if kind == b"IDAT" else b"")
        at += 12 + n
    w, h, depth, colour, _, _, laced = head
    if depth != 8 or laced or colour not in (0, 2, 6):
        raise ValueError(f"a PNG of depth {depth}, colour {colour}, interlace {laced} cannot be read")
    c = {0: 1, 2: 3, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * c)
    out, above = np.zeros((h, w * c), np.uint8), np.zeros(w * c, np.int16)
    for j in range(h):
        kind, line = raw[j, 0], raw[j, 1:].astype(np.int16)
        if kind == 1:  # left: a running sum for each channel
            line = np.cumsum(line.reshape(w, c), axis=0).ravel()
        elif kind == 2:  # above
            line = line + above
        elif kind in (3, 4):
            for x in range(w * c):
                left, up, corner = (line[x - c] & 255 if x >= c else 0), above[x], (above[x - c] if x >= c else 0)
                if kind == 3:
                    line[x] = (line[x] + (left + up) // 2) & 255
                else:
                    p = left + up - corner
                    near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))
                    line[x] = (line[x] + near[2]) & 255
        out[j] = (line & 255).astype(np.uint8)
        above = out[j].astype(np.int16)
    return out.reshape(h, w, c)


def jpeg_pixels(data: bytes) -> np.ndarray:
    """(rows, columns, 3) of a JPEG, where the optional imaging library is installed; it is the only codec not built in."""
    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("reading JPEG needs the optional package Pillow") from e
    import io

    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def metres(r: Column, g: Column, b: Column) -> Column:
    """Heights packed into red, green and blue."""
    return r * 256 + g + b / 256 - 32768


# Scans


def binary(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(name, bytes, content) of the files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), "content")


def image_pixels(files: DataFrame, size: tuple[int, int] | Callable[[str], tuple[int, int]] | None = None, decode=png_pixels) -> DataFrame:
    """(name, i, j, r, g, b, a) of image files (name, content); an image of another size (width, height) fails. Gray is r = g = b.

    ``size`` may be a function of the name.
    """
    size_of = size if callable(size) else lambda name: size

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                p = decode(bytes(content))
                h, w, c = p.shape
                size = size_of(name)
                if size and (w, h) != size:
                    raise ValueError(f"{name}: {w} x {h} pixels, not {size[0]} x {size[1]}")
                p = np.repeat(p, 3, axis=2) if c == 1 else p
                p = p if p.shape[2] == 4 else np.concatenate([p, np.full((h, w, 1), 255, np.uint8)], axis=2)
                j, i = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({"name": name, "i": i, "j": j} | {k: p[:, :, n].ravel().astype(np.int64) for n, k in enumerate("rgba")})

    return files.select("name", "content").mapInPandas(run, "name string, i long, j long, r long, g long, b long, a long")


def heights(files: DataFrame, size: tuple[int, int] | Callable[[str], tuple[int, int]] | None = None) -> DataFrame:
    """(name, i, j, h): metres of elevation images."""
    return image_pixels(files, size).select("name", "i", "j", metres(F.col("r"), F.col("g"), F.col("b")).alias("h"))


def raster_cells(files: DataFrame) -> DataFrame:
    """(name, i, j, v) of raster files (name, content, encoding, width, height): a size that does not fit its grid fails."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                kind, data = np.dtype(ENCODINGS[r.encoding]), bytes(r.content)
                if len(data) % kind.itemsize or len(data) // kind.itemsize != r.width * r.height:
                    raise ValueError(f"{r.name}: {len(data)} bytes are not {r.width} x {r.height} cells of {kind.itemsize}")
                j, i = np.divmod(np.arange(r.width * r.height), r.width)
                yield pd.DataFrame({"name": r.name, "i": i, "j": j, "v": np.frombuffer(data, kind).astype(float)})

    return files.select("name", "content", "encoding", "width", "height").mapInPandas(run, CELLS)


MANIFEST = "name string, bytes long, sha256 string, encoding string, width long, height long"


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files with their manifest's columns; a missing file, another size or another hash fails before anything is decoded."""
    said = manifest.select("name", F.col("bytes").alias("said_bytes"), "sha256", *[c for c in manifest.columns if c not in ("name", "bytes", "sha256")])
    both = said.join(files, "name", "left")
    problem = F.when(F.col("content").isNull(), "is missing").when(F.col("bytes") != F.col("said_bytes"), "has another size").when(F.sha2("content", 256) != F.col("sha256"), "has another hash")
    checked = F.when(problem.isNull(), F.col("content")).otherwise(F.raise_error(F.concat("name", F.lit(" "), problem)).cast("binary"))
    return both.withColumn("content", checked).drop("said_bytes", "sha256")


def dataset(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(name, i, j, v) of all rasters that a manifest lists in its folder, verified first."""
    return raster_cells(verified(binary(spark, folder), manifest))


def merged_manifests(manifests: list[DataFrame], key: str = "name") -> DataFrame:
    """Several manifests as one; a key that two declare fails."""
    every = manifests[0]
    for m in manifests[1:]:
        every = every.unionByName(m)
    seen = every.groupBy(key).agg(F.count(F.lit(1)).alias("_times"))
    twice = F.when(F.col("_times") > 1, F.raise_error(F.concat(F.col(key).cast("string"), F.lit(" is declared twice"))).cast("boolean")).otherwise(F.lit(True))
    return every.join(seen.where(twice).select(key), key)


def mosaic(tiles: DataFrame, zoom: int, x: tuple[int, int], y: tuple[int, int], tile: int = 256) -> DataFrame:
    """(i, j, r, g, b, a) of the tiles (name z/x/y as z-x-y.png, content) of a range pasted together; a missing tile fails."""
    spark = tiles.sparkSession
    xs = spark.range(x[0], x[1] + 1).select(F.col("id").alias("tx"), F.explode(F.sequence(F.lit(y[0]), F.lit(y[1]))).alias("ty"))
    wanted = xs.select("tx", "ty", F.concat(F.lit(f"{zoom}-"), F.col("tx").cast("string"), F.lit("-"), F.col("ty").cast("string"), F.lit(".png")).alias("name"))
    there = F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("no tile "), "name")).cast("binary")).otherwise(F.col("content"))
    held = wanted.join(tiles.select("name", "content"), "name", "left").withColumn("content", there)
    px = image_pixels(held, (tile, tile)).join(wanted, "name")
    return px.select(((F.col("tx") - x[0]) * tile + F.col("i")).alias("i"), ((F.col("ty") - y[0]) * tile + F.col("j")).alias("j"), "r", "g", "b", "a")


def feature_collection(documents: DataFrame, name: str = "name") -> DataFrame:
    """(fid, name, geometry, properties as JSON) of FeatureCollections (content as text); another type fails."""
    is_one = F.get_json_object("content", "$.type") == "FeatureCollection"
    listed = F.from_json(F.get_json_object("content", "$.features"), "array<string>")
    features = F.when(is_one & listed.isNotNull(), listed).otherwise(F.raise_error(F.lit("not a FeatureCollection")).cast("array<string>"))
    f = documents.select(F.posexplode(features).alias("fid", "f"))
    return f.select(F.col("fid").cast("long").alias("fid"), F.get_json_object("f", f"$.properties.{name}").alias("name"), F.get_json_object("f", "$.geometry").alias("geometry"), F.get_json_object("f", "$.properties").alias("properties"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(content): JSON or GeoJSON files, each a row."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "content")


def records(docs: DataFrame, field: str, schema: str, version: int | None = None) -> DataFrame:
    """Records of a list in documents (content), with a fixed schema: unknown keys, values of other types and another
    schemaVersion fail."""
    said = F.get_json_object("content", "$.schemaVersion").cast("int")
    listed = F.from_json(F.get_json_object("content", f"$.{field}"), "array<string>")
    ok = F.lit(True) if version is None else F.coalesce(said == version, F.lit(False))
    items = F.when(ok & listed.isNotNull(), listed).otherwise(F.raise_error(F.lit(f"no list {field} of version {version}")).cast("array<string>"))
    r = docs.select(F.explode(items).alias("r"))
    known = [c.strip().split(" ")[0] for c in schema.split(",")]
    unknown = F.array_except(F.json_object_keys("r"), F.array(*[F.lit(k) for k in known]))
    parsed = F.from_json("r", schema, {"mode": "FAILFAST"})
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown key "), F.array_join(unknown, ", "))).cast(_struct(schema))).otherwise(parsed)
    return r.select(checked.alias("x")).select("x.*")


def _struct(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def with_retries(fetch, attempts: int = 4, wait: float = 5.0, sleep=time.sleep):
    """``fetch()``, tried again after ``wait`` seconds times the number of failures; the last one is raised."""
    for n in range(1, attempts + 1):
        try:
            return fetch()
        except OSError:
            if n == attempts:
                raise
            sleep(wait * n)


def batches_of(items: list, size: int = 20) -> list[list]:
    """Items in the order given, in requests of ``size``."""
    return [items[k : k + size] for k in range(0, len(items), size)]


# Sinks


def encoded(cells: DataFrame, encoding: str, width: int, height: int | Callable[[str], int]) -> DataFrame:
    """(name, content, encoding, width, height) of rasters (name, i, j, v), a file each; a missing cell fails.

    Integers are rounded half up and kept in their range. ``height`` may be a function of the name.
    """
    kind = np.dtype(ENCODINGS[encoding])
    rows_of = height if callable(height) else lambda name: height

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        height = rows_of(key[0])
        if len(pdf) != width * height:
            raise ValueError(f"{key[0]}: {len(pdf)} cells, not {width} x {height}")
        v = pdf.sort_values(["j", "i"])["v"].to_numpy(float)
        if kind.kind != "f":
            v = np.clip(np.floor(v + 0.5), np.iinfo(kind).min, np.iinfo(kind).max)
        return pd.DataFrame({"name": [key[0]], "content": [v.astype(kind).tobytes()], "encoding": [encoding], "width": [width], "height": [height]})

    return cells.select("name", "i", "j", "v").groupBy("name").applyInPandas(run, "name string, content binary, encoding string, width long, height long")


def encoded_parts(cells: DataFrame, encoding: str, width: int, height: int, part_cells: int = BATCH_CELLS) -> DataFrame:
    """(name, part, content, encoding, width, height): as ``encoded``, but a file's rows of cells come in parts of some ``part_cells``."""
    rows = max(1, part_cells // max(width, 1))
    part = F.floor(F.col("j") / rows)
    parts = cells.select(F.to_json(F.struct("name", part.alias("part"))).alias("name"), "i", "j", "v")
    made = encoded(parts, encoding, width, lambda key: min(rows, height - rows * json.loads(key)["part"]))
    key = F.from_json("name", "name string, part long")
    return made.select(key["name"].alias("name"), key["part"].alias("part"), "content", "encoding", "width", F.lit(height).cast("long").alias("height"))


def images(pixels: DataFrame) -> DataFrame:
    """(name, content): PNG files of (name, i, j, r, g, b)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["j", "i"])
        h, w = int(p["j"].max()) + 1, int(p["i"].max()) + 1
        return pd.DataFrame({"name": [key[0]], "content": [png_bytes(p[["r", "g", "b"]].to_numpy(np.uint8).reshape(h, w, 3))]})

    return pixels.groupBy("name").applyInPandas(run, "name string, content binary")


def assembled(items: DataFrame, field: str, head: dict) -> DataFrame:
    """(name, content): a JSON document for each name of ``items`` (name, n, item as JSON): ``head``, and the items by n under ``field``."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"name": pdf["name"], "content": [document_text(head | {field: [json.loads(x["item"]) for x in listed]}).encode() for listed in pdf["listed"]]})

    grouped = items.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("listed"))
    return grouped.mapInPandas(run, "name string, content binary")


def document_text(value) -> str:
    """A JSON document as it is stored: two spaces, keys in their order, a line end; it must parse back to itself."""
    out = json.dumps(value, indent=2, ensure_ascii=False) + "\n"
    if json.loads(out) != value:
        raise ValueError("the document does not survive being written")
    return out


def published(files: DataFrame, debug: str = r"^debug-|\.debug\.") -> DataFrame:
    """The files of a release: all but those for debugging."""
    return files.where(~F.col("name").rlike(debug))
