"""A data source for folders of files with a manifest: tasks write and read, the driver commits.

Writing. ``df.write.format("gridloom").mode("append").save(folder)`` takes rows (name, content, further columns). A task
writes each file below ``_attempts`` in a folder of its own and, when its rows are through, moves the files to their names
and writes its part of the manifest there. Its commit message is that part's name. The driver's commit lists the
parts that count; whatever an attempt that failed left behind is in no part that is listed. An abort removes the files and
parts of the tasks that had ended by then. No content passes the driver, whose share grows with tasks, not with files.

Reading. ``spark.read.format("gridloom").load(folder)`` gives the cells (name, i, j, v) of the rasters in the manifest.
A file is cut into ranges of rows of about PART_BYTES, a task each. The options ``names`` and ``rows`` choose files and
rows: others are neither opened nor planned. (They are options and no pushed filters, since Spark keeps what one query
pushed for the next one that uses the same DataFrame.) Content is kept in blocks with a checksum each, so a range is
checked without reading the rest of its file.

Paths are those of pyarrow's file systems (local, hdfs, s3, gs, abfs); another scheme fails.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Encodings of raster files: how numpy reads their cells.
ENCODINGS = {"int16-le": "<i2", "uint16-le": "<u2", "uint8": "u1", "int8": "i1", "float32-le": "<f4"}
CELLS = "name string, i long, j long, v double"
MANIFEST = "name string, bytes long, sha256 string, blocks array<long>, encoding string, width long, height long"
#: Bytes of content that share a checksum; bytes that one task reads; cells of a batch.
BLOCK, PART_BYTES, BATCH_CELLS = 1 << 20, 16 << 20, 1 << 18
ATTEMPTS, PARTS, COMMITTED = "_attempts", "_manifest", "_committed"


def _system(folder: str):
    """(file system, path) of a folder."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(folder)
    return fs.FileSystem.from_uri("file://" + folder[len("file:") :] if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def _put(system, path: str, data: bytes) -> None:
    with system.open_output_stream(path) as out:
        out.write(data)


def _lines(system, path: str) -> list[dict]:
    with system.open_input_stream(path) as f:
        return [json.loads(x) for x in f.read().splitlines()]


def _named(name) -> str:
    if not name or name.startswith(("_", ".")) or "/" in name:
        raise ValueError(f"{name!r} cannot be a file's name")
    return name


@dataclass
class Written(WriterCommitMessage):
    part: str | None
    attempt: str


class Growing:
    """A file that is written part by part, and what its manifest says of it."""

    def __init__(self, system, path: str, row: dict):
        self.out, self.row, self.sha, self.size, self.blocks = system.open_output_stream(path), row, hashlib.sha256(), 0, []

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        left = memoryview(data)
        while len(left):
            at = self.size % BLOCK
            piece, left = left[: BLOCK - at], left[BLOCK - at :]
            self.blocks[len(self.blocks) - bool(at) :] = [zlib.crc32(piece, self.blocks[-1] if at else 0)]
            self.size += len(piece)

    def closed(self) -> dict:
        self.out.close()
        return self.row | {"bytes": self.size, "sha256": self.sha.hexdigest(), "blocks": self.blocks}


def _fits(r: dict) -> None:
    """A raster's bytes are those of its cells."""
    size = np.dtype(ENCODINGS[r["encoding"]]).itemsize
    if r["bytes"] != size * r["width"] * r["height"]:
        raise ValueError(f"{r['name']}: {r['bytes']} bytes are not {r['width']} x {r['height']} cells of {size}")


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, columns: list[str]):
        self.folder, self.columns = folder, columns

    def write(self, iterator) -> Written:
        system, base = _system(self.folder)
        attempt = uuid.uuid4().hex
        at, said = f"{base}/{ATTEMPTS}/{attempt}", []
        system.create_dir(at, recursive=True)
        now, parts = None, 0
        for batch in iterator:
            for k in range(batch.num_rows):  # one file, or one part of a file, at a time
                row = {c: batch.column(n)[k].as_py() for n, c in enumerate(self.columns)}
                data, part = row.pop("content"), row.pop("part", 0)
                parts = parts + 1 if part and now and now.row["name"] == row["name"] else 0
                if part != parts:
                    raise ValueError(f"{row['name']}: part {part} where part {parts} was due")
                if not part:
                    said += [now.closed()] if now else []
                    now = Growing(system, f"{at}/{_named(row['name'])}", row)
                now.add(data)
        said += [now.closed()] if now else []
        if "part" in self.columns and "encoding" in self.columns:
            for r in said:
                _fits(r)
        if not said:
            system.delete_dir(at)
            return Written(None, attempt)
        system.create_dir(f"{base}/{PARTS}", recursive=True)
        for row in said:
            system.move(f"{at}/{row['name']}", f"{base}/{row['name']}")
        _put(system, f"{base}/{PARTS}/{attempt}.json", "".join(json.dumps(r) + "\n" for r in said).encode())
        system.delete_dir(at)
        return Written(f"{attempt}.json", attempt)

    def commit(self, messages) -> None:
        system, base = _system(self.folder)
        system.create_dir(f"{base}/{PARTS}", recursive=True)
        before = committed(self.folder)
        # The list is replaced in one step: a reader sees the old one or the new one.
        new = f"{base}/{PARTS}/{uuid.uuid4().hex}.list"
        _put(system, new, "\n".join(before + [m.part for m in messages if m is not None and m.part]).encode())
        system.move(new, f"{base}/{PARTS}/{COMMITTED}")
        self._tidy(system, base)

    def abort(self, messages) -> None:
        system, base = _system(self.folder)
        held = {r["name"] for p in committed(self.folder) for r in _lines(system, f"{base}/{PARTS}/{p}")}
        for m in messages:
            if m is not None and m.part:
                for r in _lines(system, f"{base}/{PARTS}/{m.part}"):
                    if r["name"] not in held:
                        system.delete_file(f"{base}/{r['name']}")
                system.delete_file(f"{base}/{PARTS}/{m.part}")
        self._tidy(system, base)

    @staticmethod
    def _tidy(system, base: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{base}/{ATTEMPTS}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{ATTEMPTS}")


def problem(folder: str, name: str, size: int, sha256: str) -> str | None:
    """What is wrong with a file, by its size and hash; it is read a block at a time."""
    from pyarrow import fs

    system, base = _system(folder)
    info = system.get_file_info(f"{base}/{name}")
    if info.type != fs.FileType.File:
        return "is missing"
    if info.size != size:
        return "has another size"
    sha = hashlib.sha256()
    with system.open_input_stream(f"{base}/{name}") as f:
        while data := f.read(BLOCK):
            sha.update(data)
    return None if sha.hexdigest() == sha256 else "has another hash"


def committed(folder: str) -> list[str]:
    """The names of the manifest's parts that count, one for each task that wrote."""
    from pyarrow import fs

    system, base = _system(folder)
    at = f"{base}/{PARTS}/{COMMITTED}"
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return []
    with system.open_input_stream(at) as f:
        return f.read().decode().split()


@dataclass
class Rows(InputPartition):
    """Some rows of one raster, and what its manifest says of it."""

    name: str
    bytes: int
    blocks: list
    encoding: str
    width: int
    height: int
    low: int
    high: int


def _range(option: str | None) -> tuple[int, int]:
    """``low:high`` as numbers, either of which may be left out; the high one is not included."""
    low, high = (option or ":").split(":")
    return int(low or 0), int(high or 1 << 62)


class Reader(DataSourceReader):
    def __init__(self, folder: str, names: list[str] | None = None, rows: tuple[int, int] = (0, 1 << 62)):
        self.folder, self.names = folder, None if names is None else set(names)
        self.low, self.high = rows

    def partitions(self):
        system, base = _system(self.folder)
        out, names = [], set()
        for part in committed(self.folder):
            for r in _lines(system, f"{base}/{PARTS}/{part}"):
                if r["name"] in names:
                    raise ValueError(f"{r['name']} is declared twice")
                names.add(r["name"])
                if self.names is not None and r["name"] not in self.names:
                    continue
                size = np.dtype(ENCODINGS[r["encoding"]]).itemsize * r["width"]
                if r["bytes"] != size * r["height"]:
                    raise ValueError(f"{r['name']}: {r['bytes']} bytes are not {r['width']} x {r['height']} cells of {size // max(r['width'], 1)}")
                low, high, rows = max(self.low, 0), min(self.high, r["height"]), max(1, PART_BYTES // max(size, 1))
                out += [Rows(r["name"], r["bytes"], r["blocks"], r["encoding"], r["width"], r["height"], k, min(k + rows, high)) for k in range(low, high, rows)]
        return out or [Rows("", 0, [], "uint8", 0, 0, 0, 0)]

    def read(self, p: Rows):
        if not p.width:
            return
        kind = np.dtype(ENCODINGS[p.encoding])
        line = kind.itemsize * p.width
        system, base = _system(self.folder)
        with system.open_input_file(f"{base}/{p.name}") as f:
            if f.size() != p.bytes:
                raise ValueError(f"{p.name} has another size")
            step = max(1, BATCH_CELLS // p.width)
            for low in range(p.low, p.high, step):
                high = min(low + step, p.high)
                data = self._checked(f, p, low * line, high * line)
                j, i = np.divmod(np.arange(low * p.width, high * p.width), p.width)
                v = np.frombuffer(data, kind).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([p.name] * len(v), pa.string()), pa.array(i), pa.array(j), pa.array(v)], names=["name", "i", "j", "v"])

    @staticmethod
    def _checked(f, p: Rows, low: int, high: int) -> bytes:
        """Bytes low to high, read as whole blocks that have the checksums of the manifest."""
        first, last = low // BLOCK, -(-high // BLOCK)
        data = f.read_at(min(last * BLOCK, p.bytes) - first * BLOCK, first * BLOCK)
        for k in range(first, last):
            if zlib.crc32(data[(k - first) * BLOCK : (k - first + 1) * BLOCK]) != p.blocks[k]:
                raise ValueError(f"{p.name} is damaged in block {k}")
        return data[low - first * BLOCK : high - first * BLOCK]


class Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> Reader:
        names = self.options.get("names")
        return Reader(self.options["path"], None if names is None else json.loads(names), _range(self.options.get("rows")))

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("files are added to a folder, never written over: use mode append")
        names = [f.name for f in schema.fields]
        if not {"name", "content"} <= set(names):
            raise ValueError("files need the columns name and content")
        return Writer(self.options["path"], names)


@dataclass
class Lines(InputPartition):
    """Rows of a raster."""

    low: int
    high: int


class LayerReader(DataSourceReader):
    """Layers of one raster, each a file with an encoding of its own, read side by side in ranges of rows."""

    def __init__(self, folder: str, layers: list[dict], width: int, height: int, rows: tuple[int, int] = (0, 1 << 62)):
        self.folder, self.layers, self.width, self.height = folder, layers, width, height
        self.low, self.high = max(rows[0], 0), min(rows[1], height)

    def partitions(self):
        line = self.width * sum(np.dtype(ENCODINGS[x["encoding"]]).itemsize for x in self.layers)
        step = max(1, PART_BYTES // max(line, 1))
        return [Lines(k, min(k + step, self.high)) for k in range(self.low, self.high, step)] or [Lines(0, 0)]

    def read(self, p: Lines):
        system, base = _system(self.folder)
        step = max(1, BATCH_CELLS // max(self.width, 1))
        for low in range(p.low, p.high, step):
            high = min(low + step, p.high)
            j, i = np.divmod(np.arange(low * self.width, high * self.width), self.width)
            columns = {"i": i, "j": j}
            for x in self.layers:
                kind = np.dtype(ENCODINGS[x["encoding"]])
                with system.open_input_file(f"{base}/{x['file']}") as f:
                    if f.size() != x["bytes"]:
                        raise ValueError(f"{x['file']} is {f.size()} bytes, its manifest says {x['bytes']}")
                    data = f.read_at((high - low) * self.width * kind.itemsize, low * self.width * kind.itemsize)
                v = np.frombuffer(data, kind)
                columns[x["name"]] = v.astype(float) if kind.kind == "f" else v.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


class LayerSource(DataSource):
    """Options: path, width, height, and layers, a JSON list of name, file, encoding and bytes."""

    @classmethod
    def name(cls) -> str:
        return "gridloom-layers"

    def _layers(self) -> list[dict]:
        return json.loads(self.options["layers"])

    def schema(self) -> str:
        return ", ".join(["i long", "j long", *[f"{x['name']} {'double' if x['encoding'].startswith('float') else 'long'}" for x in self._layers()]])

    def reader(self, schema) -> LayerReader:
        return LayerReader(self.options["path"], self._layers(), int(self.options["width"]), int(self.options["height"]), _range(self.options.get("rows")))


def layers(spark: SparkSession, folder: str, listed: list[dict], width: int, height: int, rows: str = ":") -> DataFrame:
    """(i, j, a column for each layer) of rasters of one grid: files (name, file, encoding, bytes) in a folder.

    A file whose size is not that of its grid, or not the one that its manifest says, fails. Only the layers that are
    listed are opened, and only ``rows`` (low:high) of them read.
    """
    for x in listed:
        size = np.dtype(ENCODINGS[x["encoding"]]).itemsize
        if x["bytes"] != size * width * height:
            raise ValueError(f"{x['file']}: {x['bytes']} bytes are not {width} x {height} cells of {size}")
    return registered(spark).read.format("gridloom-layers").option("width", width).option("height", height).option("rows", rows).option("layers", json.dumps(listed)).load(folder)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Source)
    spark.dataSource.register(LayerSource)
    return spark


def written(files: DataFrame, folder: str) -> DataFrame:
    """Write files (name, content, further columns) to a folder by their tasks, and give its manifest.

    Columns of the manifest: name, further columns, bytes and sha256 of each file. With a column ``part`` (0, 1, 2 and so
    on) a file's rows are its parts: one task writes them one after the other, and holds no whole file.
    """
    registered(files.sparkSession)
    if "part" in files.columns:
        files = files.repartition("name").sortWithinPartitions("name", "part")
    files.write.format("gridloom").mode("append").save(folder)
    return manifest(files.sparkSession, folder, files.drop("content", "part").schema)


def manifest(spark: SparkSession, folder: str, columns=None) -> DataFrame:
    """The committed manifest of a folder; ``columns`` is a schema of further columns."""
    from pyspark.sql.types import StructType

    fixed = StructType.fromDDL("bytes long, sha256 string, blocks array<long>")
    schema = StructType((columns or StructType.fromDDL("name string")).fields + fixed.fields)
    parts = committed(folder)
    if not parts:
        return spark.createDataFrame([], schema).drop("blocks")
    return spark.read.schema(schema).json([f"{folder.rstrip('/')}/{PARTS}/{p}" for p in parts]).drop("blocks")


def cells(spark: SparkSession, folder: str, names: list[str] | None = None, rows: str = ":") -> DataFrame:
    """(name, i, j, v) of the rasters of a folder's committed manifest: all, or the named ones, and ``rows`` (low:high) of each."""
    reader = registered(spark).read.format("gridloom").option("rows", rows)
    return (reader if names is None else reader.option("names", json.dumps(names))).load(folder)
