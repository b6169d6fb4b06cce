"""The data source of files with a manifest: what is committed, what is refused, what is read."""

import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.sources import files, rasters


def grid(spark, names, width=7, height=11):
    rows = [(n, i, j, float(k * 1000 + j * width + i)) for k, n in enumerate(names) for i in range(width) for j in range(height)]
    return spark.createDataFrame(rows, "name string, i long, j long, v double").repartition(4), {r[:3]: r[3] for r in rows}


def there(df):
    return {(r.name, r.i, r.j): r.v for r in df.collect()}


def test_round_trip_in_parts(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "f")
    cells, want = grid(spark, ["a", "b", "c", "d", "e"])
    made = files.encoded(cells, "int16-le", 7, 11)
    manifest = rasters.written(made, at)
    assert sorted(os.listdir(at)) == ["_manifest", "a", "b", "c", "d", "e"]
    assert {r.name: (r.bytes, r.encoding, r.width, r.height) for r in manifest.collect()} == {n: (154, "int16-le", 7, 11) for n in "abcde"}
    content = {r.name: r.sha for r in files.binary(spark, at).select("name", F.sha2("content", 256).alias("sha")).collect()}
    assert {r.name: r.sha256 for r in manifest.collect()} == content
    assert there(rasters.cells(spark, at)) == want
    # More files, in another commit, by an URI.
    more, extra = grid(spark, ["f"])
    rasters.written(files.encoded(more, "float32-le", 7, 11), f"file://{at}")
    assert there(rasters.cells(spark, at)) == want | extra


def test_names_and_rows_are_chosen_before_anything_is_read(spark, tmp_path):
    at = str(tmp_path / "f")
    cells, want = grid(spark, ["a", "b", "c"])
    rasters.written(files.encoded(cells, "int16-le", 7, 11), at)
    assert sorted((p.name, p.low, p.high) for p in rasters.Reader(at, ["a", "c"], (3, 6)).partitions()) == [("a", 3, 6), ("c", 3, 6)]
    df = rasters.cells(spark, at, ["a", "c"], "3:6")
    assert there(df) == {k: v for k, v in want.items() if k[0] in "ac" and 2 < k[2] <= 5}
    # The same DataFrame under one filter, another and none.
    every = rasters.cells(spark, at)
    assert there(every.where("j = 4")) == {k: v for k, v in want.items() if k[2] == 4} and there(every.where("name = 'b' and i < 2")) == {k: v for k, v in want.items() if k[0] == "b" and k[1] < 2}
    assert there(every) == want and there(rasters.cells(spark, at, ["x"])) == {} == there(rasters.cells(spark, at, rows="11:"))
    assert there(rasters.cells(spark, at, rows="-3:1")) == {k: v for k, v in want.items() if k[2] == 0}


def test_a_large_file_is_read_by_many_tasks_in_checked_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rasters, "BLOCK", 64)
    monkeypatch.setattr(rasters, "PART_BYTES", 200)
    monkeypatch.setattr(rasters, "BATCH_CELLS", 30)
    at, v = str(tmp_path / "f"), np.arange(13 * 40).reshape(40, 13) % 200
    writer = rasters.Writer(at, ["name", "content", "encoding", "width", "height"])
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([v.astype("<i2").tobytes()], pa.binary()), pa.array(["int16-le"]), pa.array([13]), pa.array([40])], names=writer.columns)
    writer.commit([writer.write(iter([batch]))])
    reader = rasters.Reader(at)
    parts = reader.partitions()
    assert len(parts) == 6
    got = pa.Table.from_batches([b for p in parts for b in reader.read(p)]).to_pydict()
    assert [(j, i, x) for j, i, x in zip(got["j"], got["i"], got["v"])] == [(j, i, v[j, i]) for j in range(40) for i in range(13)]
    with open(f"{at}/a", "r+b") as f:
        f.seek(500)
        f.write(b"\xff")
    assert sum(b.num_rows for b in reader.read(parts[0])) == 7 * 13
    with pytest.raises(ValueError, match="damaged in block 7"):
        list(reader.read(parts[2]))


def test_an_aborted_write_leaves_nothing_in_the_manifest(spark, tmp_path):
    at = str(tmp_path / "f")
    cells, want = grid(spark, ["a", "b"])
    rasters.written(files.encoded(cells, "int16-le", 7, 11), at)
    rows = [(n, bytearray(b"12345678"), "uint8", 4, 2) for n in ("c", "d", "e", "f", "g")] + [("bad/name", bytearray(b"1"), "uint8", 1, 1)]
    df = spark.createDataFrame(rows, "name string, content binary, encoding string, width long, height long").repartition(6)
    with pytest.raises(Exception, match="cannot be a file's name"):
        rasters.written(df, at)
    assert there(rasters.cells(spark, at)) == want
    listed = {r["name"] for p in rasters.committed(at) for r in map(json.loads, open(f"{at}/_manifest/{p}"))}
    assert listed == {"a", "b"}


def test_a_task_that_is_lost_counts_for_nothing(tmp_path):
    """Files of an attempt without a commit message stay out of the manifest, and its next attempt takes their names."""
    at, columns = str(tmp_path / "f"), ["name", "content", "encoding", "width", "height"]
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([b"1234"], pa.binary()), pa.array(["uint8"]), pa.array([2]), pa.array([2])], names=columns)
    rasters.Writer(at, columns).write(iter([batch]))
    assert rasters.committed(at) == []
    writer = rasters.Writer(at, columns)
    writer.commit([writer.write(iter([batch])), None, writer.write(iter([]))])
    other = rasters.Writer(at, columns)
    named = pa.RecordBatch.from_arrays([pa.array(["b"]), *batch.columns[1:]], names=columns)
    other.abort([other.write(iter([named])), None])
    assert sorted(x for x in os.listdir(at) if x != "_manifest") == ["a"]
    assert len(rasters.committed(at)) == 1 and [p.name for p in rasters.Reader(at).partitions()] == ["a"]


def test_what_is_not_as_declared_fails(spark, tmp_path):
    at = str(tmp_path / "f")
    row = spark.createDataFrame([("a", bytearray(b"123456"), "uint8", 2, 2)], "name string, content binary, encoding string, width long, height long")
    rasters.written(row, at)
    with pytest.raises(Exception, match="6 bytes are not 2 x 2"):
        rasters.cells(spark, at).collect()
    b = str(tmp_path / "g")
    good = row.withColumn("height", F.lit(3).cast("long"))
    rasters.written(good, b)
    rasters.written(good, b)
    with pytest.raises(Exception, match="a is declared twice"):
        rasters.cells(spark, b).collect()
    c = str(tmp_path / "h")
    rasters.written(good, c)
    with open(f"{c}/a", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="another size"):
        rasters.cells(spark, c).collect()
    with pytest.raises(Exception, match="mode append"):
        good.write.format("gridloom").mode("overwrite").save(c)
    with pytest.raises(Exception, match="name and content"):
        good.drop("content").write.format("gridloom").mode("append").save(c)
    assert rasters.written(good.limit(0), str(tmp_path / "i")).count() == 0
    assert rasters.cells(spark, str(tmp_path / "i")).count() == 0


def test_documents_are_assembled_by_tasks(spark):
    rows = [("x.json", 2, '{"b": 1, "a": "é"}'), ("x.json", 1, '{"b": 0}'), ("y.json", 1, "[]")]
    got = {r.name: bytes(r.content).decode() for r in files.assembled(spark.createDataFrame(rows, "name string, n long, item string"), "list", {"schemaVersion": 3}).collect()}
    assert json.loads(got["x.json"]) == {"schemaVersion": 3, "list": [{"b": 0}, {"b": 1, "a": "é"}]} and got["x.json"].endswith("}\n")
    assert json.loads(got["y.json"])["list"] == [[]]
