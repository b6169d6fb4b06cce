"""Raster files in parts: the same files, no task with a whole one."""

import pytest
from pyspark.sql import functions as F

from gridloom.sources import files, rasters

W, H = 7, 23


def test_parts_make_the_same_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rasters, "BLOCK", 50)  # of the driver: blocks are checked below
    cells = spark.range(W * H * 2).select(F.when(F.col("id") < W * H, "a.bin").otherwise("b.bin").alias("name"), (F.col("id") % W).alias("i"), F.floor(F.col("id") % (W * H) / W).alias("j"), (F.col("id") * 31 % 5000).alias("v"))
    parts = files.encoded_parts(cells, "int16-le", W, H, part_cells=3 * W)
    assert {(r.name, r.part, len(r.content)) for r in parts.collect()} == {(n, k, 2 * W * (3 if k < 7 else 2)) for n in ("a.bin", "b.bin") for k in range(8)}
    whole = {r.name: (r.bytes, r.sha256, r.width, r.height) for r in rasters.written(files.encoded(cells, "int16-le", W, H), f"{tmp_path}/whole").collect()}
    made = rasters.written(parts, f"{tmp_path}/parts")
    assert "part" not in made.columns and {r.name: (r.bytes, r.sha256, r.width, r.height) for r in made.collect()} == whole
    assert rasters.cells(spark, f"{tmp_path}/parts").exceptAll(cells.withColumn("v", F.col("v").cast("double"))).isEmpty()
    for k, problem in ((3, "part 4 where part 3 was due"), (7, "bytes are not")):
        with pytest.raises(Exception, match=problem):
            rasters.written(parts.where(F.col("part") != k), f"{tmp_path}/lacks-{k}")
    with pytest.raises(Exception, match="cells, not"):
        files.encoded_parts(cells.where("i + j > 0"), "int16-le", W, H, part_cells=3 * W).collect()


def test_blocks_of_parts(tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(rasters, "BLOCK", 50)
    data, said = bytes(range(256)), []
    for k, step in enumerate((256, 50, 33, 1)):
        f = rasters.Growing(fs.LocalFileSystem(), f"{tmp_path}/{k}", {"name": str(k)})
        for at in range(0, 256, step):
            f.add(data[at : at + step])
        said.append(f.closed() | {"name": ""})
    assert len(said[0]["blocks"]) == 6 and all(x == said[0] for x in said)
    assert rasters.problem(str(tmp_path), "1", 256, said[0]["sha256"]) is None
    assert [rasters.problem(str(tmp_path), *x) for x in (("9", 1, ""), ("1", 1, ""), ("1", 256, ""))] == ["is missing", "has another size", "has another hash"]
