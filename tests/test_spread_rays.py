"""Rays over one hot leaf are marched by several tasks, and none is followed beyond what is asked."""

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from gridloom.catalog_view import spec
from gridloom.operators import view


def scene(spark):
    cells = spark.range(64 * 64).select((F.col("id") % 64).alias("i"), F.floor(F.col("id") / 64).alias("j"), F.lit(1000).cast("long").alias("h"))
    # All of them meet the only leaf of a plain at a kilometre, straight below.
    rays = spark.range(20_000).select(F.col("id").alias("ray"), F.lit(0.0).alias("ox"), F.lit(3.0).alias("oy"), F.lit(0.0).alias("oz"), F.lit(0.6).alias("dx"), F.lit(-0.8).alias("dy"), F.lit(0.0).alias("dz"))
    return cells, rays, spec(64)


def test_hot_leaf(spark, monkeypatch):
    cells, rays, s = scene(spark)

    def marked(*_):
        def run(batches):
            for b in batches:
                for r in range(b.num_rows):
                    ray = b.column(0)[r].values.field("ray")
                    n = len(ray)
                    yield pa.RecordBatch.from_arrays([ray, pa.array([0] * n, pa.int32()), *[pa.array([float(TaskContext.get().partitionId())] * n)] * 6], names=["ray", "s", "t", "x", "y", "z", "i", "j"])

        return run

    monkeypatch.setattr(view, "_marched", marked)
    tasks = view.first_hits(rays, cells, s, 1.0).groupBy("t").count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 20_000


def test_until(spark):
    cells, rays, s = scene(spark)
    rays = rays.where("ray < 10").withColumn("until", F.when(F.col("ray") < 5, F.lit(2.6)).otherwise(F.lit(1.0)))
    hits = {r.ray: r.t for r in view.first_hits(rays, cells, s, 1.0).collect()}
    assert set(hits) == set(range(5)) and all(abs(t - 2.5) < 2e-3 for t in hits.values())
