"""Many copies of few places: lookups follow places, not pairs of copies."""

import time

import pytest
from pyspark.sql import functions as F

from gridloom.operators import joins, screen

N = 100_000


@pytest.fixture
def quick():
    """Pairs of N copies would take minutes."""
    start = time.monotonic()
    yield
    assert time.monotonic() - start < 60


def test_nearest_named_of_copies(spark, quick):
    p = spark.range(N).select("id", F.lit(-65.0).alias("lon"), F.when(F.col("id") < 5, F.lit(None)).otherwise(F.lit(-23.0)).alias("lat"))
    s = spark.range(1, N).select(F.col("id").alias("site"), F.concat(F.lit("Laguna "), "id").alias("name"), F.lit(-65.1).alias("lon"), F.lit(-23.0).alias("lat"))
    found = joins.nearest_named(p, s, "Laguna", 25.0, "none").groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in found} == {"Laguna 1": N - 5, "none": 5}


def test_nearest_marker_of_copies(spark, quick):
    taps = spark.range(N).select("id", F.lit(3.0).alias("tx"), F.when(F.col("id") < 5, F.lit(900.0)).otherwise(F.lit(4.0)).alias("ty"))
    markers = spark.range(N).select(F.col("id").alias("m"), F.lit(5.0).alias("x"), F.lit(4.0).alias("y"))
    found = screen.nearest_marker(taps, markers, 22.0)
    assert {r["m"]: r["count"] for r in found.groupBy("m").count().collect()} == {N - 1: N - 5}


def test_components_of_copies(spark, quick):
    # Two chains of places, a hundred apart, and points without a place.
    p = spark.range(N).select("id", (F.col("id") % 4 * 50 + F.when(F.col("id") % 4 > 1, 100).otherwise(0)).cast("double").alias("x"), F.when(F.col("id") < 3, F.lit(float("nan"))).otherwise(F.lit(0.0)).alias("y"))
    found = {r["label"]: r["count"] for r in joins.proximity_labels(p, 60.0).groupBy("label").count().collect()}
    assert found == {0: 1, 1: 1, 2: 1, 3: N // 2 - 1, 4: N // 2 - 2}
