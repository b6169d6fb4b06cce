"""Tables derived from the driver's parquet files by expressions that any SQL engine shares.

Each function gives a lazy DataFrame; ``SQL`` holds the same definitions as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster cells (i, j, h): column i is the element of a vector, row j the vector's number."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.posexplode("embedding").alias("i", "x"), F.col("vec_id").alias("j")).select(
        F.col("i").cast("long").alias("i"), "j", F.floor((F.col("x").cast("double") + 1) * 1000).cast("long").alias("h")
    )


def height(cells: DataFrame) -> int:
    """Rows of a raster, 0 for an empty one."""
    return cells.agg(F.coalesce(F.max("j") + 1, F.lit(0))).first()[0]


def tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid on a slope, so that water runs far."""
    return grid(spark, sf_dir).select("i", "j", (F.col("h") + 40 * F.col("j")).alias("h"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles (cls, grp, name, x0, y0, x1, y1) of a 5 x 5 block, some of which overlap their neighbours."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("long")
    col, row = F.pmod(k, F.lit(5)), F.floor(k / 5)
    return n.select((k + 1).alias("cls"), F.col("n_regionkey").cast("long").alias("grp"), F.col("n_name").alias("name"), (col * 12 + 0.5).cast("double").alias("x0"), (row * 90 + 3.5).cast("double").alias("y0"), (col * 12 + 13.25).cast("double").alias("x1"), (row * 90 + 95.0).cast("double").alias("y1"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lon, lat); some lie outside the raster's extent."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (F.lit(-67.2) + F.pmod(k, F.lit(360)) * 0.01).alias("lon"), (F.lit(-24.8) + F.pmod(k * 7, F.lit(320)) * 0.01).alias("lat"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, name, lon, lat) of the suppliers; every fourth is a lagoon by name."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("site"), F.when(k % 4 == 0, F.concat(F.lit("Laguna "), k.cast("string"))).otherwise(F.col("s_name")).alias("name"), (F.lit(-67.2) + F.pmod(k * 37, F.lit(360)) * 0.01).alias("lon"), (F.lit(-24.8) + F.pmod(k * 53, F.lit(320)) * 0.01).alias("lat"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transects (tid, k, distance, elevation): a user's events in order; one in nine has no elevation."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.row_number().over(w) - 1
    return e.select(F.col("user_id").alias("tid"), k.cast("long").alias("k"), F.col("event_id"), F.col("value")).select(
        "tid", "k", (F.col("k") * 100).cast("double").alias("distance"), F.when(F.pmod(F.col("event_id"), F.lit(9)) != 0, F.floor("value")).cast("double").alias("elevation")
    )


SQL = {
    "grid": "grid AS (SELECT CAST(i AS BIGINT) AS i, j, CAST(floor((CAST(x AS DOUBLE) + 1) * 1000) AS BIGINT) AS h FROM (SELECT unnest(range(len(embedding))) AS i, vec_id AS j, unnest(embedding) AS x FROM embeddings))",
    "tilted": "tilted AS (SELECT i, j, h + 40 * j AS h FROM grid)",
    "zones": "zones AS (SELECT CAST(n_nationkey AS BIGINT) + 1 AS cls, CAST(n_regionkey AS BIGINT) AS grp, n_name AS name, CAST((n_nationkey % 5) * 12 + 0.5 AS DOUBLE) AS x0, CAST((n_nationkey // 5) * 90 + 3.5 AS DOUBLE) AS y0, CAST((n_nationkey % 5) * 12 + 13.25 AS DOUBLE) AS x1, CAST((n_nationkey // 5) * 90 + 95 AS DOUBLE) AS y1 FROM nation)",
    "points": "points AS (SELECT c_custkey AS id, CAST(-67.2 AS DOUBLE) + (c_custkey % 360) * CAST(0.01 AS DOUBLE) AS lon, CAST(-24.8 AS DOUBLE) + ((c_custkey * 7) % 320) * CAST(0.01 AS DOUBLE) AS lat FROM customer)",
    "sites": "sites AS (SELECT s_suppkey AS site, CASE WHEN s_suppkey % 4 = 0 THEN 'Laguna ' || s_suppkey ELSE s_name END AS name, CAST(-67.2 AS DOUBLE) + ((s_suppkey * 37) % 360) * CAST(0.01 AS DOUBLE) AS lon, CAST(-24.8 AS DOUBLE) + ((s_suppkey * 53) % 320) * CAST(0.01 AS DOUBLE) AS lat FROM supplier)",
    "samples": "samples AS (SELECT tid, k, CAST(k * 100 AS DOUBLE) AS distance, CASE WHEN event_id % 9 <> 0 THEN CAST(floor(value) AS DOUBLE) END AS elevation FROM (SELECT user_id AS tid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, event_id, value FROM events))",
}


def with_tables(names: str, body: str) -> str:
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names.split()) + body
