"""Queries over tables whose sizes fit no strip, page or unit, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF


def same(spark, name, folder, tables):
    """A query's rows, after they were found to be those of its SQL."""
    df = entry.queries()[name](spark, folder)
    columns = df.columns
    got = sorted(tuple(r) for r in df.collect())
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert got == want and got
    return got


@pytest.fixture(scope="module")
def short(spark, tmp_path_factory):
    """A grid of 106 rows: two strips and six rows of a third."""
    at = str(tmp_path_factory.mktemp("short"))
    spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 106").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", ["int16_files", "layer_files", "manifest_written", "terrarium_images"])
def test_last_strip(spark, short, name):
    same(spark, name, short, ["embeddings"])


def test_sizes_in_bytes(spark, tmp_path):
    # 256 * 997 bytes are 249.25 KiB, and 3328 * 997 bytes lie beside a tie of MiB.
    spark.range(0, 4200).selectExpr("id AS page_id", "'' AS url", "'' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    rows = same(spark, "string_rules", str(tmp_path), ["pages"])
    assert len(rows) == 4200
