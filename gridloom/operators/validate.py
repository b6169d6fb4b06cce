"""Rules of records: every broken one is named, in a report or as an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import LICENCES

#: Forms of identifiers.
ITEM_ID = r"^Q[1-9]\d*$"
ELEMENT = r"^(node|way|relation)/[1-9]\d*$"
WEB = r"^https://[^\s/]+(/\S*)?$"
SHA256 = r"^[0-9a-f]{64}$"

Rules = list[tuple[str, Column]]


def matches(name: str, pattern: str, optional: bool = False) -> tuple[str, Column]:
    ok = F.coalesce(F.col(name).rlike(pattern), F.lit(False))
    return f"{name} has another form", (ok | F.col(name).isNull()) if optional else ok


def between(name: str, low: float, high: float) -> tuple[str, Column]:
    return f"{name} is out of range", F.coalesce(F.col(name).between(low, high), F.lit(False))


def filled(name: str) -> tuple[str, Column]:
    return f"{name} is missing", F.coalesce(F.length(F.trim(F.col(name))) > 0, F.lit(False))


def places() -> Rules:
    return [matches("id", ITEM_ID), filled("name"), between("lon", -180, 180), between("lat", -90, 90), matches("element", ELEMENT, optional=True), matches("url", WEB, optional=True)]


def photos() -> Rules:
    return [matches("place", ITEM_ID), filled("file"), matches("licence", LICENCES), matches("url", WEB)]


def raster_files() -> Rules:
    return [filled("name"), matches("sha256", SHA256), between("bytes", 1, 2**53), between("width", 1, 2**31), between("height", 1, 2**31)]


def problems(records: DataFrame, rules: Rules, key: str, unique: bool = True) -> DataFrame:
    """(key, problem): a row for each broken rule, and for each key that several records have."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules]))
    found = records.select(F.col(key), F.explode(broken).alias("problem"))
    if not unique:
        return found
    twice = records.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key), F.lit(f"{key} is not unique").alias("problem"))
    return found.unionByName(twice)


def checked(records: DataFrame, rules: Rules, key: str) -> DataFrame:
    """The records; the first that breaks a rule fails, all its problems named."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules]))
    ok = F.when(F.size(broken) > 0, F.raise_error(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(": "), F.array_join(broken, ", "))).cast("boolean")).otherwise(F.lit(True))
    return records.where(ok)


def count_problems(records: DataFrame, said: DataFrame, key: str, count: str) -> DataFrame:
    """(key, said, found) where a document says another number of records than it has."""
    found = records.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    both = said.select(key, F.col(count).alias("said")).join(found, key, "full").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.where(~F.col("said").eqNullSafe(F.col("found")))
