"""Exact values by rank, without one buffer or one partition that holds all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096
#: A bin with so many distinct values at most is read; a fuller one is cut again.
READ = 1 << 16


def at_ranks(df: DataFrame, value: Column, ranks: list[int]) -> list[float]:
    """The values at ranks (from 0, ascending) among the non-null values of a column.

    Counts of values fall into bins; the bin of each rank is cut into bins again, until it has few distinct values.
    What reaches the driver is at most BINS rows a step, or READ.
    """
    counts = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return [_at(counts, rank) for rank in ranks]


def _at(counts: DataFrame, rank: int) -> float:
    while True:
        low, high, distinct = counts.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
        if distinct <= READ or low == high:
            seen = 0
            for v, n in sorted(tuple(r) for r in counts.collect()):
                seen += n
                if seen > rank:
                    return v
            raise IndexError(rank)
        width = (high - low) / BINS
        at = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1))
        for b, n in sorted(tuple(r) for r in counts.groupBy(at.alias("b")).agg(F.sum("n")).collect()):
            if rank < n:
                counts = counts.where(at == b)
                break
            rank -= n


def percentiles(df: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """Linear percentiles (rank q * (n - 1)) of the non-null values; null where there are none."""
    n = df.agg(F.count(value)).first()[0]
    if not n:
        return [None] * len(shares)
    out = []
    for q in shares:
        if not 0 <= q <= 1:
            raise ValueError(f"a share between 0 and 1, not {q}")
        r = q * (n - 1)
        a, b = at_ranks(df, value, [int(r), min(int(r) + 1, n - 1)])
        out.append(a + (b - a) * (r - int(r)))
    return out
