"""Loops over a graph whose steps are written to storage, so that lineage stays short and executors may go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.shared import skew_safe_join, stored

#: A step of a loop, written to the shared folder.
checkpointed = stored


def terminals(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """For each node of a functional forest (src, dst or null) its end: rows (src, terminal), by pointer doubling."""
    p = checkpointed(edges.select("src", F.coalesce("dst", "src").alias("to")))
    for _ in range(max_rounds):
        step = checkpointed(p.alias("a").join(p.alias("b"), F.col("a.to") == F.col("b.src")).select("a.src", F.col("b.to").alias("to"), (F.col("a.to") != F.col("b.to")).alias("moved")))
        p = step.select("src", "to")
        if step.where("moved").isEmpty():
            return p.withColumnRenamed("to", "terminal")
    raise RuntimeError("the graph has a cycle or paths beyond 2**max_rounds")


def upstream_counts(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """For each node the nodes that drain through it, itself included: rows (src, acc)."""
    return upstream_sums(edges.select("src", "dst", F.lit(1).cast("long").alias("acc")), max_rounds)


def upstream_sums(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """For each node of a functional forest (src, dst or null, acc) the sum of what drains through it, its own included: rows (src, acc).

    Doubling: after k rounds acc sums what lies up to 2**k - 1 steps upstream, and ``to`` is 2**k steps down.
    """
    s = checkpointed(edges.select("src", F.col("dst").alias("to"), "acc"))
    for _ in range(max_rounds):
        flowing = s.where(F.col("to").isNotNull())
        if flowing.isEmpty():
            return s.select("src", "acc")
        inflow = flowing.groupBy(F.col("to").alias("src")).agg(F.sum("acc").alias("more"))
        jump = s.select(F.col("src").alias("to"), F.col("to").alias("far"))
        s = checkpointed(s.join(inflow, "src", "left").join(jump, "to", "left").select("src", F.col("far").alias("to"), (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")))
    raise RuntimeError("the graph has a cycle or paths beyond 2**max_rounds")


def labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: rows (node, label), label the smallest node. ``edges`` (u, v), one or both ways."""
    found = components(edges)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u long, v long)``: rows (node, root), root the smallest node reached.

    Alternating large-star and small-star steps. A step needs each node's smallest neighbour only: a minimum
    with map-side partial sums, and a join back that spreads hot nodes. Every step is written to the shared
    folder; the loop ends when a pass changes nothing and fails loudly if 60 passes do not suffice. Null and
    self edges are ignored; nodes without an edge do not appear.
    """
    e = stored(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    for _ in range(60):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n = 2 * e.count()
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg")).withColumn("m", F.least("m", "u"))
        large = stored(
            skew_safe_join(both, low, ["u"], "deg", n, "inner")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg"))
        joined = skew_safe_join(large, low, ["u"], "deg", max(large.count(), 1), "inner")
        small = stored(
            joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s"))
            .select("s.u", "s.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        total = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        before, after = total(e), total(small)
        e = small
        if before == after:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
    raise RuntimeError("connected components did not settle in 60 passes")
