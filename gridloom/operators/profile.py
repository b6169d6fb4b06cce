"""Ordered series: transect statistics with hysteresis, frame statistics, chart ticks, event folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLIMB_METRES = 25.0
FRAMES, BREAK_MS = 60, 500.0


def profile_stats(samples: DataFrame) -> DataFrame:
    """Per transect: counts, extremes with their first index, climb and fall in steps of CLIMB_METRES at least.

    The fold runs inside the engine over the transect's ordered elevations; gaps are passed over.
    """
    s = samples.where("elevation is not null")
    base = s.groupBy("tid").agg(
        F.count(F.lit(1)).alias("defined"),
        F.min("elevation").alias("min_e"),
        F.max("elevation").alias("max_e"),
        F.min_by("k", F.struct("elevation", "k")).alias("min_k"),
        F.max_by("k", F.struct(F.col("elevation"), -F.col("k"))).alias("max_k"),
        F.sort_array(F.collect_list(F.struct("k", "elevation"))).alias("line"),
    ).join(samples.groupBy("tid").agg(F.max("distance").alias("total")), "tid")
    zero = F.struct(F.get("line", F.lit(0)).elevation.alias("anchor"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))

    def merge(a, x):
        d = x.elevation - a.anchor
        moved = F.abs(d) >= CLIMB_METRES
        return F.struct(F.when(moved, x.elevation).otherwise(a.anchor).alias("anchor"), (a.up + F.when(moved & (d > 0), d).otherwise(0.0)).alias("up"), (a.down - F.when(moved & (d < 0), d).otherwise(0.0)).alias("down"))

    folded = base.withColumn("f", F.aggregate("line", zero, merge))
    return folded.where("defined >= 2").select("tid", "defined", "min_e", "max_e", "min_k", "max_k", (F.col("max_e") - F.col("min_e")).alias("span"), "total", F.col("f.up").alias("ascent"), F.col("f.down").alias("descent"))


def cumulative_distance(samples: DataFrame) -> DataFrame:
    """Ground distance along a path (tid, k, x, y): running sum of steps."""
    w = Window.partitionBy("tid").orderBy("k")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return samples.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("along", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def ground_distance(samples: DataFrame, metres_per_pixel: float) -> DataFrame:
    """Distance on the ground along a path (tid, k, px, py, lat): pixels shrink with the cosine of the latitude between."""
    w = Window.partitionBy("tid").orderBy("k")
    before = lambda c: F.lag(c).over(w)
    middle = F.radians((F.col("lat") + before("lat")) / 2)
    step = F.hypot(F.col("px") - before("px"), F.col("py") - before("py")) * metres_per_pixel * F.cos(middle)
    return samples.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("along", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def chart_path(points: DataFrame, width: float, height: float, pad: float = 0.04) -> DataFrame:
    """(tid, path): an SVG path of a chart (tid, k, x, y); a null y ends a run. Places are rounded to a tenth of a pixel.

    The chart spans the values, and ``pad`` of their range beyond them. One chart's points make one string.
    """
    lines = points.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("p"), *[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("a", F.min), ("b", F.max))])
    span = lambda c: F.when(F.col(f"b{c}") > F.col(f"a{c}"), F.col(f"b{c}") - F.col(f"a{c}")).otherwise(1.0)
    tenth = lambda v: F.format_string("%.1f", F.floor(v * 10 + 0.5) / 10)
    at = lambda p: F.concat(tenth((p["x"] - F.col("ax")) / span("x") * width), F.lit(","), tenth((1 - (p["y"] - F.col("ay") + span("y") * pad) / (span("y") * (1 + 2 * pad))) * height))
    known = F.transform("p", lambda p, k: F.struct(p["y"].isNotNull().alias("there"), F.coalesce(F.get("p", k - 1)["y"].isNotNull() & (k > 0), F.lit(False)).alias("goes_on"), at(p).alias("at")))
    parts = F.transform(F.filter(known, lambda q: q["there"]), lambda q: F.concat(F.when(q["goes_on"], "L").otherwise("M"), q["at"]))
    return lines.select("tid", F.array_join(parts, " ").alias("path"))


def frame_stats(ticks: DataFrame) -> DataFrame:
    """Frame rate over the last FRAMES intervals of (key, t in ms, n for ties); a long gap starts a new run."""
    w = Window.partitionBy("key").orderBy("t", "n")
    gap = F.col("t") - F.lag("t").over(w)
    runs = ticks.withColumn("gap", gap).withColumn("run", F.sum(F.when(F.col("gap") > BREAK_MS, 1).otherwise(0)).over(w))
    last = Window.partitionBy("key", "run").orderBy("t", "n").rowsBetween(-(FRAMES - 1), 0)
    used = F.when(F.col("gap") <= BREAK_MS, F.col("gap"))
    n, total = F.count(used).over(last), F.sum(used).over(last)
    return runs.select("key", "t", "n", n.alias("intervals"), F.when(total > 0, n * 1000 / total).alias("fps"))


def nice_ticks(spans: DataFrame, target: int) -> DataFrame:
    """Adds step and ticks to (low, high): the largest 1, 2 or 5 times a power of ten up to span / target."""
    raw = (F.col("high") - F.col("low")) / target
    mag = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.when(mag * 10 <= raw, mag * 10).when(mag * 5 <= raw, mag * 5).when(mag * 2 <= raw, mag * 2).otherwise(mag)
    first = F.ceil(F.col("low") / F.col("step") - 1e-9)
    last = F.floor((F.col("high") + 1e-9) / F.col("step"))
    flat = F.col("high") <= F.col("low")
    return spans.withColumn("step", F.when(~flat, step)).withColumn("ticks", F.when(flat, F.array("low")).when(first <= last, F.transform(F.sequence(first, last), lambda k: k * F.col("step"))).otherwise(F.expr("cast(array() as array<double>)")))


def taps(events: DataFrame, max_ms: int, max_move: float) -> DataFrame:
    """Pointer events (key, t in ms, n, kind, v): a release within time and distance of the press before it is a tap."""
    w = Window.partitionBy("key").orderBy("t", "n")
    prior = events.withColumns({"was": F.lag("kind").over(w), "t0": F.lag("t").over(w), "v0": F.lag("v").over(w)})
    return prior.where((F.col("kind") == "up") & (F.col("was") == "down") & (F.col("t") - F.col("t0") < max_ms) & (F.abs(F.col("v") - F.col("v0")) < max_move)).select("key", "t", "n")
