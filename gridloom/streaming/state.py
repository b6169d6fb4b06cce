"""Per-step state: particles on a flow field, resident sets, and a stream that keeps them.

A particle step is one keyed join of particles with the field; the resident set is a top-k with a stable
tie-break. The streaming variant keeps the same set in keyed state, with a watermark.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import pcg
from gridloom.operators.hydro import STEPS

SPEED, GAIN, LIFE, FADE = 2.0, 0.1, 90.0, 4.0


def particle_step(particles: DataFrame, field: DataFrame, width: int, height: int, dt: float) -> DataFrame:
    """Move particles (id, x, y, age) along the field (i, j, dir, acc); one at a sink fades; ``dead`` ones respawn."""
    clamp = lambda c, n: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(n - 1)).cast("long")
    p = particles.withColumns({"i": clamp("x", width), "j": clamp("y", height)}).join(field, ["i", "j"])
    dx, dy = F.lit(0.0), F.lit(0.0)
    for c, di, dj in STEPS:
        s = math.sqrt(0.5) if di and dj else 1.0
        dx, dy = F.when(F.col("dir") == c, di * s).otherwise(dx), F.when(F.col("dir") == c, dj * s).otherwise(dy)
    speed = SPEED * (1 + GAIN * F.log2(F.col("acc").cast("double"))) * dt
    moved = p.select("id", "dir", (F.col("x") + dx * speed).alias("x"), (F.col("y") + dy * speed).alias("y"), (F.col("age") + dt).alias("age"))
    off = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") >= width - 1) | (F.col("y") >= height - 1)
    age = F.when((F.col("dir") == 0) & ~off, F.greatest("age", F.lit(LIFE - FADE))).otherwise(F.col("age"))
    return moved.select("id", "x", "y", age.alias("age"), (off | (age >= LIFE)).alias("dead"))


def respawned(particles: DataFrame, spawn: DataFrame, n: int, frame: int) -> DataFrame:
    """Particles (id, x, y, age, dead) whose dead ones begin anew on a cell of ``spawn`` (idx from 0 to n - 1, i, j).

    The cell follows from a hash of the particle's number and the frame's, so a step can be run again.
    """
    draw = pcg(pcg(F.col("id")).bitwiseXOR(pcg(F.lit(frame).cast("long"))))
    dead = particles.where("dead").withColumn("idx", F.pmod(draw, F.lit(n))).join(spawn.select("idx", "i", "j"), "idx")
    begun = dead.select("id", F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), F.lit(0.0).alias("age"), F.lit(False).alias("dead"))
    return particles.where(~F.col("dead")).select("id", "x", "y", "age", "dead").unionByName(begun)


def resident_set(wanted: DataFrame, key: str, limit: int) -> DataFrame:
    """The nearest ``limit`` of each key's (item, d), ties by item."""
    w = Window.partitionBy(key).orderBy("d", "item")
    return wanted.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n")


def evictions(resident: DataFrame, wanted: DataFrame, key: str, excess: int) -> DataFrame:
    """Items to let go: not wanted, farthest first, then least recently used, then by item."""
    free = resident.join(wanted.select(key, "item"), [key, "item"], "left_anti")
    w = Window.partitionBy(key).orderBy(F.desc("d"), "used", "item")
    return free.withColumn("n", F.row_number().over(w)).where(F.col("n") <= excess).select(key, "item", F.col("n").cast("long").alias("n"))


def resident_stream(events: DataFrame, limit: int = 3, idle_days: int = 1) -> DataFrame:
    """Stream of (key, ts, item, d) -> after each batch a key's resident set, the nearest ``limit`` items, ties by item.

    State holds that set alone, since what is farther can never come back into it; it goes when a key has had no event
    for ``idle_days`` of event time. Events later than that are left out.
    """

    def update(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(zip(*state.get)) if state.exists else []
        for pdf in batches:
            kept += list(zip(pdf["d"].map(float), pdf["item"].map(int)))
        kept = sorted(set(kept))[:limit]
        state.update(([d for d, _ in kept], [i for _, i in kept]))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + idle_days * 86_400_000)
        yield pd.DataFrame({"key": [key[0]], "items": [[i for _, i in kept]]})

    watched = events.withWatermark("ts", f"{idle_days} days").groupBy("key")
    return watched.applyInPandasWithState(update, "key long, items array<long>", "d array<double>, i array<long>", "update", "EventTimeTimeout")
