"""Rules over ordered events of many keys (a session, a site, a sheet): folds that can be cut, and what windows can say."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.streaming import folds, streams

SHADOW_DEGREES = 0.25
FLING_MS = 120.0


def loading_status(events: DataFrame) -> DataFrame:
    """(key, status) after all events (key, n, event), from ``idle``; events out of order change nothing."""
    return folds.folded(events, folds.loading(), "string").withColumnRenamed("result", "status")


def pending_frames(events: DataFrame) -> DataFrame:
    """(key, pending): requests (n, frames) raise the count to theirs, rounded down; a null one is a frame that was drawn."""
    return folds.folded(events, folds.Pending(), "long").withColumnRenamed("result", "pending")


def playback(ticks: DataFrame, start: Column, low: Column, high: Column, speed: Column) -> DataFrame:
    """(key, minutes): a clock moved by ticks (key, n, t in ms), steps capped, wrapped at the window's end.

    ``start``, ``low``, ``high`` and ``speed`` (hours a second) are columns that a key's ticks share.
    """
    rows = ticks.withColumns({"start": start, "low": low, "high": high, "speed": speed})
    return folds.folded(rows, folds.Clock(), "double").withColumnRenamed("result", "minutes")


def sheets(events: DataFrame) -> DataFrame:
    """(key, mode, open, detail, resume) after events (key, n, event, snap) of two sheets that share a screen."""
    made = folds.folded(events, folds.sheets(), "struct<mode:string,open:boolean,detail:string,resume:string>")
    return made.select("key", "result.*")


def recomputed(requests: DataFrame) -> DataFrame:
    """(key, n) of the requests (key, n, azimuth, elevation, exaggeration, final) that are not covered by the last one done.

    One is covered by work of the same or better quality with the same exaggeration, the sun having moved by less
    than SHADOW_DEGREES. A key's requests pass through one task in order; none of them is held.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rule = streams.Suppressed(SHADOW_DEGREES)
    kind = to_arrow_type(requests.schema["key"].dataType)

    def run(batches):
        key, state, begun = None, None, False
        for batch in batches:
            done = []
            for k, n, *event in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or k != key:
                    key, state, begun = k, rule.begin(event), True
                new = rule.step(state, tuple(event))
                if new[-1] > state[-1]:
                    done.append((k, n))
                state = new
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.int64())], names=["key", "n"])

    columns = [F.col(c).cast("double").alias(c) for c in rule.columns[:3]]
    ordered = requests.select("key", F.col("n").cast("long").alias("n"), *columns, "final").repartition("key").sortWithinPartitions("key", "n", *rule.columns)
    return ordered.mapInArrow(run, f"key {requests.schema['key'].dataType.simpleString()}, n long")


def round_robin(items: DataFrame, frame: Column, batch: int = 4) -> DataFrame:
    """Items (key, idx from 0, of how many) that a frame's turn reaches: ``batch`` in a row, going round."""
    turn = F.pmod(F.col("idx") - frame * batch, F.col("of"))
    return items.where(turn < batch)


def flings(samples: DataFrame) -> DataFrame:
    """(key, velocity in px a ms) at the end of drags (key, n, t, h): over the samples of the last FLING_MS, two at least."""
    w = Window.partitionBy("key").orderBy(F.desc("n"))
    back = samples.withColumns({"k": F.row_number().over(w), "end": F.first("t").over(w)})
    used = back.where((F.col("end") - F.col("t") <= FLING_MS) | (F.col("k") <= 2))
    s = used.groupBy("key").agg(F.min_by(F.struct("t", "h"), F.col("n")).alias("a"), F.max_by(F.struct("t", "h"), F.col("n")).alias("b"))
    dt = F.col("b.t") - F.col("a.t")
    return s.select("key", F.when(dt > 0, (F.col("b.h") - F.col("a.h")) / dt).otherwise(0.0).alias("velocity"))


def gestures(moves: DataFrame) -> DataFrame:
    """(key, zoom, twist in degrees, pan_x, pan_y) of two pointers' moves (key, n, ax, ay, bx, by), from first to last.

    The zoom is the ratio of their distances, the twist the turn of the line between them the short way round, the
    pan that of their middle.
    """
    m = moves.groupBy("key").agg(F.min_by(F.struct("ax", "ay", "bx", "by"), F.col("n")).alias("a"), F.max_by(F.struct("ax", "ay", "bx", "by"), F.col("n")).alias("b"))
    span = lambda s: F.hypot(F.col(f"{s}.bx") - F.col(f"{s}.ax"), F.col(f"{s}.by") - F.col(f"{s}.ay"))
    angle = lambda s: F.atan2(F.col(f"{s}.by") - F.col(f"{s}.ay"), F.col(f"{s}.bx") - F.col(f"{s}.ax"))
    middle = lambda s, c: (F.col(f"{s}.a{c}") + F.col(f"{s}.b{c}")) / 2
    turn = F.degrees(angle("b") - angle("a"))
    twist = F.pmod(turn + 540, F.lit(360.0)) - 180
    return m.select("key", F.when(span("a") > 0, span("b") / span("a")).otherwise(1.0).alias("zoom"), twist.alias("twist"), (middle("b", "x") - middle("a", "x")).alias("pan_x"), (middle("b", "y") - middle("a", "y")).alias("pan_y"))


def wheel_zoom(delta: Column, per_px: float = 0.002) -> Column:
    return F.exp(-delta * per_px)
