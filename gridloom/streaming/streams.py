"""Keyed streams: the folds of ``folds`` and the suppression of needless work, one event at a time.

A processor keeps a key's state up to the watermark as a typed value, and the events after it in a list. Events may come
late and in any order: when the watermark has passed them, a timer puts them into the state in their order. After each
batch a key's row tells the state after all events seen so far, so that a stream's last rows are what the batch query
gives, however the events were cut into batches, in whatever order within the watermark they came, and however often
the stream was started anew from its checkpoint.

Streams need the RocksDB state store (``STORE``); ``replayed`` sets it for its own run.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from gridloom.streaming.folds import Machine

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Milliseconds without an event after which a key's state goes, if that is asked for.
DAY = 86_400_000


class Late(StatefulProcessor):
    """Events (key, ts, n, columns) in the order of (ts, n): what all processors here share.

    A subclass says what its state is (``state``, a schema), how it begins, what an event does to it and what a key's
    row tells of it.
    """

    state = ""

    def __init__(self, columns: tuple[str, ...], types: str, idle_ms: int | None = None):
        self.columns, self.types, self.idle_ms, self.told_names = columns, types, idle_ms, ()

    def begin(self, event: tuple) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, event: tuple) -> tuple:
        raise NotImplementedError

    def told(self, state: tuple) -> tuple:
        raise NotImplementedError

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", self.state)
        self.waiting = handle.getListState("waiting", f"at long, n long, {self.types}")
        self.seen = handle.getValueState("seen", "at long")

    def _events(self, new: list[tuple] = ()) -> list[tuple]:
        """The events that wait, and those of a batch that are not yet among them, in their order."""
        return sorted([*((tuple(e) for e in self.waiting.get()) if self.waiting.exists() else ()), *new], key=lambda e: (e[:2], [(x is not None, x) for x in e[2:]]))

    def _after(self, state, events: list[tuple]):
        for e in events:
            state = self.step(state if state is not None else self.begin(e[2:]), e[2:])
        return state

    def _wake(self, events: list[tuple]) -> None:
        """A timer behind the earliest of these events: one for a batch, not one for an event; it sets the next one."""
        if events:
            self.handle.registerTimer(min(e[0] for e in events) + 1)

    def handleInputRows(self, key, rows, timerValues):
        new = [(r.at, r.n, *[r[c] for c in self.columns]) for r in rows]
        events = self._events(new)
        self.waiting.appendList(new)
        self._wake(new)
        last = max([e[0] for e in new] + ([self.seen.get()[0]] if self.seen.exists() else []))
        self.seen.update((last,))
        if self.idle_ms is not None:
            self.handle.registerTimer(last + self.idle_ms)
        yield self._row(key, self._after(self.value.get() if self.value.exists() else None, events))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark, events = timerValues.getCurrentWatermarkInMs(), self._events()
        past = [e for e in events if e[0] <= mark]
        if past:
            self.value.update(self._after(self.value.get() if self.value.exists() else None, past))
            left = events[len(past) :]
            self.waiting.put(left) if left else self.waiting.clear()
            self._wake(left)
        if self.idle_ms is not None and self.seen.exists() and self.seen.get()[0] + self.idle_ms <= mark:
            for kept in (self.value, self.waiting, self.seen):
                kept.clear()
        yield from ()

    def _row(self, key, state):
        return Row(key=key[0], **dict(zip(self.told_names, self.told(state))))

    def close(self) -> None:
        pass


class Folded(Late):
    """A fold of ``folds``, one event at a time."""

    def __init__(self, fold, types: str, idle_ms: int | None = None):
        super().__init__(fold.columns, types, idle_ms)
        self.fold, self.state = fold, fold.state

    def begin(self, event: tuple) -> tuple:
        return self.fold.begin(event)

    def step(self, state: tuple, event: tuple) -> tuple:
        return self.fold.step(tuple(state), event)

    def told(self, state: tuple) -> tuple:
        result = self.fold.result(tuple(state))
        return result if isinstance(result, tuple) else (result,)


class Suppressed(Late):
    """Counts the requests (azimuth, elevation, exaggeration, final) that are not covered by the last one done.

    One is covered by work of the same or better quality with the same exaggeration, the sun having moved by less than
    ``degrees``.
    """

    state = "azimuth double, elevation double, exaggeration double, final boolean, done long"

    def __init__(self, degrees: float, idle_ms: int | None = None):
        super().__init__(("azimuth", "elevation", "exaggeration", "final"), self.state.removesuffix(", done long"), idle_ms)
        self.degrees = degrees

    def begin(self, event: tuple) -> tuple:
        return (None, None, None, None, 0)

    def step(self, state: tuple, event: tuple) -> tuple:
        (az, el, ex, final, done), (azimuth, elevation, exaggeration, good) = state, event
        if az is not None and (final or not good) and ex == exaggeration:
            a, b = math.radians(el), math.radians(elevation)
            dot = math.sin(a) * math.sin(b) + math.cos(a) * math.cos(b) * math.cos(math.radians(az) - math.radians(azimuth))
            if math.degrees(math.acos(max(-1.0, min(1.0, dot)))) < self.degrees:
                return tuple(state)
        return (azimuth, elevation, exaggeration, good, done + 1)

    def told(self, state: tuple) -> tuple:
        return (state[0], state[4])


def keyed(events: DataFrame, processor: Late, out: str, delay: str) -> DataFrame:
    """A stream of events (key, ts, n, the processor's columns) -> after each batch a row for each of its keys: (key, ``out``).

    Events later than ``delay`` behind the latest one may be left out, by Spark's watermark.
    """
    key = events.schema["key"].dataType.simpleString()
    processor.told_names = StructType.fromDDL(out).names
    rows = events.select("key", F.col("ts").cast("timestamp").alias("ts"), "n", *processor.columns).withWatermark("ts", delay).withColumn("at", F.unix_millis("ts"))
    return rows.groupBy("key").transformWithState(processor, f"key {key}, {out}", "Update", "EventTime")


def replayed(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what its source has by now, and give the last row of each key.

    Batches are written below ``folder``, a batch that is run again over its own; the checkpoint is there too, so that a
    later call goes on where an earlier one ended.
    """
    spark = stream.sparkSession
    schema = stream.schema
    columns = [c for c in schema.names if c != "key"]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        spark.conf.set(STORE[0], before) if before is not None else spark.conf.unset(STORE[0])
    rows = spark.read.schema(schema.add("batch", "long")).parquet(f"{folder}/rows")
    return rows.groupBy("key").agg(F.max_by(F.struct(*columns), "batch").alias("last")).select("key", *[F.col(f"last.{c}").alias(c) for c in columns])


def machine_types(machine: Machine) -> str:
    return ", ".join(f"{c} string" for c in machine.columns)
