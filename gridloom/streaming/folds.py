"""Folds over ordered events that can be cut anywhere: every event is a transition, and transitions compose.

A fold says what a run of events does to any state, as a row of numbers: for a machine of few states where each of
them ends; for a counter how far it falls and where it stays; for a clock how far it moves and how far it got at most.
Rows compose associatively, so a key's events are folded in pieces by many tasks: events are dealt by ranges of key
and order, each task composes the runs it has, and only one row for each key and task goes on. Those rows, as many as
tasks at most for a key, are composed in order. No row and no group holds a key's events.

The same folds take one event at a time in a stream (``streams``).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAY_STEP_MS = 120.0


def reduce_runs(rows: np.ndarray, starts: np.ndarray, compose) -> np.ndarray:
    """One row for each run of ``rows`` (runs begin at ``starts``), composed in order: neighbours by pairs, again and again."""
    while len(rows) > len(starts):
        size = np.diff(np.append(starts, len(rows)))
        at = np.arange(len(rows)) - np.repeat(starts, size)
        left = at % 2 == 0
        pair = np.flatnonzero(left & (at + 1 < np.repeat(size, size)))
        joined = compose(rows[pair], rows[pair + 1])
        rows = rows.copy()
        rows[pair] = joined
        rows, starts = rows[left], np.concatenate([[0], np.cumsum((size + 1) // 2)[:-1]])
    return rows


class Machine:
    """A machine of few states. ``rules``: (state, event) -> state; pairs that are not named change nothing.

    An event is a value of one column or a tuple of several; events without a rule change nothing.
    """

    kind, state = np.int16, "at int"

    def __init__(self, states: list, rules: dict, columns: tuple[str, ...]):
        self.states, self.columns = states, columns
        place = {s: k for k, s in enumerate(states)}
        self.events = {e: k for k, e in enumerate(dict.fromkeys(e for _, e in rules))}
        self.table = np.tile(np.arange(len(states), dtype=np.int16), (len(self.events) + 1, 1))
        for (s, e), new in rules.items():
            self.table[self.events[e], place[s]] = place[new]

    def lift(self, columns: list) -> np.ndarray:
        values = columns[0] if len(columns) == 1 else list(zip(*columns))
        return self.table[[self.events.get(v, -1) for v in values]]

    def compose(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.take_along_axis(b, a.astype(np.int64), 1)

    def begin(self, first: tuple) -> tuple:
        return (0,)

    def step(self, state: tuple, event: tuple) -> tuple:
        return (int(self.table[self.events.get(event[0] if len(event) == 1 else event, -1), state[0]]),)

    def result(self, state: tuple):
        return self.states[state[0]]

    def results(self, rows: np.ndarray) -> list:
        return [self.states[k] for k in rows[:, 0]]


class Pending:
    """A count: a request (frames) raises it to its own, rounded down; null is a frame that was drawn and lowers it.

    Requests below one, and those that are no finite number, change nothing. A run does max(p - fall, least).
    """

    kind, state, columns = np.int64, "pending long", ("frames",)

    def lift(self, columns: list) -> np.ndarray:
        out = np.zeros((len(columns[0]), 2), np.int64)
        for k, x in enumerate(columns[0]):
            out[k] = (1, 0) if x is None else (0, int(x) if np.isfinite(x) and x >= 1 else 0)
        return out

    def compose(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([a[:, 0] + b[:, 0], np.maximum(a[:, 1] - b[:, 0], b[:, 1])], 1)

    def begin(self, first: tuple) -> tuple:
        return (0,)

    def step(self, state: tuple, event: tuple) -> tuple:
        fall, least = self.lift([event])[0]
        return (max(state[0] - int(fall), int(least)),)

    def result(self, state: tuple) -> int:
        return state[0]

    def results(self, rows: np.ndarray) -> list:
        return np.maximum(-rows[:, 0], rows[:, 1]).tolist()


class Clock:
    """Minutes that ticks (t in ms) move on from ``start``, steps capped at PLAY_STEP_MS, from ``low`` again beyond ``high``.

    ``start``, ``low``, ``high``, ``speed`` (hours a second) are columns that a key's ticks share. A step must not be
    longer than the window. A run is its first and last tick, its whole way and the farthest it got on it; laps follow
    from the farthest, since a step laps once at most.
    """

    kind, state, columns = np.float64, "minutes double, t double", ("t", "start", "low", "high", "speed")

    def lift(self, columns: list) -> np.ndarray:
        t, start, low, high, speed = (np.array(c, float) for c in columns)
        if (speed * (PLAY_STEP_MS / 1000) * 60 > high - low).any():
            raise ValueError("a step may be longer than the window")
        return np.stack([t, t, np.zeros(len(t)), np.full(len(t), -np.inf), start, low, high, speed], 1)

    def compose(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        step = a[:, 7] * (np.minimum(PLAY_STEP_MS, b[:, 0] - a[:, 1]) / 1000) * 60
        out = a.copy()
        out[:, 1], out[:, 2] = b[:, 1], a[:, 2] + step + b[:, 2]
        out[:, 3] = np.maximum(a[:, 3], a[:, 2] + step + np.maximum(b[:, 3], 0))
        return out

    def begin(self, first: tuple) -> tuple:
        return (float(first[1]), float(first[0]))

    def step(self, state: tuple, event: tuple) -> tuple:
        t, _, low, high, speed = event
        m = state[0] + speed * (min(PLAY_STEP_MS, t - state[1]) / 1000) * 60
        return (low + (m - high) if m > high else m, float(t))

    def result(self, state: tuple) -> float:
        return state[0]

    def results(self, rows: np.ndarray) -> list:
        _, _, way, most, start, low, high, _ = rows.T
        laps = np.maximum(np.ceil((start + most - high) / (high - low)), 0)
        return (start + way - laps * (high - low)).tolist()


#: Statuses after an event; pairs that are not named change nothing.
LOADING = {
    ("idle", "camera-in-range"): "requested",
    ("ready", "camera-in-range"): "requested",
    ("requested", "load-start"): "loading",
    ("loading", "load-ok"): "ready",
    ("loading", "load-fail"): "failed",
    ("requested", "release"): "idle",
    ("ready", "release"): "idle",
}
SNAPS = ("min", "half", "full")
#: What becomes of (mode, detail's presence, detail, resume) when something is done to two sheets that share a screen.
#: Keys: the event, whether a detail is there, and what its third part tells apart: for an opening whether the detail is
#: folded, for a snap whether it folds. A field's name stands for its value, "snap" for the event's; None keeps a field.
SHEETS = {
    ("open-detail", False, True): ("min", True, "half", "mode"),
    ("open-detail", False, False): ("min", True, "half", "mode"),
    ("open-detail", True, True): ("min", None, "half", None),
    ("open-detail", True, False): ("min", None, None, None),
    ("close-detail", True, True): ("resume", False, "min", None),
    ("close-detail", True, False): ("resume", False, "min", None),
    ("mode-snap", False, True): ("snap", None, None, None),
    ("mode-snap", False, False): ("snap", None, None, None),
    ("mode-snap", True, True): ("min", None, None, None),
    ("mode-snap", True, False): ("snap", None, "min", "snap"),
    ("detail-snap", True, True): ("resume", None, "min", None),
    ("detail-snap", True, False): ("min", None, "snap", None),
}


def loading() -> Machine:
    return Machine(["idle", "requested", "loading", "ready", "failed"], LOADING, ("event",))


def sheets() -> Machine:
    """The machine of SHEETS: 54 states, all from which it starts with both sheets down."""
    states = [("min", False, "min", "half")]
    states += [s for s in itertools.product(SNAPS, (False, True), SNAPS, SNAPS) if s != states[0]]
    rules = {}
    for state, event, snap in itertools.product(states, ("open-detail", "close-detail", "mode-snap", "detail-snap"), SNAPS):
        mode, there, detail, resume = state
        row = SHEETS.get((event, there, (snap if event.endswith("snap") else detail) == "min"))
        if row:
            values = {"mode": mode, "resume": resume, "snap": snap}
            rules[state, (event, snap)] = tuple(old if new is None else values.get(new, new) for new, old in zip(row, state))
    return Machine(states, rules, ("event", "snap"))


@dataclass
class Runs:
    """Composed rows of the keys of a sorted stream of batches; the last key stays until the next one begins."""

    fold: object
    key: object = None
    row: np.ndarray | None = None

    def add(self, keys: pa.Array, rows: np.ndarray):
        """The keys that ended, and their rows."""
        codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        done = reduce_runs(rows, starts, self.fold.compose)
        names = [keys[int(k)].as_py() for k in starts]
        if self.row is not None:
            if names[0] == self.key:
                done[0] = self.fold.compose(self.row, done[:1])[0]
            else:
                names, done = [self.key, *names], np.concatenate([self.row, done])
        self.key, self.row = names[-1], done[-1:]
        return names[:-1], done[:-1]

    def end(self):
        return ([], np.zeros((0, 0))) if self.row is None else ([self.key], self.row)


def _pieces(fold, key_type):
    """(key, order..., fold's columns), sorted -> (key, piece, row): what this task's part of each key does."""

    def run(batches):
        runs, piece = Runs(fold), TaskContext.get().partitionId()

        def batch(names, rows):
            return pa.RecordBatch.from_arrays([pa.array(names, key_type), pa.array([piece] * len(names), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["key", "piece", "row"])

        for b in batches:
            if b.num_rows:
                yield batch(*runs.add(b.column(0), fold.lift([b.column(1 + k).to_pylist() for k in range(len(fold.columns))])))
        yield batch(*runs.end())

    return run


def _results(fold, key_type, out_type):
    """(key, row), sorted by key and piece -> (key, result)."""

    def run(batches):
        runs = Runs(fold)

        def batch(names, rows):
            return pa.RecordBatch.from_arrays([pa.array(names, key_type), pa.array(fold.results(rows) if len(names) else [], out_type)], names=["key", "result"])

        for b in batches:
            if b.num_rows:
                yield batch(*runs.add(b.column(0), np.stack([np.frombuffer(x.as_py(), fold.kind) for x in b.column(1)])))
        yield batch(*runs.end())

    return run


def folded(events: DataFrame, fold, result: str, order: str = "n", key: str = "key") -> DataFrame:
    """(key, result) after all events (key, order, the fold's columns), from the fold's beginning.

    ``result`` is the type of what the fold gives. Events of equal order come in the order of the fold's columns; a
    null key is a key of its own; an empty table has no keys. Two shuffles: events once, by ranges of key and order,
    and one small row for each key and task.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    columns = [F.col(c) for c in fold.columns]
    key_type = to_arrow_type(events.schema[key].dataType)
    result_type = to_arrow_type(StructType.fromDDL(f"x {result}")[0].dataType)
    ranged = events.select(F.col(key).alias("key"), F.col(order).alias("_order"), *columns).repartitionByRange("key", "_order").sortWithinPartitions("key", "_order", *fold.columns)
    name = events.schema[key].dataType.simpleString()
    pieces = ranged.select("key", *columns).mapInArrow(_pieces(fold, key_type), f"key {name}, piece int, row binary")
    met = pieces.repartition("key").sortWithinPartitions("key", "piece")
    return met.select("key", "row").mapInArrow(_results(fold, key_type, result_type), f"key {name}, result {result}")
