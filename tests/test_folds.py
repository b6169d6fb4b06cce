"""Folds that can be cut anywhere, and the same folds as streams, against one walk over all events."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.streaming import folds, reducers, streams

EVENTS = ("camera-in-range", "load-start", "load-ok", "load-fail", "release", "unknown", None)


def walk_status(events):
    s = "idle"
    for e in events:
        if e == "camera-in-range" and s in ("idle", "ready"):
            s = "requested"
        elif (s, e) in (("requested", "load-start"), ("loading", "load-ok"), ("loading", "load-fail")):
            s = {"load-start": "loading", "load-ok": "ready", "load-fail": "failed"}[e]
        elif e == "release" and s in ("requested", "ready"):
            s = "idle"
    return s


def walk_pending(frames):
    p = 0
    for x in frames:
        if x is None:
            p = max(p - 1, 0)
        elif math.isfinite(x) and x >= 1:
            p = max(p, math.floor(x))
    return p


def walk_clock(ticks, start, low, high, speed):
    m, last = start, ticks[0]
    for t in ticks:
        m += speed * min(120.0, t - last) / 1000 * 60
        if m > high:
            m = low + (m - high)
        last = t
    return m


class Sheets:
    """Two sheets, one of them up at most."""

    def __init__(self):
        self.mode, self.open, self.detail, self.resume = "min", False, "min", "half"

    def do(self, event, snap):
        if event == "open-detail":
            if not self.open:
                self.resume, self.open, self.detail = self.mode, True, "half"
            elif self.detail == "min":
                self.detail = "half"
            self.mode = "min"
        elif event == "close-detail" and self.open:
            self.open, self.detail, self.mode = False, "min", self.resume
        elif event == "mode-snap":
            self.mode = snap
            if self.open and snap != "min":
                self.detail, self.resume = "min", snap
        elif event == "detail-snap" and self.open:
            self.detail = snap
            self.mode = self.resume if snap == "min" else "min"

    @property
    def all(self):
        return self.mode, self.open, self.detail, self.resume


def walk_sheets(events):
    s = Sheets()
    for e in events:
        s.do(*e)
    return s.all


def by_key(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1]):
        out[r[0]].append(r[2:])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_runs_compose_however_they_are_cut(seed):
    rng = random.Random(seed)
    m = folds.sheets()
    events = [(rng.choice(["open-detail", "close-detail", "mode-snap", "detail-snap"]), rng.choice(folds.SNAPS)) for _ in range(200)]
    rows = m.lift([[e[0] for e in events], [e[1] for e in events]])
    cuts = sorted({0, *rng.sample(range(200), 20)})
    pieces = folds.reduce_runs(rows, np.array(cuts), m.compose)
    assert m.results(folds.reduce_runs(pieces, np.array([0]), m.compose)) == [walk_sheets(events)]
    state = m.begin(())
    for e in events:
        state = m.step(state, e)
    assert m.result(state) == walk_sheets(events)


def hot(rng, n, value):
    """Events of which a third are one key's, in no order, keys null too."""
    rows = [(rng.choice([1, 1, 1, 2, None, *range(3, 9)]), k, *value(k)) for k in range(n)]
    rng.shuffle(rows)
    return rows


def test_loading_and_a_hot_key_of_many_tasks(spark):
    rows = hot(random.Random(1), 4000, lambda k: (random.Random(k).choice(EVENTS),))
    df = spark.createDataFrame(rows, "key long, n long, event string")
    assert {r.key: r.status for r in reducers.loading_status(df).collect()} == {k: walk_status([e for (e,) in v]) for k, v in by_key(rows).items()}
    m = folds.loading()
    ranged = df.withColumn("_order", F.col("n")).repartitionByRange(8, "key", "_order").sortWithinPartitions("key", "_order")
    pieces = ranged.select("key", "event").mapInArrow(folds._pieces(m, pa.int64()), "key long, piece int, row binary")
    assert pieces.where("key = 1").select("piece").distinct().count() > 2 and pieces.count() < 40
    assert reducers.loading_status(df.limit(0)).count() == 0


def test_pending(spark):
    rows = hot(random.Random(2), 3000, lambda k: (random.Random(k).choice([None, None, 0.5, 1.9, 3.0, 60.0, float("inf"), float("nan"), -2.0]),))
    df = spark.createDataFrame(rows, "key long, n long, frames double")
    assert {r.key: r.pending for r in reducers.pending_frames(df).collect()} == {k: walk_pending([f for (f,) in v]) for k, v in by_key(rows).items()}


def test_clock(spark):
    rng = random.Random(3)
    rows, t = [], defaultdict(float)
    for k in range(3000):
        key = rng.choice(["a", "a", "b", "c"])
        t[key] += rng.choice([0, 5, 17, 90, 500, -40])
        rows.append((key, k, t[key]))
    df = spark.createDataFrame(rows, "key string, n long, t double")
    got = {r.key: r.minutes for r in reducers.playback(df, F.lit(1000.0), F.lit(390.0), F.lit(1100.0), F.when(F.col("key") == "a", 3.0).otherwise(90.0)).collect()}
    for k, v in by_key(rows).items():
        assert got[k] == pytest.approx(walk_clock([x for (x,) in v], 1000.0, 390.0, 1100.0, 3.0 if k == "a" else 90.0), abs=1e-6)
    with pytest.raises(Exception, match="longer than the window"):
        reducers.playback(df, F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(3.0)).collect()


def test_sheets(spark):
    rows = hot(random.Random(4), 3000, lambda k: (random.Random(k).choice(["open-detail", "close-detail", "mode-snap", "detail-snap", "other"]), random.Random(-k).choice(folds.SNAPS)))
    df = spark.createDataFrame(rows, "key long, n long, event string, snap string")
    assert {r.key: tuple(r)[1:] for r in reducers.sheets(df).collect()} == {k: walk_sheets(v) for k, v in by_key(rows).items()}


# Streams


@pytest.fixture
def few(spark):
    """Two partitions: each has a state store of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def late(spark, tmp_path, rows, schema, files):
    """The rows in so many files, each of which is a batch; within a file and between them events are in no order."""
    rng = random.Random(files)
    rng.shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def stamped(rows):
    from datetime import datetime, timedelta, timezone

    begin = datetime(2024, 1, 1, tzinfo=timezone.utc)
    return [(k, begin + timedelta(minutes=n), n, *rest) for k, n, *rest in rows]


@pytest.mark.parametrize("files", [1, 4])
def test_stream_of_statuses_late_and_begun_anew(spark, few, tmp_path, files):
    rows = hot(random.Random(6), 400, lambda k: (random.Random(k).choice(EVENTS),))
    m = folds.loading()
    source = late(spark, tmp_path, stamped(rows), "key long, ts timestamp, n long, event string", files)
    run = lambda: streams.replayed(streams.keyed(source(), streams.Folded(m, streams.machine_types(m)), "status string", "1 day"), str(tmp_path / "out"))
    want = {k: walk_status([e for (e,) in v]) for k, v in by_key(rows).items()}
    assert {r.key: r.status for r in run().collect()} == want
    # More events after a restart from the checkpoint; by then timers have put the first ones into the state.
    more = [(k, 5000 + n, e) for k, n, e in hot(random.Random(7), 200, lambda k: (random.Random(k).choice(EVENTS),))]
    spark.createDataFrame(stamped(more), "key long, ts timestamp, n long, event string").coalesce(1).write.parquet(str(tmp_path / "in" / "later"))
    want |= {k: walk_status([e for (e,) in v]) for k, v in by_key(rows + more).items()}
    assert {r.key: r.status for r in run().collect()} == want


def test_streams_of_counts_clocks_and_sheets(spark, few, tmp_path):
    rng = random.Random(8)
    counts = [(k % 3, k, rng.choice([None, 2.5, 7.0, 0.0])) for k in range(150)]
    out = streams.keyed(late(spark, tmp_path / "a", stamped(counts), "key long, ts timestamp, n long, frames double", 3)(), streams.Folded(folds.Pending(), "frames double"), "pending long", "1 day")
    assert {r.key: r.pending for r in streams.replayed(out, str(tmp_path / "a" / "out")).collect()} == {k: walk_pending([f for (f,) in v]) for k, v in by_key(counts).items()}
    ticks = [(k % 2, k, k * 70.0, 1000.0, 390.0, 1100.0, 3.0) for k in range(150)]
    out = streams.keyed(late(spark, tmp_path / "b", stamped(ticks), "key long, ts timestamp, n long, t double, start double, low double, high double, speed double", 2)(), streams.Folded(folds.Clock(), "t double, start double, low double, high double, speed double"), "minutes double", "1 day")
    got = {r.key: r.minutes for r in streams.replayed(out, str(tmp_path / "b" / "out")).collect()}
    assert got == {k: pytest.approx(walk_clock([x[0] for x in v], 1000.0, 390.0, 1100.0, 3.0)) for k, v in by_key(ticks).items()}
    moves = [(k % 2, k, rng.choice(["open-detail", "close-detail", "mode-snap", "detail-snap"]), rng.choice(folds.SNAPS)) for k in range(150)]
    m = folds.sheets()
    out = streams.keyed(late(spark, tmp_path / "c", stamped(moves), "key long, ts timestamp, n long, event string, snap string", 2)(), streams.Folded(m, streams.machine_types(m)), "mode string, open boolean, detail string, resume string", "1 day")
    assert {r.key: tuple(r)[1:] for r in streams.replayed(out, str(tmp_path / "c" / "out")).collect()} == {k: walk_sheets(v) for k, v in by_key(moves).items()}


def test_stream_of_requests_and_keys_that_go(spark, few, tmp_path):
    rng = random.Random(9)
    rows = [(k % 3, k, 10 + k * 0.04, 30.0, float(k // 60), rng.random() < 0.5) for k in range(200)]
    schema = "key long, ts timestamp, n long, azimuth double, elevation double, exaggeration double, final boolean"
    source = late(spark, tmp_path, stamped(rows), schema, 3)
    run = lambda idle: streams.replayed(streams.keyed(source(), streams.Suppressed(0.25, idle), "azimuth double, done long", "1 day"), str(tmp_path / "out"))
    batch = reducers.recomputed(spark.createDataFrame([(r[0], r[1], *r[2:]) for r in rows], "key long, n long, azimuth double, elevation double, exaggeration double, final boolean"))
    want = {r.key: r["count"] for r in batch.groupBy("key").count().collect()}
    assert {r.key: r.done for r in run(streams.DAY).collect()} == want
    # After idle days a key begins anew: another key's event moves the watermark, the next one finds no state.
    for k, at in ((9, 10_000), (0, 10_001)):
        spark.createDataFrame(stamped([(k, at, 1.0, 2.0, 1.0, True)]), schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"late{k}"))
        got = {r.key: r.done for r in run(streams.DAY).collect()}
    assert got == want | {0: 1, 9: 1}
