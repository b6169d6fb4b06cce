"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives (labelled good) and unlabelled web text, which is every text outside the held-out fold, train a
classifier whose risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

is an unbiased estimate of the supervised risk, kept from becoming negative. No label of a bad text is read. The
class prior is estimated: a first classifier tells positives from unlabelled text, and the least ratio of the
two's shares above a cut of its scores is the share of positives in the unlabelled text.

The classifier is additive: a piecewise linear curve for each of some statistics of a text's words and
characters, and a weight for each of LEXICAL classes of its words. Quantiles, sums and slopes of both risks are
distributed sums over all texts, a few hundred numbers for any corpus; every step is a pass over stored features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import maybe_broadcast, pick, stored
from gridloom.llm.toxicity import is_training
from gridloom.llm.words import SPACED, join_hash, slices

KNOTS = (0.05, 0.25, 0.5, 0.75, 0.95)
LEXICAL = 64
THRESHOLD = 0.7
#: Passes over the features for either classifier, at most; and the ridge on its weights.
STEPS, RIDGE = 12, 1e-3
#: The prior is read at cuts with this share of the positives above them, at least; scores fall into BINS.
LEAST_SHARE, BINS = 0.5, 400
#: Tasks' sums that are added together, 1.2 MB each, in as many levels as it takes.
FAN_IN = 32
SYMBOLS = b"!|#$%&*.,;:-_/\\<>=@+"


def statistics(part) -> np.ndarray:
    """A row of statistics for each text of a slice."""
    w = part.words(SPACED)
    raw, n = part.raw, part.rows
    size = np.maximum(part.end - part.start, 1)
    words = np.maximum(w.count, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[part.end] - sums[part.start]

    h = w.hash
    upper = share((raw >= 65) & (raw <= 90))
    out = [np.log1p(w.count), np.log1p(size), size / words, upper / size, share((raw >= 48) & (raw <= 57)) / size, share(raw >= 128) / size, share(raw == 10) / words]
    out += [share(raw == s) / words for s in SYMBOLS]
    symbol = (raw > 32) & (raw < 127) & ~((raw >= 48) & (raw <= 57)) & ~((raw >= 65) & (raw <= 90)) & ~((raw >= 97) & (raw <= 122))
    out.append(share(symbol) / words)
    # Repetition: a word that follows itself, and words and word pairs a text has already.
    at = w.run(2)
    out.append(np.bincount(w.doc[at][h[at] == h[at + 1]], minlength=n) / words)
    for hashes, doc in ((h, w.doc), (join_hash([h[at], h[at + 1]]), w.doc[at])):
        order = np.lexsort((hashes, doc))
        a, d = hashes[order], doc[order]
        again = np.flatnonzero((a[1:] == a[:-1]) & (d[1:] == d[:-1])) + 1
        out.append(np.bincount(d[again], minlength=n) / words)
    ends_symbol = symbol[w.end - 1] if len(w.end) else np.zeros(0, bool)
    out.append(np.bincount(w.doc[ends_symbol], minlength=n) / words)
    caps = (raw[w.start] >= 65) & (raw[w.start] <= 90) if len(w.start) else np.zeros(0, bool)
    out.append(np.bincount(w.doc[caps], minlength=n) / words)
    single = (w.end - w.start) == 1
    out.append(np.bincount(w.doc[single], minlength=n) / words)
    lexical = np.bincount(w.doc * LEXICAL + (h >> np.uint64(58)).astype(np.int64), minlength=n * LEXICAL).reshape(n, LEXICAL) / words[:, None]
    return np.column_stack([*out, lexical]).astype(float)


N_CURVES = 7 + len(SYMBOLS) + 1 + 3 + 3
N_STATS = N_CURVES + LEXICAL


@dataclass
class Model:
    """Quantiles of each statistic, where its curve bends, and the weights."""

    knots: np.ndarray
    prior: float
    weights: np.ndarray

    def design(self, stats: np.ndarray) -> np.ndarray:
        """A one; each statistic and its excess over each knot, by the spread of its quantiles; the lexical classes."""
        curves, low, high = stats[:, :N_CURVES], self.knots[:, 0], self.knots[:, -1]
        spread = np.maximum(high - low, 1e-6)
        bent = [np.maximum(curves - k, 0) / spread for k in self.knots.T]
        x = np.column_stack([(curves - low) / spread, *bent])
        return np.column_stack([np.ones(len(stats)), np.clip(x, -8, 8), stats[:, N_CURVES:] * 8])

    def score(self, stats: np.ndarray) -> np.ndarray:
        """An even chance lands on THRESHOLD, so that cutting there makes the fewest mistakes."""
        g = self.design(stats) @ self.weights
        return 1 / (1 + np.exp(-np.clip(g + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def size_of_design() -> int:
    return 1 + N_CURVES * (1 + len(KNOTS)) + LEXICAL


def sums_of(x: np.ndarray, good: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What the risks need of some texts: (texts, positives, sums of l(-g) over both, of x over positives, of slopes
    over both, of curvature over all and over positives), flat. ``good``: which are positives; all are unlabelled."""
    g = np.clip(x @ w, -30, 30)
    s, loss = 1 / (1 + np.exp(-g)), np.logaddexp(0, g)
    p = x[good]
    bend = s * (1 - s)
    return np.concatenate([[len(x), len(p), loss.sum(), loss[good].sum()], p.sum(0), s @ x, s[good] @ p, ((x * bend[:, None]).T @ x).ravel(), ((p * bend[good][:, None]).T @ p).ravel()])


def _risk(sums: np.ndarray, w: np.ndarray, prior: float | None) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(risk, its part for negatives, slope, curvature) of summed rows; without a prior that of positives against unlabelled text."""
    d = len(w)
    n, m, lu, lp = sums[0], sums[1], sums[2] / sums[0], sums[3] / sums[1]
    xp, su, sp = sums[4 : 4 + d] / m, sums[4 + d : 4 + 2 * d] / n, sums[4 + 2 * d : 4 + 3 * d] / m
    hu, hp = sums[4 + 3 * d : 4 + 3 * d + d * d].reshape(d, d) / n, sums[4 + 3 * d + d * d :].reshape(d, d) / m
    penalty = np.full(d, RIDGE)
    penalty[0] = 1e-9
    ridge = float((penalty * w * w).sum() / 2)
    positive = lp - float(xp @ w)  # l(g) = l(-g) - g
    if prior is None:
        return positive + lu + ridge, lu, sp - xp + su + penalty * w, hp + hu + np.diag(penalty)
    negative = lu - prior * lp
    return prior * positive + negative + ridge, negative, su - prior * xp + penalty * w, hu + np.diag(penalty)


def minimise(sums, d: int, prior: float | None, w: np.ndarray | None = None, steps: int = STEPS) -> np.ndarray:
    """Newton's method on a risk; ``sums(w)`` gives the sums over all texts at ``w``.

    A step that does not lower the risk, or would make its part for negatives less than zero, is halved.
    """
    w = np.zeros(d) if w is None else w
    risk, negative, slope, bend = _risk(sums(w), w, prior)
    step, left = -np.linalg.solve(bend, slope), steps
    while left:
        left -= 1
        new = _risk(sums(w + step), w + step, prior)
        if new[0] <= risk and (new[1] >= 0 or new[1] >= negative):
            gain, w = risk - new[0], w + step
            risk, negative, slope, bend = new
            if gain < 1e-5 * max(abs(risk), 1e-3):
                break
            step = -np.linalg.solve(bend, slope)
        else:
            step = step / 2
    return w


def prior_of(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The class prior from counts of scores in ascending bins: the least ratio of the shares above a cut."""
    above = lambda x: np.cumsum(x[::-1])[::-1] / max(x.sum(), 1)
    u, p = above(unlabelled), above(positive)
    at = p >= LEAST_SHARE
    return float(np.clip((u[at] / p[at]).min(initial=1.0), 0.02, 0.98))


def _stats(batches):
    for batch in batches:
        for part in slices(batch):
            s = statistics(part)
            yield pa.RecordBatch.from_arrays([part.batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(s.astype(np.float32).ravel()), s.shape[1]).cast(pa.list_(pa.float32()))], names=["doc_id", "stats"])


def _partial(model: Model, w: np.ndarray):
    """(label, stats) -> this task's sums at ``w``."""

    def run(batches):
        total = None
        for batch in batches:
            stats = batch.column(1).flatten().to_numpy().reshape(-1, N_STATS).astype(float)
            if len(stats):
                part = sums_of(model.design(stats), batch.column(0).to_numpy() == 1, w)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
    return pa.table({"part": table.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _binned(model: Model):
    """(label, stats) -> counts of scores by bin, of all texts and of positives."""

    def run(batches):
        counts = np.zeros((2, BINS), np.int64)
        for batch in batches:
            stats = batch.column(1).flatten().to_numpy().reshape(-1, N_STATS).astype(float)
            at = np.minimum((model.score(stats) * BINS).astype(int), BINS - 1)
            good = batch.column(0).to_numpy() == 1
            counts += np.stack([np.bincount(at, minlength=BINS), np.bincount(at[good], minlength=BINS)])
        bins = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(counts[0][bins]), pa.array(counts[1][bins])], names=["bin", "n", "good"])

    return run


def train_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> Model:
    """Fit on all rows outside the held-out fold: those with a label of 1 in ``labels`` (doc_id, quality) are the
    positives, and all of them the unlabelled text.

    Null texts count as empty, rows without an id are left out; an id with labels of both kinds is no positive.
    Without positives, or without texts, every text gets one score, that of an even prior.
    """
    base = pick(docs, "doc_id", "text").where(F.col("doc_id").isNotNull()).where(is_training("doc_id", folds, held))
    known = pick(labels, "doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(is_training("doc_id", folds, held))
    good = known.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id", F.lit(1).cast("long").alias("label"))
    # The label travels as the key, since the statistics' pass reads an id and a text.
    marked = base.join(maybe_broadcast(good, 16), "doc_id", "left").select(F.coalesce("label", F.lit(-1)).alias("doc_id"), "text")
    stats = stored(marked.mapInArrow(_stats, "doc_id long, stats array<float>"))
    at = stats.select(*[F.get("stats", F.lit(k)).alias(f"s{k}") for k in range(N_CURVES)], "doc_id")
    found = at.agg(*[F.percentile_approx(f"s{k}", F.array(*[F.lit(q) for q in KNOTS]), 1000) for k in range(N_CURVES)], F.count_if(F.col("doc_id") == 1)).first()
    if not found[N_CURVES]:
        return Model(np.zeros((N_CURVES, len(KNOTS))), 0.5, np.zeros(size_of_design()))
    model = Model(np.array([found[k] for k in range(N_CURVES)], float), 0.5, np.zeros(size_of_design()))

    tasks = stats.rdd.getNumPartitions()

    def sums(w: np.ndarray) -> np.ndarray:
        parts, left = stats.mapInArrow(_partial(model, w), "part int, sums binary"), tasks
        while left > FAN_IN:
            parts = parts.withColumn("part", (F.col("part") / FAN_IN).cast("int")).groupBy("part").applyInArrow(_added, "part int, sums binary")
            left = -(-left // FAN_IN)
        return sum(np.frombuffer(r[0]) for r in parts.select("sums").collect())  # FAN_IN rows at most

    model.weights = minimise(sums, size_of_design(), None)
    counts = np.zeros((2, BINS), np.int64)
    for k, n, g in stats.mapInArrow(_binned(model), "bin long, n long, good long").groupBy("bin").agg(F.sum("n"), F.sum("good")).collect():  # BINS rows at most
        counts[:, k] = n, g
    model.prior = prior_of(*counts)
    model.weights = minimise(sums, size_of_design(), model.prior, model.weights)
    return model


def _score(model):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.batch.column(0), pa.array(model.score(statistics(part)))], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs``, whole texts; score rises with quality from 0 to 1.

    A null text counts as empty and gets the score of an empty text; repeated rows are scored each; a null
    doc_id stays null; an empty table gives an empty result; other columns are ignored. One narrow pass.
    """
    return pick(docs, "doc_id", "text").mapInArrow(_score(model), "doc_id long, score double")
