"""Toxicity by class-conditional Kneser-Ney language models.

For each class (toxic, ordinary) an interpolated model of its words over a backoff that both share::

    P_c(w) = max(N1_c(. w) - D_c, 0) / N1_c(. .) + L_c * P(w)      L_c = D_c * T_c / N1_c(. .)
    P(w)   = N1(. w) / N1(. .)

N1(. w) counts the different words that stand before w in the whole corpus, labelled or not, N1_c those in
texts of class c; T_c words have any there, and D_c = n1 / (n1 + 2 n2) from the words with one and with two. So
an expression that neither class knows is as likely in both but for the weights L_c, and copies of a text
count once. (Word pairs of a class above this level made results on a split of the training rows worse: the
toxic class is too small for them.)

Words are counted exactly, each by a 64-bit hash, and so are the different words before them (44 bits tell
them apart): tasks send their distinct pairs, and one row a word is stored, a table that grows with the
vocabulary. Scoring needs the words of labelled texts alone. The most frequent of them, as many as HOT_WORDS,
go to every task; the rows of the others are joined to the texts that hold them. What is compared of a text
are length-normalised log-likelihood ratios: that of all its words, and that of its TELLING most toxic ones;
a logistic curve, rising in both, makes a score of them. It is fitted on one part of the labelled texts with
models of the others, so that it sees ratios as new texts have them; then the models take all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BROADCAST_BYTES, column_of, give_back, maybe_broadcast, numbered, pick, skew_safe_join, stored, text_of
from gridloom.llm.words import ALNUM, join_hash, mix, slices

#: Words whose counts go to every task (ROW_BYTES each); those of rarer words are joined in.
ROW_BYTES = 20
HOT_WORDS = BROADCAST_BYTES // ROW_BYTES
#: Words that a task holds before it sends their sums.
FLUSH_WORDS = 5 << 18
#: The most frequent words of about SPREAD_TEXTS texts have their pairs dealt to all buckets. This chooses where pairs
#: are counted, not what: any choice gives the same counts.
SPREAD_WORDS, SPREAD_TEXTS = 256, 2_000
#: Texts whose pairs one bucket holds, on average, at most.
BUCKET_TEXTS = 1 << 11
#: Bytes of a context: its hash, and below it MARKS bits that say which texts have the pair: ordinary and toxic
#: ones of the larger part, ordinary and toxic ones of the part that the curve is fitted on.
CONTEXT_BYTES, MARKS = 6, 4
#: One labelled text in so many is in the part for the curve.
CURVE_PART = 4
#: Labelled texts on which the curve is fitted, at most; chosen by a hash of their ids. Counts use all.
FIT_ROWS = 20_000
#: The words of a text that tell most of toxicity. Chosen on folds of the training rows alone (README has the figures): the
#: likelihoods of whole texts by themselves, or of their most toxic run of words, part the classes less well.
TELLING = 2
#: Discounts stay inside this range, whatever the counts of counts.
DISCOUNT_RANGE = (0.05, 0.95)
N_FEATURES = 3


class Grams:
    """Words of a slice, and which context stands before each; a text begins after a context of its own."""

    def __init__(self, part):
        w = part.words(ALNUM)
        self.doc, self.count, self.first, self.word = w.doc, w.count, w.first, w.hash
        self._firsts = w.first[w.count > 0]

    def context(self) -> np.ndarray:
        before = np.zeros_like(self.word)
        before[1:] = self.word[:-1]
        before[self._firsts] = 0
        return (before >> np.uint64(64 - 8 * CONTEXT_BYTES + MARKS)) << np.uint64(MARKS)


PACKED = "bucket int, words binary, pairs binary, contexts binary"
VOCABULARY = "word long, before long, a0 long, a1 long, c0 long, c1 long"
MARK_BITS = np.uint64((1 << MARKS) - 1)
COUNTS = ("before", "c0", "c1")


def _pairs(word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in the order of words, with the marks of all their places: words, contexts, where words begin."""
    order = np.lexsort((context, word))
    w, c = word[order], context[order]
    pair = np.ones(len(w), bool)
    pair[1:] = (w[1:] != w[:-1]) | (c[1:] >> np.uint64(MARKS) != c[:-1] >> np.uint64(MARKS))
    first = np.flatnonzero(pair)
    bits = np.bitwise_or.reduceat(c & MARK_BITS, first) if len(first) else c
    w, c = w[first], (c[first] & ~MARK_BITS) | bits
    new = np.ones(len(w), bool)
    new[1:] = w[1:] != w[:-1]
    return w, c, np.flatnonzero(new)


def _packed(held: list, buckets: int, spread: np.ndarray):
    """(words, contexts) -> for each bucket its words, how many pairs each has, and the pairs' contexts.

    A word's pairs are in one bucket, but those of the words in ``spread`` are dealt by their contexts.
    """
    word, context = (np.concatenate(x) for x in zip(*held))
    held.clear()
    bucket = _bucket(word, buckets)
    if len(spread):
        frequent = np.flatnonzero(spread[np.minimum(np.searchsorted(spread, word), len(spread) - 1)] == word)
        bucket[frequent] = _bucket(mix(word[frequent] ^ (context[frequent] >> np.uint64(MARKS))), buckets)
    order = np.argsort(bucket, kind="stable")
    there, at = np.unique(bucket[order], return_index=True)
    rows, size = [], 0
    for k, mine in zip(there.tolist(), np.split(order, at[1:])):
        if not len(mine):
            continue
        w, c, starts = _pairs(word[mine], context[mine])
        tails = c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CONTEXT_BYTES].tobytes()
        rows.append((k, w[starts].tobytes(), np.diff(np.append(starts, len(w))).astype("<u4").tobytes(), tails))
        size += len(tails)
        if size > 1 << 20:
            yield _messages(rows)
            rows, size = [], 0
    if rows:
        yield _messages(rows)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    out = key >> np.uint64(32)
    out *= np.uint64(buckets)
    out >>= np.uint64(32)
    return out.astype(np.int32)


def _messages(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "words", "pairs", "contexts"])


def _frequent(batches):
    """(text) -> each task's word counts."""
    for batch in batches:
        for part in slices(batch):
            word, n = np.unique(part.words(ALNUM).hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])


def _count(buckets: int, spread: np.ndarray, flush: int):
    """(text, mark or null) -> this task's pairs by bucket of words."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                g = Grams(part)
                mark = part.batch.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
                held.append((g.word, g.context() | mark[g.doc]))
                size += len(g.word)
                if size >= flush:
                    yield from _packed(held, buckets, spread)
                    size = 0
        if size:
            yield from _packed(held, buckets, spread)
        give_back()

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The pairs of one bucket -> a row for each of its words."""
    words = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("words")])
    n = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("pairs")])
    tails = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("contexts")]).reshape(-1, CONTEXT_BYTES)
    context = np.zeros((len(tails), 8), np.uint8)
    context[:, :CONTEXT_BYTES] = tails
    word, context, starts = _pairs(np.repeat(words, n), context.view("<u8").ravel())
    known = word[starts]
    held = {n: np.add.reduceat((context & np.uint64(m) != 0).astype(np.int64), starts) for n, m in (("a0", 1), ("a1", 2), ("c0", 5), ("c1", 10))}
    out = pa.table({"word": known.view(np.int64), "before": np.diff(np.append(starts, len(word)))} | held)
    del words, n, tails, word, context, starts, held
    give_back()
    return out


class Table:
    """Counts by word, from columns in any order; words may repeat with the same counts."""

    def __init__(self, word: np.ndarray, counts: list):
        self.word, first = np.unique(word, return_index=True)
        self.counts = [c[first] for c in counts]

    def find(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word stands, and whether it does."""
        if not len(self.word):
            return np.zeros(len(word), np.int64), np.zeros(len(word), bool)
        at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        return at, self.word[at] == word


@dataclass
class Models:
    """Counts of both classes and the shared backoff; ``tail`` has those of words beyond HOT_WORDS, if any."""

    hot: Table
    total: list
    discount: list
    weight: list
    contexts: int
    tail: DataFrame | None
    curve: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"tail": None}

    @staticmethod
    def of(vocabulary: DataFrame) -> Models:
        """``vocabulary``: (word, before, c0, c1)."""
        s = vocabulary.agg(*[F.sum(c).alias(c) for c in COUNTS], *[F.count_if(F.col(f"c{c}") == k).alias(f"c{c}_{k}") for c in (0, 1) for k in (1, 2)], *[F.count_if(F.col(f"c{c}") > 0).alias(f"t{c}") for c in (0, 1)]).first()
        total = [s["c0"] or 0, s["c1"] or 0]
        discount = [float(np.clip(s[f"c{c}_1"] / max(s[f"c{c}_1"] + 2 * s[f"c{c}_2"], 1), *DISCOUNT_RANGE)) for c in (0, 1)]
        # A class without words knows the backoff alone.
        weight = [discount[c] * s[f"t{c}"] / total[c] if total[c] else 1.0 for c in (0, 1)]
        known = vocabulary.where(F.col("c0") + F.col("c1") > 0)
        # Frequencies up to a bound: few rows.
        often = sorted(known.groupBy(F.least("before", F.lit(1 << 16)).alias("n")).count().collect(), reverse=True)
        upto = np.cumsum([r["count"] for r in often])
        fit = int(np.searchsorted(upto, HOT_WORDS, side="right"))
        least = often[fit - 1]["n"] if fit else 1 << 62
        hot = known.where(F.col("before") >= least).select("word", *COUNTS).toArrow()  # HOT_WORDS rows at most
        table = Table(hot.column("word").to_numpy().view(np.uint64), [hot.column(c).to_numpy().astype(np.int32) for c in COUNTS])
        tail = known.where(F.col("before") < least).select("word", *COUNTS) if fit < len(often) else None
        return Models(table, total, discount, weight, s["before"] or 0, tail)

    def counts(self, g: Grams, part) -> list[np.ndarray]:
        """Of every word: contexts in the corpus and in both classes; 0 if no labelled text has it."""
        out = [np.zeros(len(g.word), np.int64) for _ in COUNTS]
        tables = [self.hot]
        if "_tail" in part.batch.schema.names:
            rare = pc.list_flatten(part.batch.column("_tail"))
            tables.append(Table(rare.field("word").to_numpy(zero_copy_only=False).view(np.uint64), [rare.field(c).to_numpy(zero_copy_only=False) for c in COUNTS]))
        for table in tables:
            at, found = table.find(g.word)
            for o, c in zip(out, table.counts):
                o[found] = c[at[found]]
        return out

    def log_p(self, c: int, counts: list) -> np.ndarray:
        known = np.maximum(counts[1 + c] - self.discount[c], 0) / max(self.total[c], 1)
        return np.log(known + self.weight[c] * counts[0] / self.contexts)

    def ratios(self, g: Grams, part) -> np.ndarray:
        """log P_1 - log P_0 of every word."""
        counts = self.counts(g, part)
        # Words of no labelled text differ by the weights of the backoff only.
        ratio = np.full(len(g.doc), np.log(self.weight[1] / self.weight[0]))
        some = np.flatnonzero(counts[0])
        if len(some):
            counts = [c[some] for c in counts]
            ratio[some] = self.log_p(1, counts) - self.log_p(0, counts)
        return ratio

    def features(self, part) -> np.ndarray:
        """A one, the mean ratio of all words, and that of the TELLING most toxic ones; a wordless text counts as an unknown word."""
        g, n = Grams(part), part.rows
        out = np.full((n, N_FEATURES), np.log(self.weight[1] / self.weight[0]))
        out[:, 0] = 1
        if not len(g.doc):
            return out
        ratio = self.ratios(g, part)
        some = g.count > 0
        out[some, 1] = np.add.reduceat(ratio, g.first[some]) / g.count[some]
        order = np.lexsort((-ratio, g.doc))
        best = np.arange(len(ratio)) - np.repeat(g.first, g.count) < TELLING
        out[some, 2] = (np.bincount(g.doc[best], ratio[order][best], n) / np.clip(g.count, 1, TELLING))[some]
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """A logistic curve with a small ridge, by Newton's method with halved steps. The first column of ``x`` is ones."""
    center, scale = x.mean(0), x.std(0) + 1e-9
    center[0], scale[0] = 0, 1
    z = (x - center) / scale
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(v: np.ndarray) -> float:
        g = z @ v
        return float((np.logaddexp(0, g) - y * g).sum() + (penalty * v * v).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        while (new := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w, before, now = w + step, now, new
        if before - now < 1e-9 * max(1.0, before):
            break
    out = w / scale
    out[0] -= (out * center).sum()
    return out


def rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic curve that falls with neither ratio: one with the wrong sign is left out."""
    columns = list(range(x.shape[1]))
    while True:
        w = np.zeros(x.shape[1])
        w[columns] = logistic(x[:, columns], y)
        wrong = [k for k in columns[1:] if w[k] < 0]
        if not wrong:
            return w
        columns.remove(min(wrong, key=lambda k: w[k]))


def is_training(id_col: str, folds: int, held: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) != held


def _fit_rows(models):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                label = part.batch.column(1).to_numpy(zero_copy_only=False)
                f = models.value.features(part)
                yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), *[pa.array(f[:, k]) for k in range(N_FEATURES)]], names=["label", *[f"f{k}" for k in range(N_FEATURES)]])
        give_back()

    return run


def _rare(models):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                g = Grams(part)
                rare = ~models.value.hot.find(g.word)[1]
                doc, word = g.doc[rare], g.word[rare]
                _, first = np.unique(join_hash([doc.astype(np.uint64), word]), return_index=True)
                keys = [part.batch.column(k).take(pa.array(doc[first])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(word[first].view(np.int64))], names=["_a", "_b", "word"])

    return run


def _with_tail(rows: DataFrame, models: Models, shipped, text: str = "text") -> DataFrame:
    """``rows`` with a column ``_tail`` of the counts of their rarer words, if there are any beyond HOT_WORDS.

    Rows meet their words by two hashes of the text, which do not change when a task runs again; a text that a third of
    the rows repeat gets them by broadcast, as one of fewer than HOT_PARTS such texts.
    """
    if models.tail is None:
        return rows
    keyed = rows.withColumns({"_a": F.xxhash64(F.lit(1), text_of(text)), "_b": F.xxhash64(F.lit(2), text_of(text))})
    rare = keyed.select("_a", "_b", F.col(text).alias("text")).mapInArrow(_rare(shipped), "_a long, _b long, word long").distinct()
    times = stored(keyed.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")))
    found = rare.join(models.tail, "word").groupBy("_a", "_b").agg(F.collect_list(F.struct("word", *COUNTS)).alias("_tail"))
    total = times.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return skew_safe_join(keyed, found.join(times, ["_a", "_b"]), ["_a", "_b"], "_n", total).select(*rows.columns, "_tail")


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> Models:
    """Models of the whole corpus ``docs`` and of the labels (doc_id, toxic) outside the held-out fold.

    Counts come from all documents; the curve from FIT_ROWS labelled ones at most. Without two classes of
    labelled text the score is the share of toxic labels, or 0. Null texts count as empty; null ids have no
    label; of several labels of one id the highest counts, for every row of that id. Empty tables are allowed.
    """
    spark = docs.sparkSession
    base = pick(docs, "doc_id", "text")
    known = pick(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(is_training("doc_id", folds, held))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    n_known = known.count()
    curve = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(CURVE_PART)) == 0
    known = known.withColumn("curve", curve).withColumn("mark", (F.col("label") + 1) * F.when(curve, 4).otherwise(1))
    joined = base.join(maybe_broadcast(known, 24), "doc_id", "left").select("text", "label", "mark", "curve", "doc_id")
    total = base.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_TEXTS))
    few = base.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(-(-max(total, 1) // SPREAD_TEXTS))) == 0).select("text")
    often = few.mapInArrow(_frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(SPREAD_WORDS).select("word")
    spread = np.array([r[0] for r in often.collect()], np.int64)  # SPREAD_WORDS rows
    parts = joined.select("text", "mark").mapInArrow(_count(buckets, np.sort(spread.view(np.uint64)), FLUSH_WORDS), PACKED)
    counted = stored(parts.groupBy("bucket").applyInArrow(_merge, VOCABULARY))
    dealt = F.col("word").isin([int(w) for w in spread])
    sums = counted.where(dealt).groupBy("word").agg(*[F.sum(c).alias(c) for c in counted.columns[1:]])
    vocabulary = counted.where(~dealt).unionByName(sums)
    larger = Models.of(vocabulary.select("word", "before", F.col("a0").alias("c0"), F.col("a1").alias("c1")))
    scale = 1 << 20
    share = min(scale, int(scale * FIT_ROWS * CURVE_PART / max(n_known, 1)) + 1)
    chosen = joined.where(F.col("curve") & (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(scale)) < share))
    shipped = spark.sparkContext.broadcast(larger)
    got = _with_tail(chosen.select("text", "label"), larger, shipped).mapInArrow(_fit_rows(shipped), "label int, " + ", ".join(f"f{k} double" for k in range(N_FEATURES))).toArrow()  # FIT_ROWS rows
    # One set of tables at a time is held by the driver.
    shipped.destroy()
    del larger, shipped
    models = Models.of(vocabulary.select("word", *COUNTS))
    y = got.column("label").to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        models.curve = rising(np.stack([got.column(f"f{k}").to_numpy() for k in range(N_FEATURES)], 1), y)
    else:
        p = np.clip(y.mean() if len(y) else 0, 1e-6, 1 - 1e-6)
        models.curve = np.array([np.log(p / (1 - p)), *[0.0] * (N_FEATURES - 1)])
    return models


def scores(models: Models, part) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(models.features(part) @ models.curve, -30, 30)))


def _score(models):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                s = scores(models.value, part)
                yield pa.RecordBatch.from_arrays([part.batch.column(0), pa.array(s)], names=["doc_id", "score"])

    return run


def _keep(models, threshold: float, text: str, names: list):
    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield part.batch.select(names).filter(pa.array(scores(models.value, part) < threshold))
        give_back()

    return run


def score_toxicity(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, score) of every row of ``docs``, whole texts; score rises with toxicity from 0 to 1.

    A null text counts as empty and gets the score of an empty text; repeated rows are scored each; a null
    doc_id stays null; an empty table gives an empty result; other columns are ignored. One narrow pass,
    unless the labelled words are more than HOT_WORDS: then texts are shuffled once to meet their rarer words.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(models)
    return _with_tail(pick(docs, "doc_id", "text"), models, shipped).mapInArrow(_score(shipped), "doc_id long, score double")


def drop_toxic(docs: DataFrame, models: Models, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns.

    A null or empty text is judged like one of unknown words; repeated rows are judged each; an empty table
    gives an empty result. Columns with clashing names pass through; of two named ``text`` the first is read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(models)
    rows, text = numbered(docs), column_of(docs, "text")
    return _with_tail(rows, models, shipped, text).mapInArrow(_keep(shipped, threshold, text, rows.columns), rows.schema).toDF(*docs.columns)
