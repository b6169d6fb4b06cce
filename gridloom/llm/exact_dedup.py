"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Each partition of the input sends its sorted distinct 64-bit fingerprints, as Golomb-Rice coded gaps, to
   the owners of their ranges, and keeps with each message the ids behind it (its receipt).
2. An owner decodes what it gets and answers each message with a bitmap of the fingerprints that more than
   one partition sent.
3. Partitions look their bits up. Rows whose fingerprint was marked, or repeats inside its partition, are
   suspects; only their texts are shuffled, and compared byte by byte by grouping on the text itself.

A fingerprint of a third of all rows is sent once by each partition, and the grouping has map-side partial
sums, so no task gathers a hot group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import maybe_broadcast, pick, skew_safe_join, stored, text_of


def golomb_encode(values: np.ndarray, span: int) -> bytes:
    """Golomb-Rice code of the gaps between sorted distinct values below ``span``.

    The quotients stand in unary, then the remainders with a fixed number of bits; the first five bytes are
    the count and that number.
    """
    n = len(values)
    if n == 0:
        return b"\0" * 5
    gaps = np.diff(values, prepend=values[:1] * 0).astype(np.uint64)
    bits = min(63, max(0, int(span // n).bit_length() - 1))
    quotient = (gaps >> np.uint64(bits)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + n, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return n.to_bytes(4, "little") + bytes([bits]) + np.packbits(np.concatenate([unary, low.ravel()])).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    n, bits = int.from_bytes(data[:4], "little"), data[4]
    if n == 0:
        return np.zeros(0, np.uint64)
    flat = np.unpackbits(np.frombuffer(data, np.uint8, offset=5))
    # The n-th one ends the unary part. Remainders may hold ones too, hence the first n.
    ones = np.flatnonzero(flat)[:n]
    quotient = np.diff(ones, prepend=-1) - 1
    low = flat[ones[-1] + 1 : ones[-1] + 1 + n * bits].reshape(n, bits).astype(np.uint64)
    rest = (low << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if bits else np.zeros(n, np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(bits)) + rest)


#: Fingerprints that one owner answers for, on average, at most.
OWNER_ROWS = 1 << 20


def _send(owners: int):
    step = (1 << 64) // owners + 1

    def run(batches):
        ids, prints = [], []
        for batch in batches:  # sixteen bytes a row: a partition's receipt
            ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            prints.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        if not ids:
            return
        doc, h = np.concatenate(ids), np.concatenate(prints)
        order = np.argsort(h, kind="stable")
        doc, h = doc[order], h[order]
        task = TaskContext.get().partitionId()
        cuts = np.searchsorted(h, np.array([min(k * step, (1 << 64) - 1) for k in range(owners)], np.uint64))
        rows = []
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(h)])):
            if a < b:
                distinct, where = np.unique(h[a:b], return_inverse=True)
                rows.append((task, k, golomb_encode(distinct - np.uint64(k * step), step), doc[a:b].tobytes(), where.astype("<u4").tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["task", "owner", "message", "ids", "places"])

    return run


def _answer(key, table):
    """All messages to one owner -> a bitmap for each."""
    messages = [golomb_decode(m.as_py()) for m in table.column("message")]
    every, counts = np.unique(np.concatenate(messages), return_counts=True)
    shared = every[counts > 1]
    bitmaps = [np.packbits(np.isin(m, shared, assume_unique=True)).tobytes() for m in messages]
    return pa.table({"task": table.column("task"), "owner": table.column("owner"), "bitmap": pa.array(bitmaps, pa.binary())})


def _suspects(batches):
    """(message's ids, places, bitmap) -> ids of suspects."""
    for batch in batches:
        out = []
        for ids, places, bitmap in zip(*(batch.column(i).to_pylist() for i in range(3))):
            at = np.frombuffer(places, "<u4")
            marked = np.unpackbits(np.frombuffer(bitmap, np.uint8))[at].astype(bool) | (np.bincount(at)[at] > 1)
            out.append(np.frombuffer(ids, np.int64)[marked])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], names=["fingerprint_id"])


def exact_dedup(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """Mark exact copies among ``docs`` (doc_id, text); of equal texts the largest doc_id stays.

    Returns one row per row of ``docs``: doc_id, keep_id, group_size (long), kept, text_sha256 (of UTF-8).
    Texts are equal when their bytes are; a null text counts as empty. Repeated rows with one doc_id are
    copies like others: one of them is kept. Rows with a null doc_id are kept only where all ids of a group
    are null, one of them; keep_id is then null. An empty table gives an empty result; other columns are
    ignored. ``owners``: ranges of the exchange, by default one for OWNER_ROWS rows, and the number of shuffle
    partitions at least, so what an owner decodes at once is bounded.
    """
    spark = docs.sparkSession
    total = docs.count()
    owners = owners or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // OWNER_ROWS))
    base = pick(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    # Rows are told apart by a hash of the id: ids may be null or repeat, and all rows of an id are suspects together.
    row_id = F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull())
    sent = stored(base.select(row_id.alias("row"), F.xxhash64("text").alias("h")).mapInArrow(_send(owners), "task int, owner int, message binary, ids binary, places binary"))
    answers = sent.select("task", "owner", "message").groupBy("owner").applyInArrow(_answer, "task int, owner int, bitmap binary")
    suspects = stored(
        sent.select("task", "owner", "ids", "places").join(answers, ["task", "owner"]).select("ids", "places", "bitmap").mapInArrow(_suspects, "fingerprint_id long").distinct()
    )
    texts = base.withColumn("fingerprint_id", row_id).join(maybe_broadcast(suspects, 16), "fingerprint_id", "left_semi")
    # Grouping by the text compares bytes; copies inside a partition fall together before the shuffle.
    groups = stored(
        texts.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") > 1).select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    rows = base.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    joined = skew_safe_join(rows, groups, ["text_sha256"], "group_size", max(total, 1), "left")
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    out = joined.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), size.alias("group_size"), "text_sha256")
    return _one_kept(out)


def _one_kept(out: DataFrame) -> DataFrame:
    """kept is true for the row whose doc_id is keep_id; should rows repeat that id, for one of them."""
    is_keep = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    again = stored(out.where(is_keep & (F.col("group_size") > 1)).groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("doc_id"), F.max("group_size").alias("group_size")).where("n > 1"))
    if again.isEmpty():
        return out.select("doc_id", "keep_id", "group_size", is_keep.alias("kept"), "text_sha256")
    keys = again.select("text_sha256", F.col("group_size").alias("_size"), F.lit(True).alias("_twice"))
    marked = skew_safe_join(out, keys, ["text_sha256"], "_size", again.agg(F.sum("group_size")).first()[0]).withColumn("_twice", F.coalesce("_twice", F.lit(False)) & is_keep)
    single = marked.where(~F.col("_twice")).select("doc_id", "keep_id", "group_size", is_keep.alias("kept"), "text_sha256")
    twice = again.select("doc_id", F.col("doc_id").alias("keep_id"), "group_size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"), "text_sha256").select("doc_id", "keep_id", "group_size", (F.col("k") == 1).alias("kept"), "text_sha256")
    return single.unionByName(twice)
