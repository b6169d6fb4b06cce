"""Tables in the folder that a cluster shares, and joins that survive hot keys.

Nothing here keeps state on an executor's disk. Tables that cut lineage go to the folder named by
``spark.checkpoint.dir`` (read from the session; another one is used only where it is unset), so a lost
executor costs the tasks it ran and nothing else.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more than 1/HOT_PARTS of all rows are hot; there are fewer than HOT_PARTS of them.
HOT_PARTS = 1000

_roots: dict[str, str] = {}
_scratch: dict[str, list[str]] = {}
_inside: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """A folder of this session below ``spark.checkpoint.dir``; removed when the driver ends.

    Where that is unset, a local session (tests) gets a temporary folder; any other one fails, since no folder is known
    to be shared.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    app = context.applicationId
    if app not in _roots:
        if not base:
            # A cluster in one machine's processes is a cluster all the same.
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
            base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
            context.setCheckpointDir(base)
        _roots[app] = f"{base.rstrip('/')}/gridloom-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _roots[app])
    return _roots[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this session, if it is still there."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the gateway may be gone by then; the folder is the cluster's scratch
        pass


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later plans start from the files."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{uuid.uuid4().hex}"
    if spark.sparkContext.applicationId in _inside:
        _scratch[spark.sparkContext.applicationId].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(docs: DataFrame):
    """Tables stored inside go when the next such block begins, and shuffles that nothing refers to with them.

    What a block returns must be written before the next one begins. If ``docs`` still reads such a table, all of them
    stay. Tables stored outside of such blocks stay until the driver ends.
    """
    spark = docs.sparkSession
    shared_root(spark)
    app = spark.sparkContext.applicationId
    held = _scratch.setdefault(app, [])
    names = {path.rsplit("/", 1)[1] for path in held}
    if names and not any(part in names for f in docs.inputFiles() for part in f.split("/")[-2:]):
        for path in held:
            remove(spark, path)
        held.clear()
        spark.sparkContext._jvm.System.gc()
    _inside.add(app)
    try:
        yield
    finally:
        _inside.discard(app)


#: A side of a join is broadcast only when a count has shown it to be under this many bytes.
BROADCAST_BYTES = 32 << 20


def checked_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it small; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def skew_safe_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "left") -> DataFrame:
    """Join ``rows`` with one row per key of ``groups`` although a key may hold a third of ``rows``.

    ``size`` is the column of ``groups`` that counts the key's rows in ``rows``; ``total`` is their sum over
    all keys at least. Keys above ``total / HOT_PARTS`` are fewer than HOT_PARTS, which bounds what is
    broadcast for them; all other keys are small and meet in a shuffle.
    """
    cut = max(total // HOT_PARTS, 1)
    values = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(size) > cut).withColumn("_hot", F.lit(True))
    cold = groups.where(F.col(size) <= cut)
    marked = rows.join(F.broadcast(hot), keys, "left")
    in_hot = marked.where(F.col("_hot")).drop("_hot")
    rest = marked.where(F.col("_hot").isNull()).drop("_hot", *values)
    return in_hot.unionByName(rest.join(cold, keys, how))
