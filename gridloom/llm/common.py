"""Shared pieces of the training-data operators; stored tables and loops come from the library's plans."""

from __future__ import annotations

import ctypes
import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.iterate import components
from gridloom.plans.shared import shared_root, skew_safe_join, stored

__all__ = ["components", "shared_root", "skew_safe_join", "stored"]

#: A side of a join is broadcast only when a count has shown it to be under this many bytes.
BROADCAST_BYTES = 32 << 20


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ...: names that repeat or clash do no harm until ``toDF`` gives them back."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def column_of(docs: DataFrame, name: str) -> str:
    """The name in ``numbered(docs)`` of the column called ``name``, the first one if there are several."""
    return f"c{docs.columns.index(name)}"


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that extra columns with clashing names cannot interfere.

    A name that occurs more than once (a join's output, say) is taken by its first position.
    """
    return numbered(docs).select(*[F.col(column_of(docs, n)).alias(n) for n in names])


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it small; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def give_back() -> None:
    """Return memory that a worker's task has freed to the system: the worker lives on, with other tasks beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker: tokenizers are loaded once, not once a task."""
    name = "_gridloom_worker_cache"
    module = sys.modules.get(name)
    if module is None:
        module = sys.modules[name] = types.ModuleType(name)
        module.items = {}
    return module.items
