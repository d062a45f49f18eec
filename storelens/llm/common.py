"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import sys
import types
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# The six ASCII white-space characters of the contracts, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (``spark.checkpoint.dir``), different at every call."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the frame that reads it back.

    Cuts lineage like ``checkpoint()`` and survives lost executors, and Spark
    knows the written size, so it broadcasts the table only under
    ``spark.sql.autoBroadcastJoinThreshold``.  A join whose sides are both
    stored has a plain shuffle on each side, which adaptive execution can split
    when one key is hot.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on null-safe equality of ``keys``; the result has them once.  No other column may be on both sides."""
    renamed = right.withColumnsRenamed({k: f"_right{k}" for k in keys})
    cond = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_right{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_right{k}" for k in keys])


def worker_state(owner: str) -> dict:
    """A dictionary that a Python worker process keeps across its tasks, for bounded caches.

    A worker serves one stage after another: what other owners kept is dropped.
    """
    kept = sys.modules.setdefault("_storelens_worker", types.ModuleType("_storelens_worker")).__dict__.setdefault("caches", {})
    others = [k for k in kept if k != owner]
    for other in others:
        del kept[other]
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    return kept.setdefault(owner, {})
