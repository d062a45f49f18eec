"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

EDGES_PER_TASK = 50_000


def _stars(edges: DataFrame, tasks: int) -> DataFrame:
    """One round: larger neighbours are hung on the least neighbour, then the rest on the least of all."""
    both = edges.union(edges.select("v", "u"))
    least = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w")
                  .coalesce(tasks), "least")
    large = store(both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w"))
                  .select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks), "large-star")
    least = store(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w").coalesce(tasks), "least")
    hung = large.join(least, F.col("u") == F.col("w"))
    small = hung.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")) \
        .union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return store(small.distinct().coalesce(tasks), "small-star")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v`` (longs); ``root`` is the least node of the component.

    A node with very many neighbours is a pre-aggregated minimum and one side of
    a join of stored tables, which adaptive execution can split; a star of any size takes
    two rounds.  Tasks follow the number of edges.
    """
    e = store(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
              .distinct(), "edges")
    state = _state(e)
    while state[0]:
        tasks = 4 + state[0] // EDGES_PER_TASK
        e = _stars(e, tasks)
        after = _state(e)
        if after == state:
            break
        state = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
