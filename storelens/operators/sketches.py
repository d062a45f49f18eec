"""Mergeable sketches: quantiles of numeric columns (D14) and distinct counts (D22) in one pass, without a range or distinct shuffle.

A sketch is a few kilobytes per group whatever the number of rows.  Sketches are plain binary columns: they can be stored per
group (a day, a product) and merged for any union of groups later, so a new day's rows need only their own sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILE_K = 1024      # items of a quantile sketch's levels
RANK_ERROR = 0.01      # of the rows; a sketch of QUANTILE_K is within 0.3 % in 99 of 100 cases
DISTINCT_LG_K = 14     # 2 ** 14 registers of a distinct sketch
DISTINCT_ERROR = 3 * 1.04 / 2 ** (DISTINCT_LG_K / 2)   # three standard errors of a merged sketch


def column_sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: int = QUANTILE_K) -> DataFrame:
    """Per group and column one row: ``column, n, sum, sum_sq, lo, hi, sketch``; NULL values do not count.

    One aggregate for all columns, partial per task; a column without values has n = 0 and an empty sketch.
    """
    def state(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.sum(v).alias("sum"), F.sum(v * v).alias("sum_sq"),
                        F.min(v).alias("lo"), F.max(v).alias("hi"), F.kll_sketch_agg_double(v, k).alias("sketch"))
    states = df.groupBy(*by).agg(F.array(*[state(c) for c in cols]).alias("_states"))
    return states.select(*by, F.explode("_states").alias("_s")).select(*by, "_s.*")


def merge_sketches(sketches: DataFrame, by: Sequence[str] = (), k: int = QUANTILE_K) -> DataFrame:
    """The sketches of unions: rows of ``column_sketches`` merged per column and ``by``."""
    return sketches.groupBy(*by, "column").agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("sum_sq").alias("sum_sq"), F.min("lo").alias("lo"),
        F.max("hi").alias("hi"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantile(prob: float, sketch: str = "sketch") -> Column:
    """The estimated value at ``prob``; NULL if the column had no values."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(float(prob))))


def sketch_std(n: str = "n") -> Column:
    """The sample standard deviation from the sums; NULL below two values."""
    spread = F.greatest(F.col("sum_sq") - F.col("sum") * F.col("sum") / F.col(n), F.lit(0.0))
    return F.when(F.col(n) > 1, F.sqrt(spread / (F.col(n) - 1)))


def rank_check(df: DataFrame, estimates: DataFrame, error: float = RANK_ERROR) -> DataFrame:
    """Whether each estimate (``column, prob, estimate``) is a value whose true ranks reach within ``error`` of ``prob``.

    Returns ``column, prob, rows, within`` from one exact counting pass over ``df``; a few estimates per column
    are constants of that pass.
    """
    wanted = [(r["column"], r["prob"], r["estimate"]) for r in estimates.collect()]
    counts = []
    for c, prob, value in wanted:
        v = F.col(c).cast("double")
        below, upto, n = (F.sum((v < F.lit(value)).cast("long")), F.sum((v <= F.lit(value)).cast("long")), F.count(v))
        ok = (below <= (prob + error) * n) & (upto >= (prob - error) * n)
        counts.append(F.struct(F.lit(c).alias("column"), F.lit(float(prob)).alias("prob"), n.alias("rows"),
                               F.when(n > 0, F.coalesce(ok, F.lit(False))).alias("within")))
    return df.agg(F.array(*counts).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def distinct_sketches(df: DataFrame, value: str, by: Sequence[str], lg_k: int = DISTINCT_LG_K) -> DataFrame:
    """One row per group with the ``sketch`` of its distinct values; NULL values do not count."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def distinct_estimates(sketches: DataFrame, by: Sequence[str] = (), name: str = "estimate") -> DataFrame:
    """Estimated distinct values of any union of stored groups: sketches merged per ``by``."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))
