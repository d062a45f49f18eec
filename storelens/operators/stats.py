"""Descriptive statistics, correlations and regression metrics.

Moments and exact quartiles come from the counts of the distinct values of each
column (one pass, partial per task) and a running count over their range
partitions; correlations from one aggregate pass.  Only aggregates (a few
numbers per column, or per range partition and column) reach the driver.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import literal_frame, materialize
from ..sources.schema import columns_of_type
from .sketches import column_sketches, sketch_quantile, sketch_std

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need the libraries, not this package

STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
PROBS = [0.25, 0.5, 0.75]


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``_c`` (column number), ``_v`` (value as double), ``_n`` (rows), range-partitioned and sorted by
    (column, value), with ``_part``, the number of the range partition; written once.

    One pass over ``df``: each task counts its own values first, so a column
    with few values costs a few rows per task whatever the row count.
    """
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)
    ])).alias("_p")).select("_p._c", "_p._v").filter(F.col("_v").isNotNull())
    counts = pairs.groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    return materialize(counts.repartitionByRange("_c", "_v").sortWithinPartitions("_c", "_v")
                       .withColumn("_part", F.spark_partition_id()))


def _ranks(counts: DataFrame, wanted: dict[int, set[int]]) -> dict[tuple[int, int], float]:
    """The values at the given 0-based ranks of each column, from ``value_counts``.

    The driver sees one row per (partition, column) and the values found.  Only
    the partitions that hold a wanted rank are searched, each by a running count.
    """
    sizes = counts.groupBy("_part", "_c").agg(F.sum("_n").alias("_s")).collect()
    spots, before = [], {}
    for part, c, n in sorted((r["_part"], r["_c"], r["_s"]) for r in sizes):
        start = before.get(c, 0)
        spots += [(part, c, rank, rank - start) for rank in sorted(wanted.get(c, ())) if start <= rank < start + n]
        before[c] = start + n
    schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_c", T.IntegerType()),
                           T.StructField("_rank", T.LongType()), T.StructField("_at", T.LongType())])
    spot = literal_frame(counts.sparkSession, spots, schema)
    held = counts.join(F.broadcast(spot.select("_part", "_c").distinct()), ["_part", "_c"])  # a few rows per column
    upto = Window.partitionBy("_part", "_c").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    run = held.withColumn("_upto", F.sum("_n").over(upto))
    found = run.join(F.broadcast(spot), ["_part", "_c"]).filter(
        (F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_n")))
    return {(r["_c"], r["_rank"]): r["_v"] for r in found.select("_c", "_rank", "_v").collect()}


def _moments(counts: DataFrame, cols: Sequence[str]) -> dict[int, dict[str, float]]:
    """Count, mean, standard deviation, minimum and maximum of each column from its value counts."""
    first = {r["_c"]: r for r in counts.groupBy("_c").agg(
        F.sum("_n").alias("n"), F.sum(F.col("_v") * F.col("_n")).alias("s"), F.min("_v").alias("lo"),
        F.max("_v").alias("hi")).collect()}
    means = literal_frame(counts.sparkSession, [(c, r["s"] / r["n"]) for c, r in first.items()],
                          T.StructType([T.StructField("_c", T.IntegerType()), T.StructField("_m", T.DoubleType())]))
    d = F.col("_v") - F.col("_m")
    squares = {r["_c"]: r["q"] for r in counts.join(F.broadcast(means), "_c")  # one row per column
               .groupBy("_c").agg(F.sum(d * d * F.col("_n")).alias("q")).collect()}
    out = {}
    for i in range(len(cols)):
        r = first.get(i)
        n = int(r["n"]) if r else 0
        out[i] = {"count": float(n), "mean": r["s"] / n if n else None,
                  "std": math.sqrt(squares[i] / (n - 1)) if n > 1 else None,
                  "min": r["lo"] if n else None, "max": r["hi"] if n else None}
    return out


def quantiles(counts: DataFrame, sizes: Mapping[int, int], probs: Sequence[float] = PROBS) -> dict[tuple[int, float], float]:
    """Exact quantiles with linear interpolation (numpy/pandas default) from ``value_counts``, by (column, prob)."""
    spots = {(c, p): (n - 1) * p for c, n in sizes.items() if n for p in probs}
    wanted: dict[int, set[int]] = {}
    for (c, _), h in spots.items():
        wanted.setdefault(c, set()).update({math.floor(h), min(math.floor(h) + 1, sizes[c] - 1)})
    at = _ranks(counts, wanted)
    out = {}
    for (c, p), h in spots.items():
        lo, hi = at[(c, math.floor(h))], at[(c, min(math.floor(h) + 1, sizes[c] - 1))]
        out[(c, p)] = lo + (hi - lo) * (h - math.floor(h))
    return out


def describe_approx(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """D14 in one pass over wide, large tables: quartiles from mergeable quantile sketches, the other statistics exact.

    Rows and columns as of ``describe_numeric``; a quartile is a value of the column whose rank is within
    ``sketches.RANK_ERROR`` of the wanted one.  One aggregate, no shuffle of rows; one row per column reaches the driver.
    """
    cols = list(cols or columns_of_type(df, "numeric"))
    states = column_sketches(df, cols).select(
        "column", F.col("n").cast("double").alias("count"), (F.col("sum") / F.when(F.col("n") > 0, F.col("n"))).alias("mean"),
        sketch_std().alias("std"), F.col("lo").alias("min"), *[sketch_quantile(p).alias(f"{int(100 * p)}%") for p in PROBS],
        F.col("hi").alias("max")).collect()
    found = {r["column"]: r for r in states}
    rows = [tuple([stat, *[found[c][stat] for c in cols]]) for stat in STATS]
    schema = T.StructType([T.StructField("stat", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in cols])
    return literal_frame(df.sparkSession, rows, schema)


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Pandas ``describe()``: rows count, mean, std, min, 25%, 50%, 75%, max; one column per input.

    Exact at every size by one method: the value counts of all columns from one
    pass, then moments and ranks from those.  What reaches the driver is one row per column
    and per (range partition, column), never values of the data but the ranks asked for.
    ``approx`` is ``describe_approx``.
    """
    if approx:
        return describe_approx(df, cols)
    cols = list(cols or columns_of_type(df, "numeric"))
    counts = value_counts(df, cols)
    mom = _moments(counts, cols)
    quant = quantiles(counts, {i: int(m["count"]) for i, m in mom.items()})
    rows = []
    for stat in STATS:
        vals = [quant.get((i, int(stat[:-1]) / 100)) if stat.endswith("%") else mom[i][stat] for i in range(len(cols))]
        rows.append((stat, *[None if v is None else float(v) for v in vals]))
    schema = T.StructType([T.StructField("stat", T.StringType())]
                          + [T.StructField(c, T.DoubleType()) for c in cols])
    return literal_frame(df.sparkSession, rows, schema)


def _pearson(cov, va, vb):
    if cov is None or not va or not vb:
        return None  # too few rows, or a constant column
    return max(-1.0, min(1.0, cov / math.sqrt(va * vb)))


def _comoments(k: int):
    """Per task, of every pair of ``k`` columns over the rows that have both: their number, the mean and the centred sum
    of squares of the first, and the centred sum of products (four k x k matrices, one row)."""
    def merge(a, b):
        n = a[0] + b[0]
        d = b[1] - a[1]
        share = b[0] / np.maximum(n, 1.0)
        both = a[0] * share
        mean = np.where(a[0] > 0, a[1] + d * share, b[1])
        # Where one side has no rows, its numbers are 0 and the other's stand.
        return np.stack([n, mean, a[2] + b[2] + np.where(both > 0, d * d * both, 0.0),
                         a[3] + b[3] + np.where(both > 0, d * d.T * both, 0.0)])

    def some(x, i, j):
        """The numbers of columns ``i`` and ``j`` (lists) over whole rows, centred on the first row, so a constant has no spread."""
        out = np.zeros((4, len(i), len(j)))
        if len(x):
            d = x - x[0]
            mean = d.mean(axis=0)
            d -= mean
            out[0] = len(x)
            out[1] = (x[0] + mean)[i][:, None]
            out[2] = (d * d).sum(axis=0)[i][:, None]
            out[3] = d[:, i].T @ d[:, j]
        return out

    def add(batches):
        total = np.zeros((4, k, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            here = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            with np.errstate(invalid="ignore", over="ignore"):
                if here.all():
                    part = some(x, range(k), range(k))
                else:
                    part = np.zeros((4, k, k))
                    for i in range(k):
                        for j in range(i, k):
                            own = some(x[here[:, i] & here[:, j]][:, [i, j]], [0, 1], [0, 1])
                            part[:, i, j], part[:, j, i] = own[:, 0, 1], own[:, 1, 0]
                total = merge(total, part)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return add, merge


def _correlations(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """Pearson r of the given column pairs from one pass.

    A pair's numbers are over the rows where neither side is NULL (pandas' rule).  Each task returns one row: hundreds of
    running sums side by side in one aggregate are too long for compiled code, so they are matrices here.
    """
    k = len(cols)
    add, merge = _comoments(k)
    parts = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(add, "sums binary")
    total = np.zeros((4, k, k))
    for r in parts.collect():  # one row per task, four k x k matrices
        total = merge(total, np.frombuffer(r["sums"]).reshape(4, k, k))
    n, _, squares, products = total
    out = {}
    for i, j in pairs:
        if n[i, j] <= 1:
            out[(i, j)] = None
        elif i == j:
            out[(i, j)] = 1.0 if squares[i, i] else None
        else:
            out[(i, j)] = _pearson(float(products[i, j] / n[i, j]), float(squares[i, j] / n[i, j]), float(squares[j, i] / n[i, j]))
    return out


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r for every ordered pair (a, b) including the diagonal, long form; NULL for a constant column."""
    cols, k = list(cols), len(cols)
    r = _correlations(df, cols, [(i, j) for i in range(k) for j in range(i, k)])
    out = [(cols[i], cols[j], i * k + j, r[(min(i, j), max(i, j))]) for i in range(k) for j in range(k)]
    schema = T.StructType([T.StructField("col1", T.StringType()), T.StructField("col2", T.StringType()),
                           T.StructField("ordinal", T.IntegerType()), T.StructField("correlation", T.DoubleType())])
    return literal_frame(df.sparkSession, out, schema)


def sales_factor_correlation(df: DataFrame, target: str = "total_sales",
                             factors: Sequence[str] = ("day_number", "iso_week", "is_weekend", "weather_code",
                                                       "holiday_code", "discount_pct")) -> DataFrame:
    """Correlation of each factor (and the target itself) with the target, largest first, NULL last."""
    cols = [*factors, target]
    t = len(factors)
    r = _correlations(df, cols, [(i, t) for i in range(t + 1)])
    schema = T.StructType([T.StructField("factor", T.StringType()), T.StructField("correlation", T.DoubleType())])
    return literal_frame(df.sparkSession, [(c, r[(i, t)]) for i, c in enumerate(cols)], schema) \
        .orderBy(F.col("correlation").desc_nulls_last(), "factor")


def strength(r: Column) -> Column:
    """Strong > 0.7, Moderate > 0.5, Weak > 0.3 on |r| (strict); otherwise NULL."""
    a = F.abs(r)
    return F.when(a > 0.7, "Strong").when(a > 0.5, "Moderate").when(a > 0.3, "Weak")


def correlation_summary(df: DataFrame, cols: Sequence[str] | None = None, digits: int | None = None) -> DataFrame:
    """One line per ordered pair with |r| > 0.3, in the reference's loop order.

    ``digits`` optionally rounds r (half-even) before labelling and formatting.
    """
    cols = list(cols or columns_of_type(df, "numeric"))
    pairs = correlation_pairs(df, cols).filter(F.col("col1") != F.col("col2"))
    r = F.col("correlation")
    if digits is not None:
        from ..functions.numeric import half_even
        pairs = pairs.withColumn("correlation", half_even(r, digits))
    lab = strength(F.col("correlation"))
    return (pairs.withColumn("strength", lab).filter(F.col("strength").isNotNull())
            .withColumn("line", F.format_string("%s correlation between %s and %s: %.2f",
                                                F.col("strength"), F.col("col1"), F.col("col2"),
                                                F.col("correlation")))
            .orderBy("ordinal"))


# Fixed value: the text when there is nothing to correlate.
NO_NUMERIC = "No numeric data available for correlation analysis."


def correlation_summary_text(summary: DataFrame, empty: str = NO_NUMERIC) -> DataFrame:
    """The summary as one text (lines joined by newlines, each ending in a newline)."""
    lines = F.array_sort(F.collect_list(F.struct("ordinal", "line")))
    text = F.concat(F.array_join(F.transform(lines, lambda s: s["line"]), "\n"),
                    F.when(F.size(lines) > 0, F.lit("\n")).otherwise(F.lit("")))
    return summary.agg(text.alias("correlation_summary")).select(
        F.coalesce(F.col("correlation_summary"), F.lit(empty)).alias("correlation_summary"))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """MSE and R^2 = 1 - SSE/SST in one pass (SST from the stable population variance)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    both = df.filter(y.isNotNull() & p.isNotNull())
    mse = F.avg((y - p) * (y - p))
    return both.agg(mse.alias("mse"), (F.lit(1.0) - F.try_divide(mse, F.var_pop(y))).alias("r2"),
                    F.count(F.lit(1)).cast("bigint").alias("n"))
