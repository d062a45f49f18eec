"""Mixing sources to target weights by subset-sum budget fitting.

1. Count documents by (source, exact length); a hot source collapses to one row
   per distinct length.
2. A source whose target is ``r`` times its size takes every document
   ``floor(r)`` times.  The remaining budget is fitted on the length counts: a
   proportional share of every length, then the longest lengths that fit, then
   a bounded-knapsack dynamic program over the last few thousand words, which
   usually meets the budget exactly.
3. Of each (source, length) the plan says how many documents are taken once
   more; those are the ones with the smallest seeded hash.  The hash at the cut
   is found in two levels (1024 hash ranges, then the rows of one range), so a
   length that a third of all documents share is never ranked in one task.

Defined results: null or empty text has size 0 and takes no words; a null source
is a source of its own, last in order; an empty table gives no rows; repeated
rows are documents of their own; further columns are ignored here and kept by
``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, join_on, store, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 20240229
DP_WORDS = 16_384   # budget left to the dynamic program
_RANGE_BITS = 10    # hash ranges of the two-level cut


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    bare = F.btrim(text_or_empty(text), F.lit(WHITE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[ \\t-\\r]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``_source, _total, _target`` from (``_source``, ``_size``, ``_n``) counts.

    Sources by code point, null last, get the weights in turn and share all
    words; a target stops at ``max_epochs`` times the source, and the excess is
    shared again by weight.  With sources sorted by cap / weight this is one
    running sum: a source is capped when its cap is below its weight times the
    level that the sources before it leave.  One row per source.
    """
    ordered = Window.orderBy(F.col("_source").asc_nulls_last())
    rising = Window.orderBy("_ratio", F.col("_source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    table = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("_total"))
    t = t.withColumn("_w", F.get(table, (F.row_number().over(ordered) - 1) % len(weights)))
    t = t.withColumns({"_cap": F.col("_total") * float(max_epochs),
                       "_ratio": F.col("_total") * float(max_epochs) / F.col("_w")})
    t = t.withColumn("_level", (F.sum("_total").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                     / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    t = t.withColumn("_capped", F.col("_ratio") <= F.col("_level"))
    free = F.min(F.when(~F.col("_capped"), F.struct("_ratio", F.col("_source").isNull(), "_source", "_level"))).over(everything)
    return t.withColumn("_free", free["_level"]).select(
        "_source", "_total",
        F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * F.col("_free")).alias("_target"))


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length (at most ``counts``) give the largest sum that is at most ``budget``.

    Bounded knapsack with counts split into powers of two; the reachable sums
    are the bits of one integer, and the search ends when the budget is met.
    """
    items, reached = [], [1]
    mask = (1 << (budget + 1)) - 1
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        step, left = 1, min(count, budget // length)
        while left > 0 and not reached[-1] >> budget & 1:
            step = min(step, left)
            items.append((i, step))
            reached.append((reached[-1] | reached[-1] << length * step) & mask)
            left, step = left - step, step * 2
    take = np.zeros(len(lengths), dtype=np.int64)
    rest = reached[-1].bit_length() - 1
    for (i, step), before in zip(reversed(items), reversed(reached[:-1])):
        if not before >> rest & 1:
            take[i] += step
            rest -= int(lengths[i]) * step
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take, at most ``counts``, for ``budget`` words in all."""
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return take
    if budget >= total:
        return np.where(lengths > 0, counts, 0)
    usable = lengths > 0
    take[usable] = np.floor(counts[usable] * (budget / total)).astype(np.int64)
    rest = budget - int((take * lengths).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:  # the longest first, down to what the dynamic program takes
        if rest <= dp_words or not usable[i]:
            break
        more = min(int(counts[i] - take[i]), (rest - dp_words) // int(lengths[i]))
        take[i] += more
        rest -= more * int(lengths[i])
    for i in order:  # only lengths that overshoot the program's budget are left
        if rest <= 2 * dp_words:
            break
        if usable[i] and lengths[i] <= rest and take[i] < counts[i]:
            take[i] += 1
            rest -= int(lengths[i])
    fits = np.flatnonzero(usable & (lengths <= rest) & (take < counts))
    if rest > 2 * dp_words or not len(fits):
        return take
    fits = fits[np.argsort(-lengths[fits], kind="stable")]
    take[fits] += _knapsack(lengths[fits], counts[fits] - take[fits], rest)
    return take


def _plan(max_epochs: int):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_size", ignore_index=True)
        total, target = int(pdf["_total"].iloc[0]), float(pdf["_target"].iloc[0])
        base = min(int(target // total), max_epochs) if total else 0
        extra = np.zeros(len(pdf), dtype=np.int64)
        if total and base < max_epochs:
            extra = fit_budget(pdf["_size"].to_numpy(), pdf["_n"].to_numpy(), round(target - base * total))
        return pd.DataFrame({"_source": pdf["_source"], "_size": pdf["_size"], "_n": pdf["_n"], "_base": base,
                             "_extra": extra, "_total": total, "_target": target})
    return plan


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``_id, _source, _size, _total, _target, _times`` and the ``keep`` columns."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                       word_count(F.col(text_col)).alias("_size"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)],
                       F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(seed), "_id"))
    rows = store(rows, "mix-documents")
    counts = rows.groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_n"))
    targets = source_targets(counts, weights, max_epochs)
    fitted = join_on(counts, targets, ["_source"])
    plan = store(fitted.groupBy("_source").applyInPandas(
        _plan(max_epochs), "_source string, _size long, _n long, _base long, _extra long, _total long, _target double"),
        "mix-plan")

    # The hash at the cut of each (source, length) of which some documents are taken once more.
    part = plan.filter((F.col("_extra") > 0) & (F.col("_extra") < F.col("_n")))
    rng = F.shiftright(F.col("_hash"), 64 - _RANGE_BITS)
    keyed = rows.withColumn("_range", rng)
    per_range = keyed.groupBy("_source", "_size", "_range").agg(F.count(F.lit(1)).alias("_in"))
    upto = Window.partitionBy("_source", "_size").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    at_cut = join_on(per_range, part.select("_source", "_size", "_extra"), ["_source", "_size"])
    at_cut = at_cut.withColumn("_upto", F.sum("_in").over(upto)).filter(
        (F.col("_upto") >= F.col("_extra")) & (F.col("_upto") - F.col("_in") < F.col("_extra")))
    at_cut = store(at_cut.select("_source", "_size", "_range", (F.col("_extra") - (F.col("_upto") - F.col("_in"))).alias("_rank")),
                   "mix-ranges")
    inside = join_on(keyed.select("_source", "_size", "_range", "_hash", "_row"), at_cut, ["_source", "_size", "_range"])
    ranked = Window.partitionBy("_source", "_size").orderBy("_hash", "_row")
    cut = inside.withColumn("_at", F.row_number().over(ranked)).filter(F.col("_at") == F.col("_rank")).select(
        F.col("_source"), F.col("_size"), F.col("_hash").alias("_cut_hash"), F.col("_row").alias("_cut_row"))
    full = store(join_on(plan, cut, ["_source", "_size"], "left"), "mix-cuts")

    again = F.when(F.col("_extra") >= F.col("_n"), F.lit(True)).when(F.col("_extra") <= 0, F.lit(False)).otherwise(
        (F.col("_hash") < F.col("_cut_hash"))
        | ((F.col("_hash") == F.col("_cut_hash")) & (F.col("_row") <= F.col("_cut_row"))))
    return join_on(rows, full, ["_source", "_size"]).select(
        "_id", "_source", "_size", "_total", "_target",
        (F.col("_base") + again.cast("long")).alias("_times"), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken``: the words that the mix takes of each document."""
    p = mix_plan(docs, weights, max_epochs, seed, id_col, text_col, source_col)
    return p.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_total").alias("source_size"),
                    F.col("_target").alias("target"), (F.col("_size") * F.col("_times")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
                    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, columns unchanged.

    A document without words takes no part in the budget and stays once.
    """
    names = docs.columns
    p = mix_plan(docs, weights, max_epochs, seed, id_col, text_col, source_col, keep=names)
    times = F.when(F.col("_size") == 0, F.lit(1)).otherwise(F.col("_times")).cast("int")
    return p.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))).select(*names)
