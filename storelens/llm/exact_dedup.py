"""Exact dedup by distributed MSD radix partitioning.

Documents are split by the bytes of their normalised text, most significant
first: one level groups the documents of a group by their next chunk of bytes,
and only groups with two or more documents go on.  A group is done when it is a
singleton or when its texts have ended; then they are equal byte by byte, and no
digest decides anything.  Chunks grow sixteenfold per level, so a text of n bytes takes
about log16(n / 64) levels, and each byte of a text is shuffled at most once per level
that its group survives; a text that nobody shares a start with is shuffled once.

Each level is a pre-aggregated count per (group, chunk) and a join with the keys
that occur twice.  Both sides of that join are stored tables, so a group that
holds a third of all rows is split by adaptive execution.

Defined results: null text counts as empty; equal texts are those identical
after deleting [\\x20\\x09-\\x0D]; of a group the row with the most code points
in its original text stays, then the smallest doc_id (null last), then one of
the repeated rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, store, text_or_empty

FIRST_BYTES = 64
GROWTH = 16


def normalised(text: Column) -> Column:
    """The text without the six white-space characters."""
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), WHITE, text)


def _split(rest: Column, width: int) -> dict[str, Column]:
    return {"_head": F.substring(rest, 1, width), "_ended": F.octet_length(rest) <= width}


def _repeated(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The keys that at least two rows have, with a new group number ``_next``."""
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return store(twice.select(*keys, F.monotonically_increasing_id().alias("_next")), name)


def exact_groups(docs: DataFrame, first_bytes: int = FIRST_BYTES, growth: int = GROWTH,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _chars, _sha, _row, _level, _group``: ``_group`` is null for a text that occurs once."""
    text = text_or_empty(text_col)
    norm = normalised(text)
    rows = docs.select(F.col(id_col).alias("_id"), F.length(text).cast("long").alias("_chars"),
                       F.sha2(norm, 256).alias("_sha"), F.encode(norm, "UTF-8").alias("_rest"))
    small = ["_id", "_chars", "_sha"]
    group: list[str] = []
    done: list[DataFrame] = []
    level, width = 0, first_bytes
    while True:
        cut = rows.withColumns(_split(F.col("_rest"), width))
        keys = [*group, "_head", "_ended"]
        twice = _repeated(cut, keys, f"radix-keys-{level}")
        # Always a merge join: the keys grow with the data, and adaptive execution can split a hot key of it.
        joined = cut.join(twice.hint("merge"), keys, "left")
        if level == 0:
            joined = joined.withColumn("_row", F.monotonically_increasing_id())
            small.append("_row")
        tail = F.when(F.col("_next").isNotNull() & ~F.col("_ended"),
                      F.expr(f"substring(_rest, {width + 1})"))
        split = store(joined.select(*small, F.col("_next").alias("_group"), tail.alias("_rest")),
                      f"radix-rows-{level}")
        done.append(split.filter(F.col("_rest").isNull())
                    .select(*small, F.lit(level).alias("_level"), "_group"))
        rows = split.filter(F.col("_rest").isNotNull())
        if twice.filter(~F.col("_ended")).isEmpty():
            return reduce(DataFrame.unionByName, done)
        group, level, width = ["_group"], level + 1, width * growth


def exact_dedup(docs: DataFrame, first_bytes: int = FIRST_BYTES, growth: int = GROWTH,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = exact_groups(docs, first_bytes, growth, id_col, text_col)
    first = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("u"),
                           F.col("_id").alias("id"), F.col("_row").alias("row")))
    grouped = rows.filter(F.col("_group").isNotNull())
    best = store(grouped.groupBy("_level", "_group").agg(first.alias("_best"), F.count(F.lit(1)).alias("_size"))
                 .select("_level", "_group", F.col("_best.id").alias("_keep"),
                         F.col("_best.row").alias("_keep_row"), "_size"), "radix-groups")
    many = grouped.join(best, ["_level", "_group"]).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_keep_row")).alias("kept"), F.col("_sha").alias("text_sha256"))
    once = rows.filter(F.col("_group").isNull()).select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    return once.unionByName(many)
