"""Row-order primitives that scale: a global row number and k-row shifts.

pandas ``shift``/``pct_change`` are defined by row position inside a group.
The obvious Spark form, ``Window.partitionBy(product).orderBy(...)``, sends a
whole product to one task; with 25 products and one holding a third of the rows
that is one task sorting a third of the table.  Instead:

1. ``sequence_rows`` range-partitions on the full (group, order) key, which is
   unique, so the sampler splits even one hot group over many partitions.  Rows
   are sorted inside each partition, tagged with their position, and the
   frame is written as a reliable checkpoint (cuts lineage, survives executor
   loss, and pins the positions).  Per-partition row counts (one row per
   partition, a proven bound) give each partition's offset.
2. ``with_shifts`` cuts the sequence into fixed-size buckets, copies the last
   ``k`` rows of each bucket into the next one (and the first rows into the
   previous one for leads), and runs ``lag``/``lead`` in a window per bucket.
   Every task holds at most ``bucket_rows + k`` rows whatever the skew.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import literal_frame, materialize

_POS_BITS = 33  # monotonically_increasing_id = partition index << 33 | position in partition
SEQ = "_seq"


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sequence_rows(df: DataFrame, order_cols: Sequence[str], by: Sequence[str] = (),
                  partitions: int | None = None) -> tuple[DataFrame, int]:
    """Add ``_seq``: the 0-based position of each row in the (by, order) sort.

    Returns the frame and the total row count.  The order key should be unique;
    ties are broken by the checkpointed layout and are then fixed for good.
    """
    out, total, _ = _sequence(df, order_cols, by, partitions, ())
    return out, total


def _sequence(df: DataFrame, order_cols: Sequence[str], by: Sequence[str], partitions: int | None,
              null_counts: Sequence[str],
              write: Callable[[DataFrame], DataFrame] = materialize) -> tuple[DataFrame, int, dict[str, int]]:
    """``sequence_rows`` plus the NULL count of each ``null_counts`` column, taken
    from the same one-row-per-partition aggregate.  ``write`` stores the sorted rows."""
    spark = df.sparkSession
    keys = [*by, *order_cols]
    # Without an explicit count AQE may merge adjacent small range partitions;
    # merged partitions stay contiguous, so positions are still in key order.
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged = write(spread.sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), _POS_BITS)
    nulls_agg = [F.sum(F.col(c).isNull().cast("long")).alias(f"_null_{i}") for i, c in enumerate(null_counts)]
    per_part = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), *nulls_agg).collect()
    counts = sorted((r["_part"], r["_n"]) for r in per_part)
    nulls = {c: int(sum(r[f"_null_{i}"] or 0 for r in per_part)) for i, c in enumerate(null_counts)}
    offsets, running = [], 0
    for p, c in counts:
        offsets.append((int(p), running))
        running += int(c)
    schema = T.StructType([T.StructField("_part", T.LongType()), T.StructField("_off", T.LongType())])
    off_df = literal_frame(spark, offsets or [(0, 0)], schema)
    mask = (1 << _POS_BITS) - 1
    # One row per partition of the checkpoint: bounded by the partition count.
    out = (ranged.join(F.broadcast(off_df), part == F.col("_part"), "inner")
           .withColumn(SEQ, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(mask)))
           .drop("_mid", "_part", "_off"))
    return out, running, nulls


MAX_BUCKET_ROWS = 1_000_000  # the window operator buffers one whole bucket


def _bucket_size(total: int, halo: int, partitions: int, bucket_rows: int | None) -> int:
    if bucket_rows:
        size = bucket_rows
    else:
        size = min(max(math.ceil(total / max(partitions, 1)), 1024), MAX_BUCKET_ROWS)
    return max(size, 4 * halo + 1)


def with_shifts(df: DataFrame, order_cols: Sequence[str], by: Sequence[str] = (),
                shifts: Mapping[str, tuple[str, int]] | None = None,
                fill_forward: Sequence[str] = (), bucket_rows: int | None = None,
                keep_seq: bool = False, write: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """Add shifted copies of columns inside each ``by`` group in (by, order) order.

    ``shifts`` maps an output name to ``(source, k)``: ``k > 0`` takes the value
    ``k`` rows earlier (``lag``), ``k < 0`` the value ``-k`` rows later (``lead``);
    NULL when that row is outside the group, and for a row whose group is NULL
    in any ``by`` column (such rows belong to no group).  Sources listed in
    ``fill_forward`` are first forward-filled within the group (pandas pads
    before ``pct_change``); the filled value replaces the source column.
    ``write`` stores the sorted rows.
    """
    shifts = dict(shifts or {})
    seqd, total, nulls = _sequence(df, order_cols, by, None, list(fill_forward), write)
    back = max([k for _, k in shifts.values() if k > 0], default=0)
    fwd = max([-k for _, k in shifts.values() if k < 0], default=0)
    size = _bucket_size(total, back + fwd, _shuffle_partitions(df), bucket_rows)
    group: Column = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    in_group = reduce(Column.__and__, [F.col(c).isNotNull() for c in by], F.lit(True))

    bucket = F.floor(F.col(SEQ) / F.lit(size)).cast("long")
    data = seqd.withColumn("_bucket", bucket)
    gaps = [c for c in fill_forward if nulls.get(c, 0) > 0]
    if gaps:  # only columns that actually hold NULLs need the fill pass
        data = _forward_fill(data, gaps, list(by))

    pos = F.col(SEQ) - F.col("_bucket") * F.lit(size)
    targets = F.array(F.col("_bucket"))
    if back:
        targets = F.when(pos >= F.lit(size - back), F.concat(targets, F.array(F.col("_bucket") + 1))).otherwise(targets)
    if fwd:
        targets = F.when(pos < F.lit(fwd), F.concat(targets, F.array(F.col("_bucket") - 1))).otherwise(targets)
    spread = data.withColumn("_tb", F.explode(targets))

    w = Window.partitionBy("_tb").orderBy(SEQ)
    cols = {}
    for out, (src, k) in shifts.items():
        if k > 0:
            same, val = F.lag(group, k).over(w), F.lag(F.col(src), k).over(w)
        else:
            same, val = F.lead(group, -k).over(w), F.lead(F.col(src), -k).over(w)
        cols[out] = F.when((same == group) & in_group, val)
    res = spread.withColumns(cols).filter(F.col("_tb") == F.col("_bucket")).drop("_tb", "_bucket")
    return res if keep_seq else res.drop(SEQ)


def _forward_fill(data: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Forward-fill ``cols`` within each group, exactly, with bounded tasks.

    Inside a bucket a running ``last(ignorenulls)`` fills the gaps; a row still
    NULL takes the carry: the group's last non-NULL value from earlier buckets,
    read from a table with one row per (bucket, group) (at most buckets +
    groups rows).
    """
    keys = ["_bucket", *by]
    w_in = Window.partitionBy(*keys).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    local = data.withColumns({f"_ff_{c}": F.last(F.col(c), ignorenulls=True).over(w_in) for c in cols})

    per_bucket = data.groupBy(*keys).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(SEQ))).alias(f"_lb_{c}") for c in cols])
    w_carry = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_bucket") \
        .rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(*keys, *[
        F.last(F.col(f"_lb_{c}"), ignorenulls=True).over(w_carry).alias(f"_carry_{c}") for c in cols])
    joined = local.join(carry, keys, "left")
    return joined.withColumns({
        c: F.coalesce(F.col(f"_ff_{c}"), F.col(f"_carry_{c}")) for c in cols
    }).drop(*[f"_ff_{c}" for c in cols], *[f"_carry_{c}" for c in cols])
