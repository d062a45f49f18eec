"""Ordered operators (E1-E4, E6-E8) and the analyses built on them.

Row order is explicit: every function takes ``order_cols`` (a unique key).
Shifts go through ``sequence.with_shifts`` (bucketed windows with a halo), so
no window is ever partitioned by product alone or left unpartitioned over the
whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_even, pct_change, ratio
from ..session import attach, materialize
from .sequence import with_shifts


def with_lags(df: DataFrame, order_cols: Sequence[str], lags: Sequence[int] = (1, 7, 14),
              lead: int | None = 7, by: str = "product_name", value: str = "quantity_sold",
              write: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """E1 + E2: ``sales_lag_k`` = value k rows earlier in the product; ``future_{lead}_day_sales``
    = value ``lead`` rows later (a row count, not days: Q4)."""
    shifts = {f"sales_lag_{k}": (value, k) for k in lags}
    if lead:
        shifts[f"future_{lead}_day_sales"] = (value, -lead)
    return with_shifts(df, order_cols, [by], shifts, write=write)


def with_product_change(df: DataFrame, order_cols: Sequence[str], by: str = "product_name",
                        price: str = "unit_price", quantity: str = "quantity_sold") -> DataFrame:
    """E3 + B6: per product % change of price and quantity from the previous row
    (NULLs forward-filled first), and their ratio (quantity % / price %)."""
    shifted = with_shifts(df, order_cols, [by],
                          {"_prev_price": (price, 1), "_prev_qty": (quantity, 1)},
                          fill_forward=[price, quantity])
    return (shifted
            .withColumn("price_change_pct", pct_change(price, "_prev_price") * F.lit(100.0))
            .withColumn("quantity_change_pct", pct_change(quantity, "_prev_qty") * F.lit(100.0))
            .withColumn("price_sensitivity_ratio", ratio("quantity_change_pct", "price_change_pct"))
            .drop("_prev_price", "_prev_qty"))


def with_growth(df: DataFrame, order_cols: Sequence[str], periods: Sequence[int] = (7, 30),
                by: Sequence[str] = (), value: str = "total_sales",
                names: Sequence[str] = ("weekly_growth", "monthly_growth")) -> DataFrame:
    """Change over ``p`` rows of the whole table (Q3: not per product, a fraction).

    ``by`` gives the per-group form.  The value is forward-filled first.
    """
    shifts = {f"_prev_{p}": (value, p) for p in periods}
    shifted = with_shifts(df, order_cols, list(by), shifts, fill_forward=[value])
    cols = {n: pct_change(value, f"_prev_{p}") for n, p in zip(names, periods)}
    return shifted.withColumns(cols).drop(*shifts.keys())


def with_group_mean(df: DataFrame, key: str, cols: Sequence[str], digits: int | None = 0,
                    prefix: str = "current_avg_") -> DataFrame:
    """The group mean of each column attached to every row (rounded half-even).

    Written as an aggregate joined back on the key, not a window over the key:
    the aggregate is partial per task, and the one-row-per-key result is counted
    and broadcast (or salted), so the rows are never dealt out by the key.
    """
    means = df.groupBy(key).agg(*[F.avg(c).alias(f"{prefix}{c}") for c in cols])
    if digits is not None:
        means = means.select(key, *[half_even(f"{prefix}{c}", digits).alias(f"{prefix}{c}") for c in cols])
    return attach(df, means, key)


def latest_per(df: DataFrame, key: str, order_cols: Sequence[str]) -> DataFrame:
    """The last row of each key in (order) order; ties broken by the full order key.

    ``max_by`` over a struct is a partial aggregate, so a hot key costs one row per task
    (planned as a sort aggregate: each task sorts its own rows by key first).
    """
    others = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order_cols]))
    return (df.filter(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_row"))
            .select(key, *[F.col(f"_row.{c}").alias(c) for c in others]))


def factor_codes(df: DataFrame, col: str, order_cols: Sequence[str], out: str | None = None) -> DataFrame:
    """The E8 code table: (value, code), codes by first appearance in row order.

    The first position of each value is a partial ``min`` aggregate (one row per
    value); the values are then numbered with the sequence primitive, so even a
    column with millions of distinct values is numbered in bounded tasks.
    """
    from .sequence import SEQ, sequence_rows

    out = out or f"{col}_code"
    first = (df.filter(F.col(col).isNotNull()).groupBy(col)
             .agg(F.min(F.struct(*[F.col(c) for c in order_cols])).alias("_first")))
    numbered, _ = sequence_rows(first, ["_first"])
    return numbered.select(col, F.col(SEQ).cast("int").alias(out))


def factorize(df: DataFrame, col: str, order_cols: Sequence[str], out: str | None = None) -> DataFrame:
    """Integer code by first appearance in row order; NULL is -1.

    The code table (one row per value) is counted and broadcast, or salted when it is large.
    """
    out = out or f"{col}_code"
    codes = factor_codes(df, col, order_cols, out)
    return attach(df, codes, col).withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


def growth_by_product(grown: DataFrame, key: str = "product_name") -> DataFrame:
    """Mean weekly and monthly growth per product, half-even 2 places."""
    return (grown.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(half_even(F.avg("weekly_growth"), 2).alias("weekly_growth"),
                 half_even(F.avg("monthly_growth"), 2).alias("monthly_growth"))
            .orderBy(key))


def price_sensitivity(changed: DataFrame, key: str = "product_name") -> DataFrame:
    """Mean price change %, quantity change % and sensitivity ratio per product."""
    return (changed.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.avg("price_change_pct").alias("price_change_pct"),
                 F.avg("quantity_change_pct").alias("quantity_change_pct"),
                 F.avg("price_sensitivity_ratio").alias("price_sensitivity_ratio"))
            .orderBy(key))


def promotion_candidates(sensitivity: DataFrame, rows: DataFrame, min_ratio: float = 1.0,
                         max_price_change: float = 0.0, n: int = 10,
                         key: str = "product_name") -> DataFrame:
    """Products with ratio > ``min_ratio`` and price change < ``max_price_change``,
    joined to the distinct (product, margin) pairs of the rows, largest margin first, top ``n``.

    ``rows`` needs the key and ``profit_margin``.  When they are the rows the
    sensitivity was computed from (``with_product_change`` carries further columns),
    pass that frame materialised, so the fact tables are joined once.  The pairs are
    de-duplicated with a partial aggregate (repeated pairs collapse inside each
    task before the shuffle), then a top-n.
    """
    # One row per product, referenced twice below: materialised so the windowed
    # sensitivity job runs once.
    picked = materialize(sensitivity.filter((F.col("price_sensitivity_ratio") > F.lit(min_ratio))
                                            & (F.col("price_change_pct") < F.lit(max_price_change))))
    pairs = rows.select(key, "profit_margin").join(picked.select(key), key, "left_semi").distinct()
    joined = picked.join(pairs, key, "inner")
    order = [F.col("profit_margin").desc_nulls_last(), F.col(key)]
    top = joined.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))
