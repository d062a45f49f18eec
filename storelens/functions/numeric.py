"""Numeric column helpers: money arithmetic, guarded ratios, rounding.

Division uses ``try_divide`` everywhere: under ANSI mode a plain ``/`` by zero
raises, and the reference's inf/NaN would poison means.  x/0 is NULL here and
NULLs are skipped by ``avg`` (documented policy Q7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b with NULL for a zero or NULL divisor."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def pct_change(current: str | Column, previous: str | Column) -> Column:
    """(current / previous - 1) as a fraction; NULL when previous is 0 or NULL."""
    return ratio(current, previous) - F.lit(1.0)


def half_even(x: str | Column, digits: int = 2) -> Column:
    """Round half to even on the binary value, as numpy does (rint(x*10^n)/10^n)."""
    x = _c(x).cast("double")
    if digits == 0:
        return F.rint(x)
    scale = float(10 ** digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def sanitize(x: str | Column) -> Column:
    """NaN, +-inf and NULL become 0, otherwise round half-even to a long."""
    x = _c(x).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0)).otherwise(F.rint(x)).cast("long")


def percent(x: str | Column) -> Column:
    """H13."""
    return _c(x) * F.lit(100.0)


def money_sum(x: str | Column) -> Column:
    """Exact sum of a money column with up to six decimals: summed as DECIMAL(24,6), returned as double.

    Float sums depend on task order; the decimal accumulator makes the answer
    independent of partitioning.  An all-NULL group sums to 0 (pandas rule).
    """
    return F.coalesce(F.sum(_c(x).cast("decimal(24,6)")).cast("double"), F.lit(0.0))


def with_money(df: DataFrame) -> DataFrame:
    """Total, after-discount and net sales from quantity, price, discount and returns."""
    total = F.col("quantity_sold") * F.col("unit_price")
    after = total * (F.lit(1.0) - F.col("discount_pct") / F.lit(100.0))
    return df.withColumns({
        "total_sales": total,
        "total_after_discount": after,
        "net_sales": after - F.col("returned") * F.col("unit_price"),
    })


def with_margin(df: DataFrame) -> DataFrame:
    """Profit margin = net / total."""
    return df.withColumn("profit_margin", ratio("net_sales", "total_sales"))


def with_return_rate(df: DataFrame) -> DataFrame:
    """Returned / quantity x 100."""
    return df.withColumn("return_rate_pct", percent(ratio("returned", "quantity_sold")))


def projected_stock(stock: str | Column, predicted: str | Column) -> Column:
    """Current stock minus predicted sales, rounded half-even."""
    return F.rint(_c(stock) - _c(predicted))


def lookup(df: DataFrame, col: str, mapping: dict, out: str | None = None, default=None) -> DataFrame:
    """Dictionary lookup of a small, fixed mapping as a literal map (no join, no shuffle).

    Mappings that grow with the data belong in a table joined on the key instead.
    """
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    value = F.try_element_at(F.create_map(*pairs), F.col(col)) if pairs else F.lit(None)
    if default is not None:
        value = F.coalesce(value, F.lit(default))
    return df.withColumn(out or f"{col}_mapped", value)
