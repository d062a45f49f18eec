"""Grouped sales analyses.

Every analysis is one ``groupBy().agg()``: Spark runs a partial aggregate in
each map task and shuffles only one row per key per task, so a hot key (one
product holding a third of the rows) costs one row per task, not a third of the
data.  Pivots use explicit value lists (no extra distinct job) and are written
as conditional aggregates.  Money sums use an exact decimal accumulator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import MONTH_NAMES, TEMPERATURE_LABELS, temperature_bin
from ..functions.numeric import half_even, money_sum, ratio
from ..session import attach, materialize


def _dec(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(24,6)")


def sales_by(df: DataFrame, key: str | Sequence[str], value: str = "total_sales",
             order: str | None = "desc", out: str = "total_sales") -> DataFrame:
    """Sum of ``value`` per key (NULL keys dropped), ordered by the sum, key as tie-break."""
    keys = [key] if isinstance(key, str) else list(key)
    not_null = F.lit(True)
    for k in keys:
        not_null = not_null & F.col(k).isNotNull()
    res = df.filter(not_null).groupBy(*keys).agg(money_sum(value).alias(out))
    if order == "desc":
        res = res.orderBy(F.col(out).desc(), *keys)
    elif order == "asc":
        res = res.orderBy(F.col(out).asc(), *keys)
    elif order == "key":
        res = res.orderBy(*keys)
    return res


def sales_by_day_of_week(df: DataFrame) -> DataFrame:
    """D1 (runs on the frame before the week-of-month filter)."""
    return sales_by(df, "day_of_week")


def sales_by_week_of_month(df: DataFrame) -> DataFrame:
    """Weeks 1-4 only (the prepared frame is already filtered)."""
    return sales_by(df.filter(F.col("week_of_month") <= 4), "week_of_month")


def sales_by_weather(df: DataFrame) -> DataFrame:
    """D3."""
    return sales_by(df, "weather")


def sales_by_holiday(df: DataFrame) -> DataFrame:
    """In key order."""
    return sales_by(df, "is_holiday", order="key")


def sales_by_discount(df: DataFrame) -> DataFrame:
    """Sales ascending."""
    return sales_by(df, "discount_pct", order="asc")


def sales_by_day_number(df: DataFrame) -> DataFrame:
    """Monday = 0."""
    return sales_by(df, "day_number", order="key")


def pivot_sales(df: DataFrame, row: str, col: str | Column, values: Sequence[str],
                names: Sequence[str] | None = None, value: str = "total_sales") -> DataFrame:
    """Sum of ``value`` per ``row`` x pivot value, 0 where a cell is empty.

    Conditional aggregation with an explicit value list: one pass, one shuffle,
    and a row for every ``row`` key even when none of its rows fall in a column.
    """
    pivot_col = F.col(col) if isinstance(col, str) else col
    names = list(names or values)
    aggs = [
        F.coalesce(F.sum(F.when(pivot_col == F.lit(v), _dec(value))).cast("double"), F.lit(0.0)).alias(n)
        for v, n in zip(values, names)
    ]
    return df.filter(F.col(row).isNotNull()).groupBy(row).agg(*aggs).orderBy(row)


def weather_temperature_sales(df: DataFrame) -> DataFrame:
    """Weather x temperature bin; rows outside every bin add to no column."""
    names = [label.lower() for label in TEMPERATURE_LABELS]
    return pivot_sales(df, "weather", temperature_bin("temperature_c"), TEMPERATURE_LABELS, names)


def _season_sums(df: DataFrame, seasons: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """Sales per (category, season), written once, and the season columns: those given, else those observed."""
    sums = materialize(df.filter(F.col("category").isNotNull()).groupBy("category", "season")
                       .agg(F.sum(_dec("total_sales")).alias("total_sales")))
    if seasons is None:
        seasons = sorted(r[0] for r in sums.select("season").filter("season IS NOT NULL").distinct().collect())
    return sums, list(seasons)


def seasonal_sales(df: DataFrame, seasons: Sequence[str] | None = None) -> DataFrame:
    """Category x season, a column for every season that occurs, in alphabetical order."""
    sums, names = _season_sums(df, seasons)
    return pivot_sales(sums, "category", "season", names, [s.lower() for s in names])


def seasonal_sales_change(df: DataFrame, seasons: Sequence[str] | None = None) -> DataFrame:
    """% change from the season column on the left (alphabetical by default, Q2).

    First column NULL; x/0 is NULL (Q7); x100 and half-even to 2 places.
    """
    sums, found = _season_sums(df, seasons)
    wide = pivot_sales(sums, "category", "season", found, [s.lower() for s in found])
    names = [s.lower() for s in found]
    cols = [F.col("category"), *[F.lit(None).cast("double").alias(n) for n in names[:1]]]
    for prev, cur in zip(names, names[1:]):
        cols.append(half_even((ratio(cur, prev) - F.lit(1.0)) * F.lit(100.0), 2).alias(cur))
    return wide.select(*cols)


def top_mean(df: DataFrame, key: str, value: str, n: int = 5, out: str | None = None) -> DataFrame:
    """Mean of ``value`` per key, largest first, key as tie-break, first ``n`` (with rank)."""
    out = out or value
    means = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias(out))
    top = means.orderBy(F.col(out).desc_nulls_last(), F.col(key)).limit(n)
    return with_rank(top, [F.col(out).desc_nulls_last(), F.col(key)])


def with_rank(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """1-based rank column on an already small (top-n) frame."""
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def return_rate_top5(df: DataFrame, n: int = 5) -> DataFrame:
    """Mean return rate % per product, top n."""
    return top_mean(df, "product_name", "return_rate_pct", n)


def current_stock_top5(df: DataFrame, n: int = 5) -> DataFrame:
    """Mean current stock per product, top n."""
    return top_mean(df.withColumnRenamed("stock_after_sale", "current_stock"),
                    "product_name", "current_stock", n)


def monthly_inventory_turnover(df: DataFrame) -> DataFrame:
    """Per calendar month (years pooled) sum(total) / mean(stock), half-even 2 places."""
    mean_stock = F.try_divide(F.sum("stock_after_sale").cast("double"),
                              F.count("stock_after_sale").cast("double"))
    return (df.filter(F.col("month").isNotNull()).groupBy("month")
            .agg(half_even(F.try_divide(money_sum("total_sales"), mean_stock), 2)
                 .alias("inventory_turnover_rate"))
            .orderBy("month"))


def profit_margin_by_product(df: DataFrame) -> DataFrame:
    """D12."""
    return (df.filter(F.col("product_name").isNotNull()).groupBy("product_name")
            .agg(F.avg("profit_margin").alias("profit_margin")).orderBy("product_name"))


def category_performance(df: DataFrame) -> DataFrame:
    """Quantity, sales and mean margin per category, sales descending."""
    return (df.filter(F.col("category").isNotNull()).groupBy("category")
            .agg(F.coalesce(F.sum("quantity_sold"), F.lit(0)).cast("bigint").alias("quantity_sold"),
                 money_sum("total_sales").alias("total_sales"),
                 F.avg("profit_margin").alias("profit_margin"))
            .orderBy(F.col("total_sales").desc(), "category"))


def total_and_average_sales(df: DataFrame, key: str, value: str = "total_sales") -> DataFrame:
    """D17a-e: total and mean sales per key, both half-even to 2 places."""
    total = money_sum(value)
    avg = F.try_divide(total, F.count(value).cast("double"))
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(half_even(total, 2).alias("total_sales"), half_even(avg, 2).alias("average_sales"))
            .orderBy(key))


def monthly_sales_over_year(df: DataFrame) -> DataFrame:
    """Per (year, month) totals, then per month the mean and the sum over years; calendar order."""
    per_year = (df.filter(F.col("date").isNotNull())
                .groupBy(F.year("date").alias("year"), F.month("date").alias("month_no"))
                .agg(F.sum(_dec("total_sales")).alias("monthly_total")))
    names = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.col("month_no"))
    return (per_year.groupBy("month_no")
            .agg(F.sum("monthly_total").cast("double").alias("_tot"), F.count(F.lit(1)).alias("_years"))
            .select(names.alias("month"),
                    half_even(F.col("_tot") / F.col("_years").cast("double"), 2).alias("average_monthly_sales"),
                    half_even("_tot", 2).alias("total_sales"),
                    F.col("month_no"))
            .orderBy("month_no").drop("month_no"))


def transaction_count(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct transactions (two-phase distinct aggregate, or HyperLogLog++)."""
    agg = F.approx_count_distinct("transaction_id") if approx else F.countDistinct("transaction_id")
    return df.agg(agg.cast("bigint").alias("transactions"))


def transaction_product_counts(df: DataFrame) -> DataFrame:
    """Rows per (transaction, product), long form."""
    return (df.filter(F.col("transaction_id").isNotNull() & F.col("product_name").isNotNull())
            .groupBy("transaction_id", "product_name").agg(F.count(F.lit(1)).cast("bigint").alias("rows")))


def monthly_product_sales(df: DataFrame) -> DataFrame:
    """Quantity per (product, YYYY-MM)."""
    return (df.filter(F.col("product_name").isNotNull() & F.col("date").isNotNull())
            .groupBy("product_name", F.date_format("date", "yyyy-MM").alias("month_period"))
            .agg(F.coalesce(F.sum("quantity_sold"), F.lit(0)).cast("bigint").alias("monthly_sales")))


def with_monthly_sales(df: DataFrame) -> DataFrame:
    """Attach the (product, month) quantity total to every row.

    The totals are counted and broadcast, or salted when there are many, so the rows are never dealt out by product and month.
    """
    monthly = monthly_product_sales(df).select(F.struct("product_name", "month_period").alias("_key"), "monthly_sales")
    keyed = df.withColumn("month_period", F.date_format("date", "yyyy-MM")).withColumn("_key", F.struct("product_name", "month_period"))
    out = attach(keyed, monthly, "_key")
    return out.select("product_name", "month_period", *[c for c in out.columns if c not in ("_key", "product_name", "month_period")])
