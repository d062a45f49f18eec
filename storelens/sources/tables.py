"""The retail sales view derived from the driver's star-schema tables.

``lineitem`` is the fact table (one sale per line); ``orders`` gives the
transaction date and flags, ``part`` the product (brand) and category (type),
``customer`` the temperature stand-in.  The same view is written once in SQL
(``SALES_VIEW_SQL``) so every query can be checked in DuckDB.

Scale notes: only the columns a query uses survive column pruning, a query that
names its columns joins only the tables they come from, and the filters on ``date`` are evaluated right above the scan of ``orders``.  Join
order is orders x customer first (both smaller than lineitem), then lineitem
(a sort-merge join on the order key, so the fact table is shuffled, never
broadcast), then part.  A dimension is broadcast only when its estimated size
is under ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks real sizes at
run time); at 100 TB every join is a sort-merge join on its key and the fact
rows are shuffled twice (order key, part key).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import season_of, week_of_month, with_calendar
from ..functions.numeric import with_margin, with_return_rate

# Canonical row order: unique on every scale factor of the driver data.
ORDER_COLS = ["date", "transaction_id", "line_no", "part_key", "supp_key", "total_sales"]

# Order priority -> weather condition.
PRIORITY_WEATHER = [
    ("1-URGENT", "Sunny"),
    ("2-HIGH", "Rainy"),
    ("3-MEDIUM", "Cloudy"),
    ("4-NOT SPECIFIED", "Snow"),
]
OTHER_WEATHER = "Stormy"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


FROM_PART = {"product_name", "category"}
FROM_CUSTOMER = {"temperature_c"}


def sales_view(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The base sales table (one row per line item) with the fixed column names.

    ``columns`` limits the view, and with it the tables that are joined: ``part``
    and ``customer`` are looked up (left joins: a sale with an unmatched key
    stays, its looked-up columns NULL) only when one of their columns is asked for.
    """
    wanted = None if columns is None else set(columns)
    li = read_table(spark, sf_dir, "lineitem")
    oc = read_table(spark, sf_dir, "orders")
    if wanted is None or wanted & FROM_CUSTOMER:
        cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
        oc = oc.join(cust, F.col("o_custkey") == F.col("c_custkey"), "left")
    else:
        oc = oc.withColumn("c_acctbal", F.lit(None).cast("double"))
    # The fact table is always streamed: size-only statistics multiply the sizes of
    # joined inputs, which would make a pruned lineitem look like the small side.
    j = li.join(oc.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "inner")
    if wanted is None or wanted & FROM_PART:
        part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
        j = j.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    else:
        j = j.withColumns({c: F.lit(None).cast("string") for c in ("p_brand", "p_type")})

    weather = None
    for prio, name in PRIORITY_WEATHER:
        cond = F.col("o_orderpriority") == prio
        weather = F.when(cond, name) if weather is None else weather.when(cond, name)
    weather = weather.otherwise(OTHER_WEATHER)

    qty = F.col("l_quantity")
    price = F.try_divide(F.col("l_extendedprice"), qty)
    returned = F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("int")
    after = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    ok, pk, sk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    date = F.col("o_orderdate").cast("date")
    view = j.select(
        ok.alias("transaction_id"),
        ln.alias("line_no"),
        pk.alias("part_key"),
        sk.alias("supp_key"),
        date.alias("date"),
        F.col("p_brand").alias("product_name"),
        F.col("p_type").alias("category"),
        qty.cast("bigint").alias("quantity_sold"),
        price.alias("unit_price"),
        F.col("l_extendedprice").alias("total_sales"),
        F.round(F.col("l_discount") * F.lit(100.0)).cast("double").alias("discount_pct"),
        after.alias("total_after_discount"),
        (after - returned * price).alias("net_sales"),
        returned.alias("returned"),
        (F.lit(1) + (ok * 31 + pk * 17 + ln * 7) % 499).cast("bigint").alias("stock_after_sale"),
        weather.alias("weather"),
        (F.col("c_acctbal") / F.lit(200.0)).alias("temperature_c"),
        (F.lit(10) + (ok * 13 + pk * 7 + ln * 3) % 90).cast("int").alias("humidity_pct"),
        (((ok * 7 + sk * 11 + ln) % 5001).cast("double") / F.lit(100.0)).alias("precipitation_mm"),
        (((ok * 3 + pk * 5 + sk * 2) % 10001).cast("double") / F.lit(100.0)).alias("wind_speed_kmh"),
        F.when(F.col("o_orderstatus") == "P", "Yes").otherwise("No").alias("is_holiday"),
        F.when(F.weekday(date) >= 5, 1).otherwise(0).cast("int").alias("is_weekend"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).cast("int").alias("is_special_event"),
        season_of(date).alias("season"),
    )
    return view if wanted is None else view.select(*[c for c in view.columns if c in wanted])


def prepared(df: DataFrame, max_week: int = 4, date_col: str = "date") -> DataFrame:
    """B8 + calendar columns + margin/return rate: the frame every dashboard analysis after D1 uses."""
    return enriched(df.filter(week_of_month(F.col(date_col)) <= max_week), date_col)


def enriched(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Calendar columns without the week filter, and margin and return rate where their columns are there."""
    out = with_calendar(df, date_col)
    if {"net_sales", "total_sales"} <= set(df.columns):
        out = with_margin(out)
    return with_return_rate(out) if {"returned", "quantity_sold"} <= set(df.columns) else out


# The same view for DuckDB (tables pre-registered as views by name).
_WEATHER_SQL = " ".join(f"WHEN '{p}' THEN '{w}'" for p, w in PRIORITY_WEATHER)
SALES_VIEW_SQL = f"""
sales AS (
  SELECT
    l_orderkey AS transaction_id,
    l_linenumber AS line_no,
    l_partkey AS part_key,
    l_suppkey AS supp_key,
    CAST(o_orderdate AS DATE) AS date,
    p_brand AS product_name,
    p_type AS category,
    CAST(l_quantity AS BIGINT) AS quantity_sold,
    l_extendedprice / NULLIF(l_quantity, 0) AS unit_price,
    l_extendedprice AS total_sales,
    CAST(ROUND(l_discount * 100.0) AS DOUBLE) AS discount_pct,
    l_extendedprice * (1.0 - l_discount) AS total_after_discount,
    l_extendedprice * (1.0 - l_discount)
      - (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * (l_extendedprice / NULLIF(l_quantity, 0)) AS net_sales,
    CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS returned,
    CAST(1 + (l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 499 AS BIGINT) AS stock_after_sale,
    CASE o_orderpriority {_WEATHER_SQL} ELSE '{OTHER_WEATHER}' END AS weather,
    c_acctbal / 200.0 AS temperature_c,
    CAST(10 + (l_orderkey * 13 + l_partkey * 7 + l_linenumber * 3) % 90 AS INTEGER) AS humidity_pct,
    CAST((l_orderkey * 7 + l_suppkey * 11 + l_linenumber) % 5001 AS DOUBLE) / 100.0 AS precipitation_mm,
    CAST((l_orderkey * 3 + l_partkey * 5 + l_suppkey * 2) % 10001 AS DOUBLE) / 100.0 AS wind_speed_kmh,
    CASE WHEN o_orderstatus = 'P' THEN 'Yes' ELSE 'No' END AS is_holiday,
    CAST(CASE WHEN isodow(CAST(o_orderdate AS DATE)) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
    CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS INTEGER) AS is_special_event,
    CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter'
         WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Spring'
         WHEN month(o_orderdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN part ON l_partkey = p_partkey
),
enriched AS (
  SELECT *,
    dayname(date) AS day_of_week,
    CAST(isodow(date) - 1 AS INTEGER) AS day_number,
    CAST(weekofyear(date) AS INTEGER) AS iso_week,
    CAST(year(date) AS INTEGER) AS year,
    CAST(month(date) AS INTEGER) AS month,
    CAST(day(date) AS INTEGER) AS day,
    CAST(FLOOR((day(date) - 1) / 7.0) + 1 AS INTEGER) AS week_of_month,
    monthname(date) AS month_name,
    strftime(date, '%Y-%m') AS month_period,
    net_sales / NULLIF(total_sales, 0) AS profit_margin,
    CAST(returned AS DOUBLE) / NULLIF(CAST(quantity_sold AS DOUBLE), 0) * 100.0 AS return_rate_pct
  FROM sales
),
prepared AS (
  SELECT * FROM enriched WHERE week_of_month <= 4
)
"""


def with_sql(body: str) -> str:
    """Prefix a DuckDB query with the sales/enriched/prepared CTEs."""
    return "WITH RECURSIVE " + SALES_VIEW_SQL.strip() + "\n" + body
