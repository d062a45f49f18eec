"""Registered queries: each reads the driver tables and returns one DataFrame.

Every query has the same answer written as DuckDB SQL over the raw tables
(``oracle``) unless the operator is not expressible in SQL (k-means, model
fits); those are checked by invariants in ``tests/``.  Float means of ratios are
rounded to 6 places (half-even on the binary value) on both sides so the value
hash does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import half_even, lookup, projected_stock, sanitize, with_money
from ..operators import sales as S
from ..session import literal_frame, materialize, materialize_packed, release
from ..sources.tables import enriched, prepared, read_table, sales_view, with_sql

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_sql(sql)
        return fn
    return deco


def r6(c: str | Column) -> Column:
    """Half-even to 6 places (hash-stable float means)."""
    return half_even(c, 6)


def r6sql(expr: str) -> str:
    return f"round_even(CAST({expr} AS DOUBLE) * 1000000.0, 0) / 1000000.0"


def r2sql(expr: str) -> str:
    return f"round_even(CAST({expr} AS DOUBLE) * 100.0, 0) / 100.0"


MONEY = "COALESCE(CAST(SUM(CAST(total_sales AS DECIMAL(24,6))) AS DOUBLE), 0.0)"


def base(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """The sales view, of only the named columns if any are named (then only their tables are joined)."""
    return sales_view(spark, sf, cols or None)


def prep(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return prepared(base(spark, sf, *(("date", *cols) if cols else ())))


def enr(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return enriched(base(spark, sf, *(("date", *cols) if cols else ())))


# ---------------------------------------------------------------- grouped sales

@register("sales_by_day_of_week", f"""
SELECT day_of_week, {MONEY} AS total_sales FROM enriched GROUP BY day_of_week""")
def q_sales_by_day_of_week(spark, sf):
    return S.sales_by_day_of_week(enr(spark, sf, "total_sales"))


@register("sales_by_week_of_month", f"""
SELECT week_of_month, {MONEY} AS total_sales FROM prepared GROUP BY week_of_month""")
def q_sales_by_week_of_month(spark, sf):
    return S.sales_by_week_of_month(prep(spark, sf, "total_sales"))


@register("sales_by_weather", f"""
SELECT weather, {MONEY} AS total_sales FROM prepared GROUP BY weather""")
def q_sales_by_weather(spark, sf):
    return S.sales_by_weather(prep(spark, sf, "weather", "total_sales"))


@register("weather_temperature_sales", """
SELECT weather,
  COALESCE(CAST(SUM(CASE WHEN temperature_c > -10 AND temperature_c <= 10 THEN CAST(total_sales AS DECIMAL(24,6)) END) AS DOUBLE), 0.0) AS cold,
  COALESCE(CAST(SUM(CASE WHEN temperature_c > 10 AND temperature_c <= 20 THEN CAST(total_sales AS DECIMAL(24,6)) END) AS DOUBLE), 0.0) AS mild,
  COALESCE(CAST(SUM(CASE WHEN temperature_c > 20 AND temperature_c <= 30 THEN CAST(total_sales AS DECIMAL(24,6)) END) AS DOUBLE), 0.0) AS warm,
  COALESCE(CAST(SUM(CASE WHEN temperature_c > 30 AND temperature_c <= 40 THEN CAST(total_sales AS DECIMAL(24,6)) END) AS DOUBLE), 0.0) AS hot
FROM prepared GROUP BY weather""")
def q_weather_temperature_sales(spark, sf):
    return S.weather_temperature_sales(prep(spark, sf, "weather", "temperature_c", "total_sales"))


@register("sales_by_holiday", f"""
SELECT is_holiday, {MONEY} AS total_sales FROM prepared GROUP BY is_holiday""")
def q_sales_by_holiday(spark, sf):
    return S.sales_by_holiday(prep(spark, sf, "is_holiday", "total_sales"))


def _season_cols(transform=None) -> str:
    out = []
    for s in ["Fall", "Spring", "Summer", "Winter"]:
        out.append(f"COALESCE(CAST(SUM(CASE WHEN season = '{s}' THEN CAST(total_sales AS DECIMAL(24,6)) END) AS DOUBLE), 0.0) AS {s.lower()}")
    return ",\n  ".join(out)


@register("seasonal_sales", f"""
SELECT category,
  {_season_cols()}
FROM prepared GROUP BY category""")
def q_seasonal_sales(spark, sf):
    return S.seasonal_sales(prep(spark, sf, "category", "season", "total_sales"))


@register("seasonal_sales_change", f"""
, wide AS (SELECT category,
  {_season_cols()}
FROM prepared GROUP BY category)
SELECT category,
  CAST(NULL AS DOUBLE) AS fall,
  {r2sql('(spring / NULLIF(fall, 0) - 1.0) * 100.0')} AS spring,
  {r2sql('(summer / NULLIF(spring, 0) - 1.0) * 100.0')} AS summer,
  {r2sql('(winter / NULLIF(summer, 0) - 1.0) * 100.0')} AS winter
FROM wide""")
def q_seasonal_sales_change(spark, sf):
    return S.seasonal_sales_change(prep(spark, sf, "category", "season", "total_sales"))


@register("return_rate_top5", f"""
, m AS (SELECT product_name, AVG(return_rate_pct) AS return_rate_pct FROM prepared GROUP BY product_name),
t AS (SELECT *, CAST(row_number() OVER (ORDER BY return_rate_pct DESC NULLS LAST, product_name) AS INTEGER) AS rank FROM m)
SELECT product_name, {r6sql('return_rate_pct')} AS return_rate_pct, rank FROM t WHERE rank <= 5""")
def q_return_rate_top5(spark, sf):
    return S.return_rate_top5(prep(spark, sf, "product_name", "returned", "quantity_sold")).withColumn("return_rate_pct", r6("return_rate_pct"))


@register("current_stock_top5", f"""
, m AS (SELECT product_name, CAST(SUM(stock_after_sale) AS DOUBLE) / COUNT(stock_after_sale) AS current_stock FROM prepared GROUP BY product_name),
t AS (SELECT *, CAST(row_number() OVER (ORDER BY current_stock DESC NULLS LAST, product_name) AS INTEGER) AS rank FROM m)
SELECT product_name, {r6sql('current_stock')} AS current_stock, rank FROM t WHERE rank <= 5""")
def q_current_stock_top5(spark, sf):
    return S.current_stock_top5(prep(spark, sf, "product_name", "stock_after_sale")).withColumn("current_stock", r6("current_stock"))


@register("monthly_inventory_turnover", f"""
SELECT month,
  {r2sql(f'{MONEY} / (CAST(SUM(stock_after_sale) AS DOUBLE) / COUNT(stock_after_sale))')} AS inventory_turnover_rate
FROM prepared GROUP BY month""")
def q_monthly_inventory_turnover(spark, sf):
    return S.monthly_inventory_turnover(prep(spark, sf, "total_sales", "stock_after_sale"))


@register("sales_by_discount", f"""
SELECT discount_pct, {MONEY} AS total_sales FROM prepared GROUP BY discount_pct""")
def q_sales_by_discount(spark, sf):
    return S.sales_by_discount(prep(spark, sf, "discount_pct", "total_sales"))


@register("profit_margin_by_product", f"""
SELECT product_name, {r6sql('AVG(profit_margin)')} AS profit_margin FROM prepared GROUP BY product_name""")
def q_profit_margin_by_product(spark, sf):
    return S.profit_margin_by_product(prep(spark, sf, "product_name", "net_sales", "total_sales")).withColumn("profit_margin", r6("profit_margin"))


@register("category_performance", f"""
SELECT category, CAST(SUM(quantity_sold) AS BIGINT) AS quantity_sold, {MONEY} AS total_sales,
  {r6sql('AVG(profit_margin)')} AS profit_margin
FROM prepared GROUP BY category""")
def q_category_performance(spark, sf):
    return S.category_performance(
        prep(spark, sf, "category", "quantity_sold", "net_sales", "total_sales")).withColumn("profit_margin", r6("profit_margin"))


def _total_avg_sql(key: str) -> str:
    return f"""
SELECT {key}, {r2sql(MONEY)} AS total_sales, {r2sql(f'{MONEY} / COUNT(total_sales)')} AS average_sales
FROM enriched GROUP BY {key}"""


for _name, _key in [("category_sales", "category"), ("weather_sales", "weather"),
                    ("product_sales", "product_name"), ("season_sales", "season"),
                    ("day_of_week_sales", "day_of_week")]:
    register(_name, _total_avg_sql(_key))(
        (lambda key: lambda spark, sf: S.total_and_average_sales(enr(spark, sf, key, "total_sales"), key))(_key))


@register("monthly_sales_over_year", f"""
, per_year AS (
  SELECT year(date) AS y, month(date) AS m, SUM(CAST(total_sales AS DECIMAL(24,6))) AS t FROM sales GROUP BY 1, 2)
SELECT monthname(make_date(2000, m, 1)) AS month,
  {r2sql('CAST(SUM(t) AS DOUBLE) / COUNT(*)')} AS average_monthly_sales,
  {r2sql('CAST(SUM(t) AS DOUBLE)')} AS total_sales
FROM per_year GROUP BY m""")
def q_monthly_sales_over_year(spark, sf):
    return S.monthly_sales_over_year(base(spark, sf, "date", "total_sales"))


@register("transaction_count", """
SELECT CAST(COUNT(DISTINCT transaction_id) AS BIGINT) AS transactions FROM prepared""")
def q_transaction_count(spark, sf):
    return S.transaction_count(prep(spark, sf, "transaction_id"))


@register("transaction_product_counts", """
SELECT transaction_id, product_name, CAST(COUNT(*) AS BIGINT) AS rows FROM prepared GROUP BY 1, 2""")
def q_transaction_product_counts(spark, sf):
    return S.transaction_product_counts(prep(spark, sf, "transaction_id", "product_name"))


@register("monthly_product_sales", """
SELECT product_name, strftime(date, '%Y-%m') AS month_period, CAST(SUM(quantity_sold) AS BIGINT) AS monthly_sales
FROM sales GROUP BY 1, 2""")
def q_monthly_product_sales(spark, sf):
    return S.monthly_product_sales(base(spark, sf, "date", "product_name", "quantity_sold"))


@register("sales_by_day_number", f"""
SELECT day_number, {MONEY} AS total_sales FROM prepared GROUP BY day_number""")
def q_sales_by_day_number(spark, sf):
    return S.sales_by_day_number(prep(spark, sf, "total_sales"))


# ---------------------------------------------------------------- ordered operators

from ..operators import ordered as O  # noqa: E402
from ..sources.tables import ORDER_COLS  # noqa: E402

ORDER_SQL = ", ".join(ORDER_COLS)
KEYS = ["transaction_id", "line_no", "part_key", "supp_key"]
KEYS_SQL = ", ".join(KEYS)


@register("sales_lags", f"""
SELECT {KEYS_SQL}, product_name, quantity_sold,
  CAST(lag(quantity_sold, 1) OVER w AS DOUBLE) AS sales_lag_1,
  CAST(lag(quantity_sold, 7) OVER w AS DOUBLE) AS sales_lag_7,
  CAST(lag(quantity_sold, 14) OVER w AS DOUBLE) AS sales_lag_14,
  CAST(lead(quantity_sold, 7) OVER w AS DOUBLE) AS future_7_day_sales
FROM sales WINDOW w AS (PARTITION BY product_name ORDER BY {ORDER_SQL})""")
def q_sales_lags(spark, sf):
    df = base(spark, sf, *ORDER_COLS, "product_name", "quantity_sold")
    return O.with_lags(df, ORDER_COLS).select(
        *KEYS, "product_name", "quantity_sold",
        *[F.col(c).cast("double").alias(c) for c in ["sales_lag_1", "sales_lag_7", "sales_lag_14",
                                                      "future_7_day_sales"]])


_CHANGE_SQL = f"""
, ff AS (
  SELECT {KEYS_SQL}, product_name, {ORDER_SQL.replace('transaction_id, line_no, part_key, supp_key, ', '')} AS _o,
    last_value(unit_price IGNORE NULLS) OVER w AS price,
    last_value(CAST(quantity_sold AS DOUBLE) IGNORE NULLS) OVER w AS qty,
    date AS d, total_sales AS ts
  FROM prepared WINDOW w AS (PARTITION BY product_name ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING)),
ch AS (
  SELECT {KEYS_SQL}, product_name,
    (price / NULLIF(lag(price) OVER w, 0) - 1.0) * 100.0 AS price_change_pct,
    (qty / NULLIF(lag(qty) OVER w, 0) - 1.0) * 100.0 AS quantity_change_pct
  FROM ff WINDOW w AS (PARTITION BY product_name ORDER BY d, {KEYS_SQL}, ts)),
chr AS (SELECT *, quantity_change_pct / NULLIF(price_change_pct, 0) AS price_sensitivity_ratio FROM ch)
"""


def _change_input(spark, sf):
    cols = [*ORDER_COLS, "product_name", "unit_price", "quantity_sold"]
    return prep(spark, sf, *cols).select(*cols)


@register("price_quantity_change", _CHANGE_SQL + f"""
SELECT {KEYS_SQL}, product_name, price_change_pct, quantity_change_pct, price_sensitivity_ratio FROM chr""")
def q_price_quantity_change(spark, sf):
    df = _change_input(spark, sf)
    return O.with_product_change(df, ORDER_COLS).select(
        *KEYS, "product_name", "price_change_pct", "quantity_change_pct", "price_sensitivity_ratio")


_GROWTH_SQL = f"""
, gff AS (
  SELECT {KEYS_SQL}, product_name, date AS d, total_sales AS ts,
    last_value(total_sales IGNORE NULLS) OVER (ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS v
  FROM prepared),
gr AS (
  SELECT {KEYS_SQL}, product_name,
    v / NULLIF(lag(v, 7) OVER w, 0) - 1.0 AS weekly_growth,
    v / NULLIF(lag(v, 30) OVER w, 0) - 1.0 AS monthly_growth
  FROM gff WINDOW w AS (ORDER BY d, {KEYS_SQL}, ts))
"""


@register("sales_growth", _GROWTH_SQL + f"""
SELECT {KEYS_SQL}, product_name, weekly_growth, monthly_growth FROM gr""")
def q_sales_growth(spark, sf):
    df = prep(spark, sf, *ORDER_COLS, "product_name").select(*ORDER_COLS, "product_name")
    return O.with_growth(df, ORDER_COLS).select(*KEYS, "product_name", "weekly_growth", "monthly_growth")


@register("growth_by_product", _GROWTH_SQL + f"""
SELECT product_name, {r2sql('AVG(weekly_growth)')} AS weekly_growth, {r2sql('AVG(monthly_growth)')} AS monthly_growth
FROM gr GROUP BY product_name""")
def q_growth_by_product(spark, sf):
    df = prep(spark, sf, *ORDER_COLS, "product_name").select(*ORDER_COLS, "product_name")
    return O.growth_by_product(O.with_growth(df, ORDER_COLS))


@register("price_sensitivity", _CHANGE_SQL + f"""
SELECT product_name, {r6sql('AVG(price_change_pct)')} AS price_change_pct,
  {r6sql('AVG(quantity_change_pct)')} AS quantity_change_pct,
  {r6sql('AVG(price_sensitivity_ratio)')} AS price_sensitivity_ratio
FROM chr GROUP BY product_name""")
def q_price_sensitivity(spark, sf):
    df = _change_input(spark, sf)
    res = O.price_sensitivity(O.with_product_change(df, ORDER_COLS))
    return res.select("product_name", *[r6(c).alias(c) for c in
                                        ["price_change_pct", "quantity_change_pct", "price_sensitivity_ratio"]])


def _promotion_sql(min_ratio: float, max_change: float) -> str:
    return _CHANGE_SQL + f"""
, sens AS (
  SELECT product_name, AVG(price_change_pct) AS price_change_pct, AVG(quantity_change_pct) AS quantity_change_pct,
    AVG(price_sensitivity_ratio) AS price_sensitivity_ratio FROM chr GROUP BY product_name),
picked AS (SELECT * FROM sens WHERE price_sensitivity_ratio > {min_ratio} AND price_change_pct < {max_change}),
pairs AS (SELECT DISTINCT product_name, profit_margin FROM prepared WHERE product_name IN (SELECT product_name FROM picked)),
ranked AS (
  SELECT p.*, q.profit_margin,
    CAST(row_number() OVER (ORDER BY q.profit_margin DESC NULLS LAST, p.product_name) AS INTEGER) AS rank
  FROM picked p JOIN pairs q ON p.product_name = q.product_name)
SELECT product_name, {r6sql('price_change_pct')} AS price_change_pct, {r6sql('quantity_change_pct')} AS quantity_change_pct,
  {r6sql('price_sensitivity_ratio')} AS price_sensitivity_ratio, {r6sql('profit_margin')} AS profit_margin, rank
FROM ranked WHERE rank <= 10"""


def _promotion_query(min_ratio: float, max_change: float):
    def run(spark, sf):
        cols = [*ORDER_COLS, "product_name", "unit_price", "quantity_sold"]
        rows = prep(spark, sf, *cols, "net_sales").select(*cols, "profit_margin")
        # The margin rides along through the change, so the fact tables are joined once.
        changed = materialize(O.with_product_change(rows, ORDER_COLS))
        res = O.promotion_candidates(O.price_sensitivity(changed), changed, min_ratio, max_change)
        return res.select("product_name", *[r6(c).alias(c) for c in [
            "price_change_pct", "quantity_change_pct", "price_sensitivity_ratio", "profit_margin"]], "rank")
    return run


# Reference thresholds (ratio > 1 and price change < 0) select nothing on this data;
# the second registration uses thresholds that keep about half of the products.
register("promotion_candidates", _promotion_sql(1.0, 0.0))(_promotion_query(1.0, 0.0))
register("promotion_candidates_wide", _promotion_sql(-2.0, 460.0))(_promotion_query(-2.0, 460.0))


@register("latest_per_product", f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY date DESC, transaction_id DESC, line_no DESC,
    part_key DESC, supp_key DESC, total_sales DESC) AS rn FROM prepared)
SELECT product_name, strftime(date, '%Y-%m-%d') AS date, {KEYS_SQL}, total_sales, stock_after_sale AS current_stock
FROM r WHERE rn = 1""")
def q_latest_per_product(spark, sf):
    df = prep(spark, sf, "product_name", *ORDER_COLS, "stock_after_sale").select(
        "product_name", *ORDER_COLS, F.col("stock_after_sale").alias("current_stock"))
    res = O.latest_per(df, "product_name", ORDER_COLS)
    return res.select("product_name", F.date_format("date", "yyyy-MM-dd").alias("date"), *KEYS,
                      "total_sales", "current_stock")


@register("weather_codes", f"""
, pos AS (SELECT weather, row_number() OVER (ORDER BY {ORDER_SQL}) AS p FROM prepared),
f AS (SELECT weather, MIN(p) AS p FROM pos WHERE weather IS NOT NULL GROUP BY weather)
SELECT weather, CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS weather_code FROM f""")
def q_weather_codes(spark, sf):
    return O.factor_codes(prep(spark, sf, "weather", *ORDER_COLS), "weather", ORDER_COLS)


# ---------------------------------------------------------------- statistics

from ..functions.calendar import holiday_flag  # noqa: E402
from ..operators import stats as ST  # noqa: E402

MEASURES = ["quantity_sold", "unit_price", "total_sales", "discount_pct", "total_after_discount", "net_sales",
            "returned", "stock_after_sale", "temperature_c", "humidity_pct", "precipitation_mm",
            "wind_speed_kmh", "is_weekend", "is_special_event"]


def _describe_sql(cols: list[str]) -> str:
    parts = []
    stats = [("count", "COUNT({c})"), ("mean", "AVG({c})"), ("std", "STDDEV_SAMP({c})"), ("min", "MIN({c})"),
             ("25%", "QUANTILE_CONT({c}, 0.25)"), ("50%", "QUANTILE_CONT({c}, 0.5)"),
             ("75%", "QUANTILE_CONT({c}, 0.75)"), ("max", "MAX({c})")]
    for stat, tmpl in stats:
        vals = ", ".join(f"{r6sql(tmpl.format(c=f'CAST({c} AS DOUBLE)'))} AS {c}" for c in cols)
        parts.append(f"SELECT '{stat}' AS stat, {vals} FROM sales")
    return "\n" + "\nUNION ALL\n".join(parts)


@register("describe_numeric", _describe_sql(MEASURES))
def q_describe_numeric(spark, sf):
    res = ST.describe_numeric(base(spark, sf, "date", *MEASURES), MEASURES)
    return res.select("stat", *[r6(c).alias(c) for c in MEASURES])


from ..operators import sketches as SK  # noqa: E402


@register("describe_approx", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS prob, CAST(COUNT({c}) AS BIGINT) AS rows, TRUE AS within FROM sales"
    for c in MEASURES for p in ST.PROBS))
def q_describe_approx(spark, sf):
    """D14 with ``approx``: the sketched quartiles of every measure have true ranks within the stated error."""
    rows = materialize(base(spark, sf, "date", *MEASURES).select(*MEASURES))
    wide = ST.describe_numeric(rows, MEASURES, approx=True).filter(F.col("stat").endswith("%"))
    long = wide.unpivot(["stat"], MEASURES, "column", "estimate").select(
        "column", (F.regexp_replace("stat", "%", "").cast("double") / 100).alias("prob"), "estimate")
    return SK.rank_check(rows, long)


@register("sketched_quantiles_by_month", "\nUNION ALL\n".join(
    f"SELECT CAST(month(date) AS INTEGER) AS month_no, '{c}' AS \"column\", CAST(COUNT({c}) AS BIGINT) AS rows, "
    f"{r6sql(f'AVG(CAST({c} AS DOUBLE))')} AS mean, CAST(MIN({c}) AS DOUBLE) AS lo, CAST(MAX({c}) AS DOUBLE) AS hi, TRUE AS ordered "
    "FROM sales GROUP BY 1" for c in MEASURES))
def q_sketched_quantiles_by_month(spark, sf):
    """D14, mergeable: sketches stored per day, merged per month."""
    rows = base(spark, sf, "date", *MEASURES)
    daily = materialize(SK.column_sketches(rows, MEASURES, ["date"]))
    monthly = SK.merge_sketches(daily.withColumn("month_no", F.month("date").cast("int")), ["month_no"])
    q = [SK.sketch_quantile(p) for p in ST.PROBS]
    return monthly.select("month_no", "column", F.col("n").alias("rows"), r6(F.col("sum") / F.col("n")).alias("mean"), "lo", "hi",
                          ((F.col("lo") <= q[0]) & (q[0] <= q[1]) & (q[1] <= q[2]) & (q[2] <= F.col("hi"))).alias("ordered"))


@register("transaction_count_approx", """
SELECT 'all' AS slice, 'all' AS item, CAST(COUNT(DISTINCT transaction_id) AS BIGINT) AS transactions, TRUE AS within FROM prepared
UNION ALL SELECT 'product', product_name, CAST(COUNT(DISTINCT transaction_id) AS BIGINT), TRUE FROM prepared
WHERE product_name IS NOT NULL GROUP BY product_name
UNION ALL SELECT 'month', strftime(date, '%Y-%m'), CAST(COUNT(DISTINCT transaction_id) AS BIGINT), TRUE FROM prepared
GROUP BY strftime(date, '%Y-%m')""")
def q_transaction_count_approx(spark, sf):
    """D22 with ``approx``: sketches stored per (day, product), merged for any slice; within the stated error of the exact count."""
    rows = prep(spark, sf, "transaction_id", "product_name").select("date", "product_name", "transaction_id")
    held = materialize(SK.distinct_sketches(rows, "transaction_id", ["date", "product_name"]))
    slices = {"all": F.lit("all"), "product": F.col("product_name"), "month": F.date_format("date", "yyyy-MM")}
    out = []
    for name, item in slices.items():
        estimates = SK.distinct_estimates(held.withColumn("item", item), ["item"])
        exact = rows.withColumn("item", item).groupBy("item").agg(F.countDistinct("transaction_id").alias("transactions"))
        gap = F.abs(F.col("estimate") - F.col("transactions"))
        out.append(exact.join(estimates, "item").filter(F.col("item").isNotNull()).select(
            F.lit(name).alias("slice"), "item", "transactions",
            (gap <= F.ceil(SK.DISTINCT_ERROR * F.col("transactions"))).alias("within")))
    return out[0].unionByName(out[1]).unionByName(out[2])


FACTORS = ["day_number", "iso_week", "is_weekend", "weather_code", "holiday_code", "discount_pct"]


@register("sales_factor_correlation", f"""
, pos AS (SELECT weather, row_number() OVER (ORDER BY {ORDER_SQL}) AS p FROM prepared),
f AS (SELECT weather, MIN(p) AS p FROM pos WHERE weather IS NOT NULL GROUP BY weather),
codes AS (SELECT weather, row_number() OVER (ORDER BY p) - 1 AS weather_code FROM f),
x AS (SELECT p.*, COALESCE(c.weather_code, -1) AS weather_code,
        CASE WHEN is_holiday = 'Yes' THEN 1 ELSE 0 END AS holiday_code
      FROM prepared p LEFT JOIN codes c ON p.weather = c.weather)
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS factor, {r6sql(f'CORR(CAST({c} AS DOUBLE), total_sales)')} AS correlation FROM x"
    for c in [*FACTORS, "total_sales"]))
def q_sales_factor_correlation(spark, sf):
    # Read twice (codes, then correlations): written once.
    rows = prep(spark, sf, *ORDER_COLS, "weather", "is_holiday", "discount_pct")
    rows = materialize(rows.select(*ORDER_COLS, "weather", "is_holiday", "discount_pct", "day_number", "iso_week", "is_weekend"))
    df = O.factorize(rows, "weather", ORDER_COLS).withColumn("holiday_code", holiday_flag("is_holiday"))
    return ST.sales_factor_correlation(df, "total_sales", FACTORS).withColumn("correlation", r6("correlation"))


def _pairs_sql(cols: list[str]) -> str:
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if a != b:
                rows.append(f"SELECT '{a}' AS col1, '{b}' AS col2, {i * len(cols) + j} AS ordinal, "
                            f"{r6sql(f'CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))')} AS correlation FROM enriched")
    return "\n UNION ALL \n".join(rows)


_SUMMARY_SQL = f"""
, pr AS ({_pairs_sql(MEASURES)}),
lab AS (SELECT *, CASE WHEN abs(correlation) > 0.7 THEN 'Strong' WHEN abs(correlation) > 0.5 THEN 'Moderate'
                       WHEN abs(correlation) > 0.3 THEN 'Weak' END AS strength FROM pr),
lines AS (SELECT col1, col2, CAST(ordinal AS INTEGER) AS ordinal, correlation, strength,
    printf('%s correlation between %s and %s: %.2f', strength, col1, col2, correlation) AS line
  FROM lab WHERE strength IS NOT NULL)
"""


@register("correlation_summary", _SUMMARY_SQL + "SELECT * FROM lines")
def q_correlation_summary(spark, sf):
    return ST.correlation_summary(enr(spark, sf, *MEASURES), MEASURES, digits=6)


@register("correlation_summary_text", _SUMMARY_SQL + """
SELECT COALESCE(string_agg(line, chr(10) ORDER BY ordinal) || chr(10),
  'No numeric data available for correlation analysis.') AS correlation_summary FROM lines""")
def q_correlation_summary_text(spark, sf):
    return ST.correlation_summary_text(ST.correlation_summary(enr(spark, sf, *MEASURES), MEASURES, digits=6))


# ---------------------------------------------------------------- market basket

from ..functions.text import join_items  # noqa: E402
from ..operators import basket as B  # noqa: E402

MIN_SUPPORT = 0.005

_ITEMSETS_SQL = f"""
, bt AS (SELECT DISTINCT transaction_id AS t, product_name AS p FROM prepared WHERE product_name IS NOT NULL),
nb AS (SELECT COUNT(DISTINCT t) AS n FROM bt),
baskets AS (SELECT t, list_sort(list(p)) AS b FROM bt GROUP BY t),
subsets AS (SELECT t, list_filter(b, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS items
            FROM (SELECT t, b, UNNEST(range(1, 1 << len(b))) AS m FROM baskets)),
allsets AS (SELECT items, COUNT(*) AS freq FROM subsets GROUP BY items),
itemsets AS (
  SELECT items, CAST(freq AS BIGINT) AS freq, CAST(freq AS DOUBLE) / n AS support, CAST(len(items) AS INTEGER) AS length
  FROM allsets, nb WHERE CAST(freq AS DOUBLE) / n >= {MIN_SUPPORT})
"""

_RULES_SQL = _ITEMSETS_SQL + """
, masks AS (SELECT items, support, UNNEST(range(1, (1 << length) - 1)) AS m FROM itemsets WHERE length >= 2),
splits AS (SELECT list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS a,
                  list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 0) AS c, support FROM masks),
rules AS (
  SELECT array_to_string(s.a, ', ') AS antecedent, array_to_string(s.c, ', ') AS consequent,
    len(s.a) AS na, len(s.c) AS nc,
    ia.support AS antecedent_support, ic.support AS consequent_support, s.support,
    s.support / ia.support AS confidence, s.support / ia.support / ic.support AS lift,
    s.support - ia.support * ic.support AS leverage,
    (1.0 - ic.support) / NULLIF(1.0 - s.support / ia.support, 0) AS conviction
  FROM splits s JOIN itemsets ia ON s.a = ia.items JOIN itemsets ic ON s.c = ic.items
  WHERE s.support / ia.support / ic.support >= 1.0)
"""


def _prepared_itemsets(spark, sf):
    return B.frequent_itemsets(B.baskets(prep(spark, sf, "transaction_id", "product_name")), MIN_SUPPORT)[0]


@register("baskets", """
SELECT transaction_id, array_to_string(list_sort(list(DISTINCT product_name)), ', ') AS items
FROM prepared WHERE product_name IS NOT NULL GROUP BY transaction_id""")
def q_baskets(spark, sf):
    return B.baskets(prep(spark, sf, "transaction_id", "product_name")).select("transaction_id", join_items("items").alias("items"))


@register("frequent_itemsets", _ITEMSETS_SQL + """
SELECT array_to_string(items, ', ') AS items, freq, support, length FROM itemsets""")
def q_frequent_itemsets(spark, sf):
    return _prepared_itemsets(spark, sf).select(join_items("items").alias("items"), "freq", "support", "length")


@register("association_rules", _RULES_SQL + f"""
SELECT antecedent, consequent, {r6sql('antecedent_support')} AS antecedent_support,
  {r6sql('consequent_support')} AS consequent_support, {r6sql('support')} AS support,
  {r6sql('confidence')} AS confidence, {r6sql('lift')} AS lift, {r6sql('leverage')} AS leverage,
  {r6sql('conviction')} AS conviction FROM rules""")
def q_association_rules(spark, sf):
    rules = B.association_rules(_prepared_itemsets(spark, sf), 1.0)
    return rules.select(join_items("antecedent").alias("antecedent"), join_items("consequent").alias("consequent"),
                        *[r6(c).alias(c) for c in ["antecedent_support", "consequent_support", "support",
                                                   "confidence", "lift", "leverage", "conviction"]])


@register("bought_together_top10", _RULES_SQL + f"""
, shown AS (SELECT antecedent AS items_purchased_together, consequent AS suggested_products,
    {r2sql('support * 100.0')} AS purchase_frequency_pct, {r2sql('confidence * 100.0')} AS likelihood_pct,
    lift AS association_strength FROM rules WHERE na > 1 OR nc > 1),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY association_strength DESC, items_purchased_together,
    suggested_products) AS INTEGER) AS rank FROM shown)
SELECT items_purchased_together, suggested_products, purchase_frequency_pct, likelihood_pct,
  {r6sql('association_strength')} AS association_strength, rank FROM ranked WHERE rank <= 10""")
def q_bought_together_top10(spark, sf):
    top = B.bought_together(B.association_rules(_prepared_itemsets(spark, sf), 1.0), 10)
    return top.withColumn("association_strength", r6("association_strength"))


# ---------------------------------------------------------------- segmentation

from ..operators import segments as G  # noqa: E402

_WEEKS_SQL = """
, pw AS (SELECT product_name, iso_week, SUM(CAST(total_sales AS DECIMAL(24,6))) AS s FROM prepared
         WHERE product_name IS NOT NULL GROUP BY 1, 2),
wk AS (SELECT DISTINCT iso_week FROM prepared WHERE iso_week IS NOT NULL),
pr AS (SELECT DISTINCT product_name FROM prepared WHERE product_name IS NOT NULL),
filled AS (SELECT pr.product_name, wk.iso_week, COALESCE(CAST(pw.s AS DOUBLE), 0.0) AS total_sales
           FROM pr CROSS JOIN wk LEFT JOIN pw ON pw.product_name = pr.product_name AND pw.iso_week = wk.iso_week)
"""


@register("product_week_sales", _WEEKS_SQL + "SELECT * FROM filled")
def q_product_week_sales(spark, sf):
    return G.product_week_matrix(prep(spark, sf, "product_name", "total_sales"))


@register("standardise_weekly", _WEEKS_SQL + f"""
, st AS (SELECT product_name, AVG(total_sales) AS m, STDDEV_POP(total_sales) AS sd FROM filled GROUP BY 1)
SELECT f.product_name, f.iso_week,
  {r6sql('(f.total_sales - st.m) / CASE WHEN st.sd = 0 THEN 1.0 ELSE st.sd END')} AS z
FROM filled f JOIN st ON f.product_name = st.product_name""")
def q_standardise_weekly(spark, sf):
    vec, weeks = G.product_week_vectors(prep(spark, sf, "product_name", "total_sales"))
    return G.standardised_long(G.standardise_weekly(vec), weeks).withColumn("z", r6("z"))


def _segments(spark, sf):
    vec, _ = G.product_week_vectors(prep(spark, sf, "product_name", "total_sales"))
    scaled = G.standardise_weekly(vec)
    clusters, _cost = G.segment_products(scaled)
    return vec, scaled, clusters


# The same draws and steps as ``segment_products``: exponentials from md5, whole numbers, rounded means.
def _kmeans_sql(k: int = 3, restarts: int = 10, seed: int = 0, steps: int = G.MAX_ITER) -> str:
    race = lambda step, weight: (
        f"(-ln((CAST('0x' || substr(md5('{seed}|' || r.r || '|{step}|' || p.product_name), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"
        f" / {weight}, p.product_name)")
    far = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
    starts, before = "", []
    for step in range(k):
        weight = f"least({', '.join(far('p.z', f'c{i}.z') for i in before)})" if before else "1"
        joins = " ".join(f"JOIN c{i} ON c{i}.r = r.r" for i in before)
        starts += (f", c{step} AS (SELECT r, first(z ORDER BY race) AS z FROM (SELECT r.r, p.z, {weight} AS w, "
                   f"{race(step, 'nullif(' + weight + ', 0)')} AS race FROM rs r CROSS JOIN pt p {joins}) WHERE w > 0 GROUP BY r)")
        before.append(step)
    return _WEEKS_SQL + f"""
, st AS (SELECT product_name, AVG(total_sales) AS m, STDDEV_POP(total_sales) AS sd FROM filled GROUP BY 1),
pt AS (SELECT f.product_name, list(CAST(round_even((f.total_sales - st.m) / CASE WHEN st.sd = 0 THEN 1.0 ELSE st.sd END
                                                   * {G.MICRO}.0, 0) AS BIGINT) ORDER BY f.iso_week) AS z
       FROM filled f JOIN st ON f.product_name = st.product_name GROUP BY f.product_name),
rs AS (SELECT unnest(range({restarts})) AS r)
{starts}
, lloyd(step, r, c, centre) AS (
  {' UNION ALL '.join(f'SELECT 0, r, {i}, z FROM c{i}' for i in range(k))}
  UNION ALL
  SELECT step + 1, r, c, list(v ORDER BY i) FROM (
    SELECT step, r, c, i, CASE WHEN count(*) FILTER (near) = 0 THEN any_value(old)
        ELSE (2 * (sum(z) FILTER (near) + 100000000 * count(*) FILTER (near)) + count(*) FILTER (near))
             // (2 * count(*) FILTER (near)) - 100000000 END AS v
    FROM (
      SELECT step, r, c, near, unnest(centre) AS old, unnest(z) AS z, unnest(range(len(z))) AS i
      FROM (
        SELECT l.step, l.r, l.c, l.centre, p.z,
               row_number() OVER (PARTITION BY l.r, p.product_name ORDER BY {far('p.z', 'l.centre')}, l.c) = 1 AS near
        FROM lloyd l CROSS JOIN pt p WHERE l.step < {steps}))
    GROUP BY step, r, c, i)
  GROUP BY step, r, c),
dist AS (
  SELECT l.r, l.c, p.product_name, {far('p.z', 'l.centre')} AS d FROM lloyd l CROSS JOIN pt p WHERE l.step = {steps}),
own AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY r, product_name ORDER BY d, c) = 1),
best AS (SELECT r FROM own GROUP BY r ORDER BY sum(d), r LIMIT 1),
seg AS (SELECT product_name, CAST(c AS INTEGER) AS cluster, CASE c WHEN 0 THEN '{G.CLUSTER_NAMES[0]}'
          WHEN 1 THEN '{G.CLUSTER_NAMES[1]}' ELSE '{G.CLUSTER_NAMES[2]}' END AS cluster_name
        FROM own WHERE r = (SELECT r FROM best))
"""


@register("product_segments", _kmeans_sql() + "SELECT * FROM seg")
def q_product_segments(spark, sf):
    """The cluster of every product."""
    return G.label_clusters(_segments(spark, sf)[2])


@register("clustered_products", _kmeans_sql() + """
, at AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY product_name) AS row FROM seg)
SELECT row, """.replace(" at AS", " placed AS") + ", ".join(
    f"max(product_name) FILTER (cluster = {i}) AS \"{n}\"" for i, n in G.CLUSTER_NAMES.items()) + """
FROM placed GROUP BY row""")
def q_clustered_products(spark, sf):
    return G.clustered_products(G.label_clusters(_segments(spark, sf)[2]))


@register("product_segments_check", """
SELECT product_name, TRUE AS nearest_is_own, TRUE AS named FROM prepared WHERE product_name IS NOT NULL GROUP BY 1""")
def q_product_segments_check(spark, sf):
    """What any finished k-means shows: one row per product, its own cluster's mean the nearest."""
    vec, scaled, clusters = _segments(spark, sf)
    named = G.label_clusters(clusters, by="demand", vectors=vec)
    return G.nearest_is_own(scaled, clusters).join(
        named.select("product_name", F.col("cluster_name").isin(*G.CLUSTER_NAMES.values()).alias("named")), "product_name")


@register("clustered_products_listing", """
SELECT product_name, CAST(1 AS BIGINT) AS listed FROM prepared WHERE product_name IS NOT NULL GROUP BY 1""")
def q_clustered_products_listing(spark, sf):
    """I8: the side-by-side listing by demand, long again: every product is in it once."""
    vec, _scaled, clusters = _segments(spark, sf)
    table = G.clustered_products(G.label_clusters(clusters, by="demand", vectors=vec))
    long = table.unpivot(["row"], [c for c in table.columns if c != "row"], "cluster_name", "product_name")
    return long.filter("product_name IS NOT NULL").groupBy("product_name").agg(F.count(F.lit(1)).alias("listed"))


@register("sales_by_cluster_products", _kmeans_sql() + """
SELECT p.product_name, s.cluster, CAST(COUNT(*) AS BIGINT) AS rows, TRUE AS has_cluster FROM prepared p
JOIN seg s ON s.product_name = p.product_name GROUP BY 1, 2""")
def q_sales_by_cluster_products(spark, sf):
    """Every sale carries its product's cluster."""
    clusters = _segments(spark, sf)[2]
    rows = G.with_clusters(prep(spark, sf, "product_name"), clusters).filter("product_name IS NOT NULL")
    return rows.groupBy("product_name", "cluster").agg(F.count(F.lit(1)).alias("rows"),
                                                       F.bool_and(F.col("cluster").isNotNull()).alias("has_cluster"))


# ---------------------------------------------------------------- features and models

from pyspark.sql import Window  # noqa: E402
from pyspark.sql.types import StructType  # noqa: E402

from ..operators import forecast as FC, trees as TR  # noqa: E402
from ..sources.schema import SALES_TYPES  # noqa: E402

_TRAINING_SQL = f"""
, lg AS (
  SELECT *, lag(quantity_sold, 1) OVER w AS sales_lag_1, lag(quantity_sold, 7) OVER w AS sales_lag_7,
    lag(quantity_sold, 14) OVER w AS sales_lag_14, lead(quantity_sold, 7) OVER w AS future_7_day_sales
  FROM sales WINDOW w AS (PARTITION BY product_name ORDER BY {ORDER_SQL})),
kept AS (SELECT *, strftime(date, '%Y-%m') AS month_period FROM lg
         WHERE sales_lag_1 IS NOT NULL AND sales_lag_7 IS NOT NULL AND sales_lag_14 IS NOT NULL
           AND future_7_day_sales IS NOT NULL),
ms AS (SELECT product_name, month_period, SUM(quantity_sold) AS monthly_sales FROM kept GROUP BY 1, 2),
tr AS (SELECT k.*, CAST(m.monthly_sales AS BIGINT) AS monthly_sales FROM kept k
       LEFT JOIN ms m ON k.product_name = m.product_name AND k.month_period = m.month_period)
"""


def training(spark, sf, *cols, write=materialize):
    """The training table with the columns it is built from and ``cols``."""
    return FC.training_rows(base(spark, sf, *ORDER_COLS, "product_name", "quantity_sold", *cols), ORDER_COLS, write=write)


@register("training_rows", _TRAINING_SQL + f"""
SELECT {KEYS_SQL}, product_name, month_period, quantity_sold, CAST(sales_lag_1 AS DOUBLE) AS sales_lag_1,
  CAST(sales_lag_7 AS DOUBLE) AS sales_lag_7, CAST(sales_lag_14 AS DOUBLE) AS sales_lag_14,
  CAST(future_7_day_sales AS DOUBLE) AS future_7_day_sales, monthly_sales FROM tr""")
def q_training_rows(spark, sf):
    tr = training(spark, sf)
    return tr.select(*KEYS, "product_name", "month_period", "quantity_sold",
                     *[F.col(c).cast("double").alias(c) for c in ["sales_lag_1", "sales_lag_7", "sales_lag_14",
                                                                 "future_7_day_sales"]],
                     "monthly_sales")


@register("naive_forecast_metrics", _TRAINING_SQL + f"""
, d AS (SELECT CAST(future_7_day_sales AS DOUBLE) AS y, CAST(sales_lag_7 AS DOUBLE) AS p FROM tr)
SELECT {r6sql('AVG((y - p) * (y - p))')} AS mse, {r6sql('1.0 - AVG((y - p) * (y - p)) / VAR_POP(y)')} AS r2,
  CAST(COUNT(*) AS BIGINT) AS n FROM d""")
def q_naive_forecast_metrics(spark, sf):
    """I15 on a deterministic baseline: next-week quantity predicted by the 7-row lag."""
    tr = training(spark, sf)
    m = ST.regression_metrics(tr, "future_7_day_sales", "sales_lag_7")
    return m.select(r6("mse").alias("mse"), r6("r2").alias("r2"), "n")


@register("hash_split", f"""
SELECT {KEYS_SQL}, CAST(substr(md5(concat_ws('|', '42', CAST(transaction_id AS VARCHAR), CAST(line_no AS VARCHAR),
  CAST(part_key AS VARCHAR), CAST(supp_key AS VARCHAR))), 1, 8) >= 'cccccccc' AS INTEGER) AS is_test FROM sales""")
def q_hash_split(spark, sf):
    return FC.hash_split(base(spark, sf, *KEYS), KEYS).select(*KEYS, "is_test")


@register("one_hot_weather", f"""
SELECT {KEYS_SQL}, weather,
  CAST(CASE WHEN weather = 'Rainy' THEN 1 ELSE 0 END AS INTEGER) AS weather_Rainy,
  CAST(CASE WHEN weather = 'Snow' THEN 1 ELSE 0 END AS INTEGER) AS weather_Snow,
  CAST(CASE WHEN weather = 'Stormy' THEN 1 ELSE 0 END AS INTEGER) AS weather_Stormy,
  CAST(CASE WHEN weather = 'Sunny' THEN 1 ELSE 0 END AS INTEGER) AS weather_Sunny
FROM sales""")
def q_one_hot_weather(spark, sf):
    df = base(spark, sf, *KEYS, "weather")
    vocab = FC.vocabulary(df, ["weather"])
    names = {name: f"weather_{v}" for _, v, name in FC.dummy_table(vocab)}
    return FC.one_hot(df, vocab).select(*KEYS, "weather", *names).withColumnsRenamed(names)


@register("stock_sufficiency", _TRAINING_SQL + f"""
, avgm AS (SELECT product_name, round_even(AVG(monthly_sales), 0) AS predicted_next_month_sales FROM tr GROUP BY 1),
lt AS (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY date DESC, transaction_id DESC, line_no DESC,
    part_key DESC, supp_key DESC, total_sales DESC) AS rn FROM tr)
SELECT l.product_name, l.stock_after_sale AS current_stock, a.predicted_next_month_sales,
  round_even(l.stock_after_sale - a.predicted_next_month_sales, 0) AS projected_stock,
  round_even(l.stock_after_sale - a.predicted_next_month_sales, 0) >= 0 AS adequate
FROM lt l JOIN avgm a ON l.product_name = a.product_name WHERE rn = 1""")
def q_stock_sufficiency(spark, sf):
    """I21 with a deterministic stand-in predictor: next month's sales = the product's
    rounded mean monthly sales (E6), so the whole chain has an oracle."""
    return FC.stock_against_mean(training(spark, sf, "stock_after_sale"), ORDER_COLS)


FEATURE_INPUTS = ["date", *[c for c in FC.NUMERIC if c in SALES_TYPES and "lag" not in c], "is_holiday", *FC.CATEGORICAL]


def model_frame(spark, sf):
    """Training rows with every feature column, and the vocabulary of the dummies."""
    rows = training(spark, sf, *FEATURE_INPUTS, write=materialize_packed)
    release(spark)
    vocab = FC.vocabulary(rows)
    return FC.with_features(rows, vocab), vocab


def _selection_sql(task: str) -> str:
    names = ", ".join(f"('{m}')" for m in FC.candidates())
    return _TRAINING_SQL + f"""
, sp AS (SELECT md5(concat_ws('|', '42', CAST(transaction_id AS VARCHAR), CAST(line_no AS VARCHAR),
    CAST(part_key AS VARCHAR), CAST(supp_key AS VARCHAR))) AS h FROM tr),
n AS (SELECT CAST(COUNT(*) FILTER (substr(h, 1, 8) < 'cccccccc') AS BIGINT) AS train_rows,
             CAST(COUNT(*) FILTER (substr(h, 1, 8) >= 'cccccccc') AS BIGINT) AS test_rows FROM sp)
SELECT '{task}' AS task, m.model, TRUE AS selected_is_lowest, TRUE AS finite, n.train_rows, n.test_rows
FROM (VALUES {names}) AS m(model), n"""


def _selection(task: str):
    """I12-I14, I16, I17 for one task: the three candidates, uncut; what SQL can check of the outcome."""
    def run(spark, sf):
        frame, vocab = model_frame(spark, sf)
        _models, metrics = FC.train_all(frame, {task: FC.feature_sets(vocab)[task]})
        split = FC.hash_split(frame, KEYS).groupBy().agg(F.count_if(F.col("is_test") == 0).alias("train_rows"),
                                                         F.count_if(F.col("is_test") == 1).alias("test_rows")).first()
        lowest = F.min("mse").over(Window.partitionBy("task"))  # three rows
        return metrics.select("task", "model", (F.col("selected") == (F.col("mse") == lowest)).alias("selected_is_lowest"),
                              (F.abs("mse") < float("inf")).alias("finite"),
                              F.lit(split["train_rows"]).alias("train_rows"), F.lit(split["test_rows"]).alias("test_rows"))
    return run


for _task in FC.TARGETS:
    register(f"model_selection_{_task}", _selection_sql(_task))(_selection(_task))


# One round of second-order boosting, two levels deep: with base score 0 the gradient sums are whole numbers.
BOOST_FEATURES = ["quantity_sold", "sales_lag_1", "month", "day"]


def _best_splits_sql(rows: str) -> str:
    """Best split of every node of ``rows`` (node, y, features): sums per value, running sums, gain with penalty 1."""
    cells = " UNION ALL ".join(f"SELECT node, {i} AS f, '{c}' AS feature, CAST({c} AS DOUBLE) AS v, -SUM(y) AS g, "
                               f"CAST(COUNT(*) AS DOUBLE) AS h FROM {rows} GROUP BY 1, 4" for i, c in enumerate(BOOST_FEATURES))
    return f"""SELECT node, f, feature, cut, gl, hl, gt - gl AS gr, ht - hl AS hr,
    0.5 * (gl * gl / (hl + 1.0) + (gt - gl) * (gt - gl) / (ht - hl + 1.0) - gt * gt / (ht + 1.0)) AS gain
  FROM (SELECT node, f, feature, lead(v) OVER up AS cut, SUM(g) OVER up AS gl, SUM(h) OVER up AS hl,
      SUM(g) OVER (PARTITION BY node, f) AS gt, SUM(h) OVER (PARTITION BY node, f) AS ht FROM ({cells})
    WINDOW up AS (PARTITION BY node, f ORDER BY v))
  WHERE cut IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, cut) = 1"""


_CHILD_SQL = " ".join(f"WHEN '{c}' THEN CAST(r.{c} AS DOUBLE) >= s.cut" for c in BOOST_FEATURES)


@register("boosting_first_round", _TRAINING_SQL + f"""
, r0 AS (SELECT 1 AS node, CAST(future_7_day_sales AS DOUBLE) AS y, quantity_sold, sales_lag_1, month(date) AS month,
    day(date) AS day FROM tr),
s0 AS ({_best_splits_sql("r0")}),
r1 AS (SELECT 2 + CAST(CASE s.feature {_CHILD_SQL} END AS INTEGER) AS node, r.* EXCLUDE (node) FROM r0 r, s0 s WHERE s.gain > 0),
s1 AS ({_best_splits_sql("r1")})
SELECT CAST(node AS INTEGER) AS node, feature, cut, {r6sql('gain')} AS gain,
  {r6sql('-0.3 * gl / (hl + 1.0)')} AS left_value, {r6sql('-0.3 * gr / (hr + 1.0)')} AS right_value
FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1) WHERE gain > 0""")
def q_boosting_first_round(spark, sf):
    """The splits and leaf values of one round, two levels deep."""
    rows = training(spark, sf).withColumns({"month": F.month("date"), "day": F.dayofmonth("date")})
    ready = FC.VectorAssembler(inputCols=BOOST_FEATURES, outputCol="x").transform(rows.select("future_7_day_sales", *BOOST_FEATURES))
    model = TR.SecondOrderBoosting("x", "future_7_day_sales", "p", rounds=1, depth=2, base_score=0.0).fit(ready)
    schema = StructType.fromDDL("node int, feature string, cut double, gain double, left_value double, right_value double")
    found = literal_frame(spark, [r[1:] for r in model.splits(BOOST_FEATURES)], schema)
    return found.select("node", "feature", "cut", *[r6(c).alias(c) for c in ("gain", "left_value", "right_value")])


# The scoring chain with one-feature least squares, whose closed form SQL has.
_LINE_SQL = {t: f"regr_intercept(CAST({FC.TARGETS[t]} AS DOUBLE), CAST({x} AS DOUBLE)) AS a_{t}, "
                f"regr_slope(CAST({FC.TARGETS[t]} AS DOUBLE), CAST({x} AS DOUBLE)) AS b_{t}"
             for t, (x,) in FC.LINE_FEATURES.items()}
_SCORED_SQL = _TRAINING_SQL + f"""
, fit AS (SELECT {', '.join(_LINE_SQL.values())} FROM tr),
scored AS (SELECT tr.*,
    CAST(round_even(a_weekly + b_weekly * sales_lag_7, 0) AS BIGINT) AS predicted_next_week_sales,
    CAST(round_even(a_monthly + b_monthly * quantity_sold, 0) AS BIGINT) AS predicted_next_month_sales,
    CAST(round_even(a_discount + b_discount * quantity_sold, 0) AS BIGINT) AS predicted_discount_pct
  FROM tr, fit)
"""


def _scored(spark, sf):
    rows = training(spark, sf, "discount_pct", "stock_after_sale")
    return FC.score(rows, FC.fit_lines(rows), FC.LINE_FEATURES)


@register("scored_rows", _SCORED_SQL + f"SELECT {KEYS_SQL}, {', '.join(FC.PREDICTIONS)} FROM scored")
def q_scored_rows(spark, sf):
    """Sanitised predictions of every training row."""
    return _scored(spark, sf).select(*KEYS, *FC.PREDICTIONS)


@register("product_predictions", _SCORED_SQL + f"""
SELECT product_name, {', '.join(f'CAST(round_even(AVG({c}), 0) AS BIGINT) AS {c}' for c in FC.PREDICTIONS)}
FROM scored GROUP BY product_name""")
def q_product_predictions(spark, sf):
    return FC.predictions_by_product(_scored(spark, sf))


@register("current_vs_predicted", _SCORED_SQL + """
SELECT product_name, round_even(AVG(future_7_day_sales), 0) AS current_avg_weekly_sales,
  round_even(AVG(predicted_next_week_sales), 0) AS predicted_next_week_sales,
  round_even(AVG(predicted_next_month_sales), 0) AS predicted_next_month_sales,
  round_even(AVG(discount_pct), 0) AS current_avg_discount_pct,
  round_even(AVG(predicted_discount_pct), 0) AS predicted_discount_pct
FROM scored GROUP BY product_name""")
def q_current_vs_predicted(spark, sf):
    return FC.current_vs_predicted(_scored(spark, sf))


@register("stock_sufficiency_predicted", _SCORED_SQL + """
, lt AS (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY date DESC, transaction_id DESC, line_no DESC,
    part_key DESC, supp_key DESC, total_sales DESC) AS rn FROM scored)
SELECT product_name, stock_after_sale AS current_stock, predicted_next_month_sales,
  CAST(stock_after_sale - predicted_next_month_sales AS DOUBLE) AS projected_stock,
  stock_after_sale >= predicted_next_month_sales AS adequate FROM lt WHERE rn = 1""")
def q_stock_sufficiency_predicted(spark, sf):
    return FC.stock_sufficiency(_scored(spark, sf), ORDER_COLS)


@register("service_predictions", _TRAINING_SQL + f"""
, fit AS (SELECT {', '.join(_LINE_SQL.values())} FROM tr),
s AS (SELECT p.product_name,
    CAST(round_even(a_weekly, 0) AS BIGINT) AS predicted_next_week_sales,
    CAST(round_even(a_monthly + b_monthly * quantity_sold, 0) AS BIGINT) AS predicted_next_month_sales,
    CAST(round_even(a_discount + b_discount * quantity_sold, 0) AS BIGINT) AS predicted_discount_pct
  FROM sales p, fit)
SELECT product_name, {', '.join(f'CAST(round_even(AVG({c}), 0) AS BIGINT) AS {c}' for c in FC.PREDICTIONS)}
FROM s WHERE product_name IS NOT NULL GROUP BY product_name""")
def q_service_predictions(spark, sf):
    """The prediction service on raw rows with text numbers: no lags there, so that feature is 0 in every row."""
    models = FC.fit_lines(training(spark, sf, "discount_pct"))
    raw = base(spark, sf, "date", "product_name", "quantity_sold", "is_holiday", "weather", "season", "category").select(
        F.col("date").cast("string").alias("date"), "product_name", F.col("quantity_sold").cast("string").alias("quantity_sold"),
        "is_holiday", "weather", "season", "category")
    raw = materialize(raw)  # read by the vocabulary, the check of the dates and the scores
    return FC.predict_products(raw, models, FC.LINE_FEATURES, FC.vocabulary(raw, ["weather", "season"]))


# ---------------------------------------------------------------- report bundle

from . import report as RP  # noqa: E402


def _facts_sql() -> str:
    money = MONEY
    parts = [
        f"SELECT 'sales_by_day_of_week' AS section, CAST(day_number AS VARCHAR) AS item, 'total_sales' AS metric, "
        f"{money} AS value FROM prepared GROUP BY day_number",
        "SELECT 'profit_analysis', product_name, 'profit_margin', AVG(profit_margin) FROM prepared GROUP BY product_name",
        f"SELECT 'weather_sales', weather, 'total_sales', {money} FROM prepared GROUP BY weather",
    ]
    for a in RP.CORRELATION_FACTORS:
        for b in RP.CORRELATION_FACTORS:
            parts.append(f"SELECT 'correlation_matrix', '{a}', '{b}', CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) FROM x")
    for season in ["fall", "spring", "summer", "winter"]:
        parts.append(f"SELECT 'seasonal_sales', category, '{season}', {season} FROM wide")
    parts += [
        "SELECT 'return_analysis', product_name, 'return_rate_pct', return_rate_pct FROM t WHERE rank <= 5",
        f"SELECT 'monthly_stock_turnover', CAST(month AS VARCHAR), 'inventory_turnover_rate', "
        f"{r2sql(f'{money} / (CAST(SUM(stock_after_sale) AS DOUBLE) / COUNT(stock_after_sale))')} FROM prepared GROUP BY month",
    ]
    for metric in ["support", "confidence", "lift"]:
        parts.append(f"SELECT 'association_rules', antecedent || ' -> ' || consequent, '{metric}', {metric} FROM rules")
    union = "\n UNION ALL \n".join(parts)
    return _RULES_SQL + f"""
, pos AS (SELECT weather, row_number() OVER (ORDER BY {ORDER_SQL}) AS p FROM prepared),
f AS (SELECT weather, MIN(p) AS p FROM pos WHERE weather IS NOT NULL GROUP BY weather),
codes AS (SELECT weather, row_number() OVER (ORDER BY p) - 1 AS weather_code FROM f),
x AS (SELECT p.*, COALESCE(c.weather_code, -1) AS weather_code,
        CASE WHEN is_holiday = 'Yes' THEN 1 ELSE 0 END AS holiday_code
      FROM prepared p LEFT JOIN codes c ON p.weather = c.weather),
wide AS (SELECT category, {_season_cols()} FROM prepared GROUP BY category),
m AS (SELECT product_name, AVG(return_rate_pct) AS return_rate_pct FROM prepared GROUP BY product_name),
t AS (SELECT *, row_number() OVER (ORDER BY return_rate_pct DESC NULLS LAST, product_name) AS rank FROM m),
facts AS ({union})
SELECT section, item, metric, {r6sql('value')} AS value FROM facts"""


@register("report_facts", _facts_sql())
def q_report_facts(spark, sf):
    return RP.report_facts(base(spark, sf), ORDER_COLS, digits=6)


# ---------------------------------------------------------------- row-level views

from ..functions.calendar import temperature_bin  # noqa: E402

VIEW_COLS = ["transaction_id", "line_no", "part_key", "supp_key", "product_name", "category", "quantity_sold",
             "unit_price", "total_sales", "discount_pct", "total_after_discount", "net_sales", "returned",
             "stock_after_sale", "weather", "temperature_c", "humidity_pct", "precipitation_mm", "wind_speed_kmh",
             "is_holiday", "is_weekend", "is_special_event", "season"]


@register("sales_view", f"""
SELECT strftime(date, '%Y-%m-%d') AS date, {', '.join(VIEW_COLS)} FROM sales""")
def q_sales_view(spark, sf):
    """A1 + B3-B5: the derived sales table itself (date as ISO text)."""
    df = base(spark, sf)
    return df.select(F.date_format("date", "yyyy-MM-dd").alias("date"), *VIEW_COLS)


@register("calendar_features", f"""
SELECT {KEYS_SQL}, day_of_week, day_number, iso_week, year, month, day, week_of_month, month_name, month_period,
  is_weekend,
  CASE WHEN temperature_c > -10 AND temperature_c <= 10 THEN 'Cold' WHEN temperature_c > 10 AND temperature_c <= 20
       THEN 'Mild' WHEN temperature_c > 20 AND temperature_c <= 30 THEN 'Warm'
       WHEN temperature_c > 30 AND temperature_c <= 40 THEN 'Hot' END AS temperature_bin,
  CAST(CASE WHEN is_holiday = 'Yes' THEN 1 ELSE 0 END AS INTEGER) AS holiday_code,
  {r6sql('profit_margin')} AS profit_margin, {r6sql('return_rate_pct')} AS return_rate_pct
FROM enriched""")
def q_calendar_features(spark, sf):
    """H1-H10 + B4/B5 on every row."""
    df = enr(spark, sf)
    return df.select(*KEYS, "day_of_week", "day_number", "iso_week", "year", "month", "day", "week_of_month",
                     "month_name", "month_period", "is_weekend", temperature_bin("temperature_c").alias("temperature_bin"),
                     holiday_flag("is_holiday").alias("holiday_code"), r6("profit_margin").alias("profit_margin"),
                     r6("return_rate_pct").alias("return_rate_pct"))


@register("group_means", _TRAINING_SQL + f"""
SELECT {KEYS_SQL}, product_name,
  round_even(AVG(future_7_day_sales) OVER (PARTITION BY product_name), 0) AS current_avg_future_7_day_sales,
  round_even(AVG(monthly_sales) OVER (PARTITION BY product_name), 0) AS current_avg_monthly_sales,
  round_even(AVG(discount_pct) OVER (PARTITION BY product_name), 0) AS current_avg_discount_pct
FROM tr""")
def q_group_means(spark, sf):
    """Product means of next-week sales, monthly sales and discount on every training row."""
    tr = training(spark, sf, "discount_pct")
    cols = ["future_7_day_sales", "monthly_sales", "discount_pct"]
    out = O.with_group_mean(tr, "product_name", cols, digits=0)
    return out.select(*KEYS, "product_name", *[f"current_avg_{c}" for c in cols])


# ---------------------------------------------------------------- sources and sinks

from ..functions.text import capitalize_word, strip_prefix  # noqa: E402
from ..sources import files as IO  # noqa: E402
from ..sources.schema import ANALYSIS_REQUIRED, align_features, columns_of_type  # noqa: E402


@register("transaction_product_records", """
, c AS (SELECT transaction_id, product_name, CAST(COUNT(*) AS BIGINT) AS rows FROM prepared GROUP BY 1, 2)
SELECT CAST(to_json({'transaction_id': transaction_id, 'product_name': product_name, 'rows': rows}) AS VARCHAR) AS json
FROM c""")
def q_transaction_product_records(spark, sf):
    """A5: D23's rows as JSON records (one object per row)."""
    return IO.to_records(S.transaction_product_counts(prep(spark, sf, "transaction_id", "product_name")))


@register("validated_dates", f"""
SELECT {KEYS_SQL}, strftime(CAST(TRY_CAST(CAST(date AS VARCHAR) AS TIMESTAMP) AS DATE), '%Y-%m-%d') AS date FROM sales""")
def q_validated_dates(spark, sf):
    """A7 + B21: dates re-parsed from text; the job fails if any is missing or invalid."""
    df = base(spark, sf, *KEYS, "date").select(*KEYS, F.col("date").cast("string").alias("date"))
    checked = IO.reject_invalid_dates(df)
    return checked.select(*KEYS, F.date_format("date", "yyyy-MM-dd").alias("date"))


@register("money_columns", f"""
SELECT {KEYS_SQL}, {r6sql('quantity_sold * unit_price')} AS total_sales,
  {r6sql('quantity_sold * unit_price * (1.0 - discount_pct / 100.0)')} AS total_after_discount,
  {r6sql('quantity_sold * unit_price * (1.0 - discount_pct / 100.0) - returned * unit_price')} AS net_sales,
  round_even(stock_after_sale - quantity_sold, 0) AS projected_stock FROM sales""")
def q_money_columns(spark, sf):
    """The money columns computed from quantity, price, discount and returns."""
    df = with_money(base(spark, sf, *KEYS, "quantity_sold", "unit_price", "discount_pct", "returned", "stock_after_sale"))
    return df.select(*KEYS, *[r6(c).alias(c) for c in ["total_sales", "total_after_discount", "net_sales"]],
                     projected_stock("stock_after_sale", "quantity_sold").alias("projected_stock"))


_GAPS_SQL = f"""
, gaps AS (SELECT {KEYS_SQL},
    CASE WHEN line_no % 3 = 0 THEN NULL ELSE weather END AS weather,
    CASE WHEN line_no % 2 = 0 THEN NULL ELSE humidity_pct END AS humidity_pct,
    CASE WHEN line_no % 5 = 0 THEN 'n/a' ELSE CAST(quantity_sold AS VARCHAR) END AS quantity_text,
    CASE WHEN line_no = 7 THEN NULL ELSE season END AS season FROM sales)
"""


def _gaps(spark, sf):
    """The sales with holes: rows with NULLs and texts that are no numbers."""
    ln = F.col("line_no")
    return base(spark, sf, *KEYS, "date", "weather", "humidity_pct", "quantity_sold", "season").select(
        *KEYS, F.when(ln % 3 != 0, F.col("weather")).alias("weather"),
        F.when(ln % 2 != 0, F.col("humidity_pct")).alias("humidity_pct"),
        F.when(ln % 5 == 0, "n/a").otherwise(F.col("quantity_sold").cast("string")).alias("quantity_text"),
        F.when(ln != 7, F.col("season")).alias("season"))


@register("cleaned_rows", _GAPS_SQL + f"""
SELECT {KEYS_SQL}, COALESCE(weather, 'Unknown') AS weather, COALESCE(humidity_pct, 0) AS humidity_pct,
  COALESCE(TRY_CAST(quantity_text AS DOUBLE), 0.0) AS quantity_text, season FROM gaps WHERE season IS NOT NULL""")
def q_cleaned_rows(spark, sf):
    """Rows without a season go, missing labels and numbers are filled, texts become numbers."""
    df = IO.clean(_gaps(spark, sf), subset=["season"])
    return IO.coerce_numeric(IO.clean(IO.fill_label(df, "weather"), fill=0), ["quantity_text"])


@register("complete_rows", _GAPS_SQL + f"""
SELECT {KEYS_SQL}, weather, humidity_pct, quantity_text, season FROM gaps
WHERE weather IS NOT NULL AND humidity_pct IS NOT NULL AND season IS NOT NULL""")
def q_complete_rows(spark, sf):
    """B16."""
    return IO.clean(_gaps(spark, sf), drop_any=True)


@register("aligned_features", f"""
SELECT {KEYS_SQL}, temperature_c AS temperature_c, 0.0 AS unseen_feature, CAST(quantity_sold AS DOUBLE) AS quantity_sold
FROM sales""")
def q_aligned_features(spark, sf):
    """The numeric columns aligned to a stored list with a feature that the data lacks."""
    df = base(spark, sf, *KEYS, "temperature_c", "quantity_sold", "weather")
    numeric = [c for c in columns_of_type(df, "numeric") if c not in KEYS]
    want = ["temperature_c", "unseen_feature", "quantity_sold"]
    return align_features(df.select(*KEYS, *numeric), want, keep=KEYS)


_SEASON_QUARTER = {"Winter": "cold", "Summer": "hot"}


@register("season_lookup", f"""
SELECT {KEYS_SQL}, CASE season WHEN 'Winter' THEN 'cold' WHEN 'Summer' THEN 'hot' ELSE 'mild' END AS climate,
  CASE WHEN starts_with(product_name, 'Brand#') THEN substr(product_name, 7) END AS brand_no FROM sales""")
def q_season_lookup(spark, sf):
    """A dictionary lookup with a default, and a prefix stripped."""
    df = lookup(base(spark, sf, *KEYS, "date", "season", "product_name"), "season", _SEASON_QUARTER, "climate", default="mild")
    return df.select(*KEYS, "climate", strip_prefix("product_name", "Brand#").alias("brand_no"))


@register("sanitised_values", f"""
SELECT {KEYS_SQL}, CASE WHEN line_no % 4 IN (1, 2, 3) THEN 0 ELSE CAST(round_even(unit_price, 0) AS BIGINT) END AS value
FROM sales""")
def q_sanitised_values(spark, sf):
    """NaN, infinities and NULL are 0, other numbers are rounded half-even."""
    ln = F.col("line_no") % 4
    x = F.when(ln == 1, float("nan")).when(ln == 2, float("-inf")).when(ln == 3, F.lit(None)).otherwise(F.col("unit_price"))
    return base(spark, sf, *KEYS, "unit_price").select(*KEYS, sanitize(x).alias("value"))


@register("parsed_reports", """
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'good' ELSE 'unknown' END AS store_performance_rating,
  CASE WHEN turn % 2 = 0 THEN CAST(length(text) AS VARCHAR) ELSE 'Error occurred while processing data' END AS first_insight,
  CASE WHEN turn % 2 = 0 THEN upper(role[1]) || lower(role[2:]) ELSE 'Unable to analyze due to processing error.' END
    AS first_challenge
FROM conversations""")
def q_parsed_reports(spark, sf):
    """Fenced JSON made from every even turn, and plain text, parsed as report responses."""
    conv = read_table(spark, sf, "conversations")
    body = F.to_json(F.struct(F.lit("good").alias("store_performance_rating"),
                              F.array(F.length("text").cast("string")).alias("key_insights"),
                              F.array().cast("array<string>").alias("recommendations"),
                              F.array(capitalize_word("role")).alias("challenges")))
    response = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.col("text"))
    parsed = RP.parse_report_responses(conv.select("conv_id", "turn", response.alias("response")))
    return parsed.select("conv_id", "turn", "store_performance_rating", F.get("key_insights", F.lit(0)).alias("first_insight"),
                         F.get("challenges", F.lit(0)).alias("first_challenge"))


@register("csv_round_trip", f"""
SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, line_no, strftime(date, '%Y-%m-%d') AS date, product_name,
  quantity_sold, unit_price, discount_pct, stock_after_sale, returned, weather, temperature_c, humidity_pct,
  precipitation_mm, wind_speed_kmh, is_holiday, is_weekend, is_special_event, season, category, total_sales,
  total_after_discount, net_sales, CAST(quantity_sold AS DOUBLE) AS sales_lag_1 FROM sales""")
def q_csv_round_trip(spark, sf):
    """A1, A3: every row written as a CSV line with display names and read back by the typing of ``read_sales``.

    ``sales_lag_1`` is the quantity as the files have it, a number with a fraction ("5.0")."""
    cols = ["transaction_id", "line_no", "date", "product_name", "quantity_sold", "unit_price", "discount_pct",
            "stock_after_sale", "returned", "weather", "temperature_c", "humidity_pct", "precipitation_mm",
            "wind_speed_kmh", "is_holiday", "is_weekend", "is_special_event", "season", "category", "total_sales",
            "total_after_discount", "net_sales"]
    df = base(spark, sf).select(*cols, F.col("quantity_sold").cast("double").alias("sales_lag_1"))
    back = IO.from_csv_text(IO.csv_text(df), df.columns)
    return back.withColumn("line_no", F.col("line_no").cast("long")).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


_J3_KEYS = ["category", "weather", "product_name", "season", "day_of_week"]


@register("service_analysis", "\n" + "\n UNION ALL \n".join(
    f"SELECT '{k}' AS section, {k} AS item, {r2sql(MONEY)} AS total_sales, {r2sql(f'{MONEY} / COUNT(total_sales)')} "
    f"AS average_sales FROM enriched GROUP BY {k}" for k in _J3_KEYS))
def q_service_analysis(spark, sf):
    """J3 on a frame with just the required columns: its five grouped tables as one."""
    out = RP.data_analysis(base(spark, sf, *ANALYSIS_REQUIRED).select(*ANALYSIS_REQUIRED))
    tables = {"category": "category_sales", "weather": "weather_sales", "product_name": "product_sales",
              "season": "season_sales", "day_of_week": "day_of_week_sales"}
    parts = [out[t].select(F.lit(k).alias("section"), F.col(k).alias("item"), "total_sales", "average_sales")
             for k, t in tables.items()]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


_PREDICTION_FACTS_SQL = _SCORED_SQL + "\n".join(
    f"{'UNION ALL' if i else ''} SELECT 'predicted_data' AS section, product_name AS item, '{c}' AS metric, "
    f"round_even(AVG({c}), 0) AS value FROM scored GROUP BY product_name" for i, c in enumerate(FC.PREDICTIONS))


@register("report_predictions", _PREDICTION_FACTS_SQL)
def q_report_predictions(spark, sf):
    """The prediction table of the bundle as facts."""
    return RP.facts(FC.predictions_by_product(_scored(spark, sf)), "predicted_data", ["product_name"], FC.PREDICTIONS)


@register("report_facts_full", "\nUNION ALL\n".join(f"SELECT * FROM ({with_sql(part)})" for part in (
    _facts_sql(), _PREDICTION_FACTS_SQL,
    _kmeans_sql() + "SELECT 'clustered_data' AS section, product_name AS item, 'cluster' AS metric, "
                    "CAST(cluster AS DOUBLE) AS value FROM seg")))
def q_report_facts_full(spark, sf):
    """All ten tables of the bundle."""
    return RP.report_facts(base(spark, sf), ORDER_COLS, FC.predictions_by_product(_scored(spark, sf)),
                           _segments(spark, sf)[2], digits=6)


# Model fits run last: they are the longest and the most memory-hungry.
for _name in [f"model_selection_{t}" for t in FC.TARGETS]:
    QUERIES[_name] = QUERIES.pop(_name)
