"""Result bundles (J1-J4): the dashboard's and the analysis service's analyses as Spark jobs.

Bundles are ``dict[str, DataFrame]``: nothing is collected; the caller decides
which tables to write or show.  The shared base frame is written once as a
reliable checkpoint (survives executor loss, AQE-sized partitions) so the dozen
analyses do not each re-read and re-join the sources.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import holiday_flag
from ..functions.text import join_items, parse_report
from ..operators import basket as B
from ..operators import ordered as O
from ..operators import sales as S
from ..operators import segments as G
from ..operators import stats as ST
from ..sources.files import clean, parse_date
from ..sources.schema import ANALYSIS_REQUIRED, columns_of_type, require_columns
from ..session import materialize
from ..sources.tables import enriched, prepared

FACT_COLUMNS = ["section", "item", "metric", "value"]
CORRELATION_FACTORS = ["day_number", "iso_week", "is_weekend", "weather_code", "holiday_code", "discount_pct",
                       "total_sales"]


def facts(df: DataFrame, section: str, item_cols: Sequence[str], metric_cols: Sequence[str]) -> DataFrame:
    """One table as (section, item, metric, value) rows: items joined with ' | ', values as double."""
    item = F.concat_ws(" | ", *[F.col(c).cast("string") for c in item_cols])
    base = df.select(item.alias("item"), *[F.col(c).cast("double").alias(c) for c in metric_cols])
    long = base.unpivot(["item"], list(metric_cols), "metric", "value")
    return long.select(F.lit(section).alias("section"), "item", "metric", "value")


def report_facts(df: DataFrame, order_cols: Sequence[str], predictions: DataFrame | None = None,
                 clusters: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """The ten-table result bundle as one long facts table.

    ``df`` is the base sales table; the bundle uses the week-filtered view.
    ``predictions`` (scored rows) and ``clusters`` (product, cluster) are added
    when given.  ``digits`` rounds the values half-even (for stable comparison).
    """
    needed = list(dict.fromkeys([*order_cols, "day_number", "iso_week", "is_weekend", "weather", "is_holiday",
                                 "discount_pct", "total_sales", "product_name", "profit_margin", "category",
                                 "season", "return_rate_pct", "month", "stock_after_sale", "transaction_id"]))
    # Eight sections read the same week-filtered rows: materialise the narrow projection once.
    prep = materialize(prepared(df).select(*needed))
    coded = O.factorize(prep, "weather", order_cols).withColumn("holiday_code", holiday_flag("is_holiday"))
    corr = ST.correlation_pairs(coded, CORRELATION_FACTORS)
    rules = B.association_rules(B.frequent_itemsets(B.baskets(prep))[0])
    rules = rules.withColumn("rule", F.concat(join_items("antecedent"), F.lit(" -> "), join_items("consequent")))
    seasons = S.seasonal_sales(prep)
    parts = [
        facts(S.sales_by_day_number(prep), "sales_by_day_of_week", ["day_number"], ["total_sales"]),
        facts(S.profit_margin_by_product(prep), "profit_analysis", ["product_name"], ["profit_margin"]),
        facts(S.sales_by_weather(prep), "weather_sales", ["weather"], ["total_sales"]),
        corr.select(F.lit("correlation_matrix").alias("section"), F.col("col1").alias("item"),
                    F.col("col2").alias("metric"), F.col("correlation").alias("value")),
        facts(seasons, "seasonal_sales", ["category"], seasons.columns[1:]),
        facts(S.return_rate_top5(prep), "return_analysis", ["product_name"], ["return_rate_pct"]),
        facts(S.monthly_inventory_turnover(prep), "monthly_stock_turnover", ["month"], ["inventory_turnover_rate"]),
        facts(rules, "association_rules", ["rule"], ["support", "confidence", "lift"]),
    ]
    if predictions is not None:
        parts.append(facts(predictions, "predicted_data", ["product_name"],
                           ["predicted_next_week_sales", "predicted_next_month_sales", "predicted_discount_pct"]))
    if clusters is not None:
        parts.append(facts(clusters, "clustered_data", ["product_name"], ["cluster"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if digits is not None:
        from ..functions.numeric import half_even
        out = out.withColumn("value", half_even("value", digits))
    return out


def parse_report_responses(df: DataFrame, col: str = "response") -> DataFrame:
    """Response text -> rating, insights, recommendations, challenges (fallback record when not JSON)."""
    parsed = parse_report(col).alias("_r")
    return df.withColumn("_r", parsed).select(
        *[c for c in df.columns],
        F.col("_r.store_performance_rating").alias("store_performance_rating"),
        F.col("_r.key_insights").alias("key_insights"),
        F.col("_r.recommendations").alias("recommendations"),
        F.col("_r.challenges").alias("challenges"))


def analysis_frame(df: DataFrame) -> DataFrame:
    """J3 cleaning: required columns (A2), lenient dates (B21) with bad rows dropped (B17), 0-fill."""
    require_columns(df, ANALYSIS_REQUIRED)
    typed = df.withColumn("date", parse_date(F.col("date").cast("string"), strict=False))
    return clean(typed, subset=["date"], fill=0)


KEY_COLUMNS = ("transaction_id", "line_no", "part_key", "supp_key")


def data_analysis(df: DataFrame, persist: bool = True,
                  exclude: Sequence[str] = KEY_COLUMNS) -> dict[str, DataFrame]:
    """The analysis service's seven results from one cleaned frame.

    The correlation summary covers every numeric column except identifiers
    (``exclude``), which are numbers only because of how the keys are stored.
    """
    raw = analysis_frame(df)
    if persist:
        raw = materialize(raw)
    cleaned = enriched(raw)
    numeric = [c for c in columns_of_type(df, "numeric") if c not in set(exclude)]
    # Raw columns: the calendar columns of ``cleaned`` replace some of the same name.
    summary = ST.correlation_summary(raw, numeric) if numeric else None
    out = {
        "correlation_summary": ST.correlation_summary_text(summary) if summary is not None else
        raw.sparkSession.range(1).select(F.lit(ST.NO_NUMERIC).alias("correlation_summary")),
        "category_sales": S.total_and_average_sales(cleaned, "category"),
        "weather_sales": S.total_and_average_sales(cleaned, "weather"),
        "monthly_sales_over_year": S.monthly_sales_over_year(cleaned),
        "product_sales": S.total_and_average_sales(cleaned, "product_name"),
        "season_sales": S.total_and_average_sales(cleaned, "season"),
        "day_of_week_sales": S.total_and_average_sales(cleaned, "day_of_week"),
    }
    return out


def dashboard_analysis(df: DataFrame, order_cols: Sequence[str], models: Mapping | None = None,
                       features: Mapping | None = None, vocab: Mapping | None = None,
                       persist: bool = True) -> dict[str, DataFrame]:
    """The dashboard's analyses in order.  D1 uses the unfiltered frame; all later ones
    share the week-filtered frame (Q1).  Scoring runs only when models are given."""
    raw = enriched(df)
    prep = prepared(df)
    if persist:
        prep = materialize(prep)
    sens = O.price_sensitivity(O.with_product_change(prep, order_cols))
    vec, weeks = G.product_week_vectors(prep)
    scaled = G.standardise_weekly(vec)
    clusters, _ = G.segment_products(scaled)
    itemsets, _n = B.frequent_itemsets(B.baskets(prep))
    rules = B.association_rules(itemsets)
    out = {
        "describe": ST.describe_numeric(df),
        "sales_by_day_of_week": S.sales_by_day_of_week(raw),
        "sales_by_week_of_month": S.sales_by_week_of_month(prep),
        "weather_sales": S.sales_by_weather(prep),
        "weather_temperature_sales": S.weather_temperature_sales(prep),
        "holiday_sales": S.sales_by_holiday(prep),
        "sales_factor_correlation": ST.sales_factor_correlation(
            O.factorize(prep, "weather", order_cols).withColumn("holiday_code", holiday_flag("is_holiday"))),
        "seasonal_sales": S.seasonal_sales(prep),
        "seasonal_sales_change": S.seasonal_sales_change(prep),
        "return_rate_top5": S.return_rate_top5(prep),
        "current_stock_top5": S.current_stock_top5(prep),
        "monthly_inventory_turnover": S.monthly_inventory_turnover(prep),
        "sales_by_discount": S.sales_by_discount(prep),
        "association_rules": rules,
        "bought_together": B.bought_together(rules),
        "growth_by_product": O.growth_by_product(O.with_growth(prep, order_cols)),
        "price_sensitivity": sens,
        "promotion_candidates": O.promotion_candidates(sens, prep),
        "category_performance": S.category_performance(prep),
        "product_segments": G.label_clusters(clusters),
        "clustered_products": G.clustered_products(G.label_clusters(clusters)),
    }
    if models and features and vocab:
        from ..operators import forecast as FC
        rows = FC.training_rows(df, order_cols)
        scored = FC.score(FC.with_features(rows, vocab), models, features)
        out["current_vs_predicted"] = FC.current_vs_predicted(scored)
        out["stock_sufficiency"] = FC.stock_sufficiency(scored, order_cols)
    return out
