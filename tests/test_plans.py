"""Physical-plan shape: what the optimizer is expected to do with our programs."""

import contextlib
import io

from helpers import SF_SMALL
from storelens.plans.catalog import QUERIES
from storelens.sources.tables import prepared, read_table, sales_view


def plan_of(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_view_keeps_lineitem_rows(spark):
    assert sales_view(spark, SF_SMALL).count() == read_table(spark, SF_SMALL, "lineitem").count()


def test_fact_table_is_streamed_and_dims_broadcast(spark):
    plan = plan_of(QUERIES["category_performance"](spark, SF_SMALL))
    assert "SortMergeJoin" in plan  # lineitem x orders on the order key
    assert "BroadcastHashJoin" in plan  # small dimensions under the threshold
    assert "PushedFilters" in plan


def test_column_pruning_reaches_the_scan(spark):
    plan = plan_of(QUERIES["sales_by_weather"](spark, SF_SMALL))
    lineitem_schema = [line for line in plan.splitlines()
                       if line.startswith("ReadSchema") and "l_orderkey" in line]
    assert lineitem_schema and "l_tax" not in lineitem_schema[0] and "l_shipdate" not in lineitem_schema[0]


def test_week_filter_runs_on_the_orders_side(spark):
    plan = plan_of(prepared(sales_view(spark, SF_SMALL)).groupBy("weather").count())
    # the week-of-month predicate is evaluated right above the orders scan, before any join
    lines = plan.splitlines()
    filt = [i for i, line in enumerate(lines) if "dayofmonth" in line and "Condition" in line]
    assert filt, plan


def test_no_python_udf_on_any_plan(spark):
    for name in ["sales_lags", "price_quantity_change", "baskets", "standardise_weekly", "hash_split",
                 "calendar_features", "weather_temperature_sales"]:
        plan = plan_of(QUERIES[name](spark, SF_SMALL), "extended")
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_shifts_use_bucket_exchange_not_product_window(spark):
    plan = plan_of(QUERIES["sales_lags"](spark, SF_SMALL))
    assert "hashpartitioning(_tb" in plan
    assert "hashpartitioning(product_name" not in plan
