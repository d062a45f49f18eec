"""Hand-made edge frames (FIXTURES.md section 4) with hand-computed answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F


from storelens.functions import calendar as C
from storelens.functions import numeric as N
from storelens.functions import text as X
from storelens.operators import basket as B
from storelens.operators import ordered as O
from storelens.operators import sales as S
from storelens.operators import stats as ST
from storelens.plans import report as RP
from storelens.sources import files as IO
from storelens.sources.schema import align_features, require_columns


def test_bin_edges(spark):
    df = spark.createDataFrame([(t,) for t in [-10.0, -9.9, 10.0, 10.1, 40.0, 40.1]], "t double")
    got = [r["b"] for r in df.select(C.temperature_bin("t").alias("b")).collect()]
    assert got == [None, "Cold", "Cold", "Mild", "Hot", None]


def test_month_end_week_of_month(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, d),) for d in [1, 7, 8, 28, 29, 31]], "date date")
    got = [r["w"] for r in df.select(C.week_of_month("date").alias("w")).collect()]
    assert got == [1, 1, 2, 4, 5, 5]
    # B8 keeps weeks 1-4 only: days 29 and 31 drop out.
    assert df.filter(C.week_of_month("date") <= 4).count() == 4


def test_iso_week_sunday(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 3),)], "date date")
    r = df.select(C.iso_week("date").alias("w"), C.day_number("date").alias("n"),
                  C.day_name("date").alias("d"), C.month_name("date").alias("m")).first()
    assert (r["w"], r["n"], r["d"], r["m"]) == (53, 6, "Sunday", "January")


def test_half_even(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (2.5,)], "x double")
    got = [(r["a"], r["b"]) for r in df.select(N.half_even("x", 2).alias("a"), N.half_even("x", 0).alias("b")).collect()]
    assert [g[0] for g in got[:2]] == [0.12, 2.68]
    assert got[2][1] == 2.0


def test_zero_divisor(spark):
    df = spark.createDataFrame([("p", 0, 0.0, 0.0, 1)], "product_name string, quantity_sold long, total_sales double, net_sales double, returned int")
    out = N.with_return_rate(N.with_margin(df)).first()
    assert out["profit_margin"] is None and out["return_rate_pct"] is None
    mean = S.top_mean(N.with_return_rate(df), "product_name", "return_rate_pct").first()
    assert mean["return_rate_pct"] is None


def test_constant_column(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "c double, x double")
    pairs = {(r["col1"], r["col2"]): r["correlation"] for r in ST.correlation_pairs(df, ["c", "x"]).collect()}
    assert pairs[("c", "x")] is None and pairs[("x", "x")] == pytest.approx(1.0)


def test_bad_dates(spark):
    df = spark.createDataFrame([("2023-01-02", 1.0), ("bad", 2.0)], "date string, total_sales double")
    with pytest.raises(ValueError):
        IO.reject_invalid_dates(df)
    cleaned = IO.clean(df.withColumn("date", IO.parse_date("date")), subset=["date"])
    assert cleaned.count() == 1


def test_null_keys_and_all_null_sum(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None), ("b", 2.5)], "weather string, total_sales double")
    got = {r["weather"]: r["total_sales"] for r in S.sales_by(df, "weather").collect()}
    assert got == {"a": 0.0, "b": 2.5}


def test_first_seen_factorize(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, "x")], "o int, w string")
    got = [r["w_code"] for r in O.factorize(df, "w", ["o"]).orderBy("o").collect()]
    assert got == [0, -1, 1, 0]


def test_lag_counts_rows_not_days(spark):
    dates = [dt.date(2023, 1, d) for d in [1, 2, 5, 9, 10]]
    df = spark.createDataFrame([(d, "p", i + 1) for i, d in enumerate(dates)], "date date, product_name string, quantity_sold long")
    out = O.with_lags(df, ["date"], lags=(1,), lead=None).orderBy("date").collect()
    assert [r["sales_lag_1"] for r in out] == [None, 1, 2, 3, 4]


def test_fill_then_change(spark):
    df = spark.createDataFrame([(1, "p", 2.0, 1), (2, "p", None, 1), (3, "p", 4.0, 1)],
                               "o int, product_name string, unit_price double, quantity_sold long")
    out = O.with_product_change(df, ["o"]).orderBy("o").collect()
    assert [r["price_change_pct"] for r in out] == [None, 0.0, 100.0]


def test_three_items_rules(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "d")],
                               "transaction_id int, product_name string")
    sets, n = B.frequent_itemsets(B.baskets(df), 0.3)
    assert n == 3 and sets.count() == 9
    rules = B.association_rules(sets, min_lift=0.0)
    assert rules.count() == 14
    assert rules.filter(F.size("consequent") == 2).count() == 3
    for r in rules.collect():
        assert r["confidence"] == pytest.approx(r["support"] / r["antecedent_support"])


def test_season_pct_zero_column(spark):
    df = spark.createDataFrame([("c", "Fall", 0.0), ("c", "Spring", 1.0), ("c", "Winter", 0.0)],
                               "category string, season string, total_sales double")
    r = S.seasonal_sales_change(df).first()
    assert r["fall"] is None and r["spring"] is None  # x/0 -> NULL (policy Q7)
    assert r["winter"] == -100.0 and "summer" not in S.seasonal_sales_change(df).columns  # a season that never occurs


def test_observed_seasons_money_and_unmatched_names(spark):
    df = spark.createDataFrame([("c", "Autumn", 0.004), ("c", "Autumn", 0.004), ("c", "Autumn", 0.004), ("d", None, 1.0)],
                               "category string, season string, total_sales double")
    got = {r["category"]: r["autumn"] for r in S.seasonal_sales(df).collect()}
    assert got == {"c": 0.012, "d": 0.0}
    assert {r["season"]: r["total_sales"] for r in S.sales_by(df, "season").collect()} == {"Autumn": 0.012}


def test_null_product_has_no_lags(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, "p", 7), (4, "p", 8)],
                               "o int, product_name string, quantity_sold long")
    got = {r["o"]: r["sales_lag_1"] for r in O.with_lags(df, ["o"], lags=(1,), lead=None).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 7}


def test_attach_keeps_every_row_broadcast_or_salted(spark):
    from storelens.session import attach
    df = spark.createDataFrame([(i, "hot" if i % 3 else "k") for i in range(60)] + [(99, None)], "i int, k string")
    table = spark.createDataFrame([("hot", 1), ("k", 2)], "k string, v int")
    want = sorted((i, {"hot": 1, "k": 2}.get(k)) for i, k in df.collect())
    for most in (10, 0):
        assert sorted((r["i"], r["v"]) for r in attach(df, table, "k", max_rows=most).collect()) == want


def test_describe_of_a_two_valued_column_collects_a_few_numbers(spark):
    df = spark.range(5000).select((F.col("id") % 2).cast("double").alias("flag"), F.col("id").cast("double").alias("x"))
    assert ST.value_counts(df, ["flag"]).count() == 2
    got = {r["stat"]: (r["flag"], r["x"]) for r in ST.describe_numeric(df, ["flag", "x"]).collect()}
    assert got["25%"] == (0.0, 1249.75) and got["50%"] == (0.5, 2499.5) and got["75%"] == (1.0, 3749.25)
    assert got["count"] == (5000.0, 5000.0) and got["std"][0] == pytest.approx(0.50005, abs=1e-5)


def test_dummies_of_like_names_stay_apart(spark):
    from storelens.operators import forecast as FC
    df = spark.createDataFrame([("Smart TV",), ("Smart-TV",), ("电视",), ("冰箱",)], "product_name string")
    vocab = FC.vocabulary(df, ["product_name"])
    assert len(set(FC.dummy_names(vocab))) == 3
    rows = FC.one_hot(df, vocab).select(*FC.dummy_names(vocab)).collect()
    assert sorted(sum(r) for r in rows) == [0, 1, 1, 1] and len(set(map(tuple, rows))) == 4
    sparse = FC.sparse_encoder(["product_name"]).fit(df).transform(df)
    assert len({str(r["product_name_onehot"]) for r in sparse.collect()}) == 4


def test_holiday_feature_takes_numbers_and_words(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("1",), ("0",), ("1.0",), ("true",), (None,)], "h string")
    assert [r["x"] for r in df.select(C.holiday_number("h").alias("x")).collect()] == [1, 0, 1, 0, 1, 1, 0]


def test_more_clusters_than_names(spark):
    from storelens.operators.segments import clustered_products, label_clusters
    df = spark.createDataFrame([("a", 0), ("b", 3), ("c", 4)], "product_name string, cluster int")
    named = label_clusters(df)
    assert {r["product_name"]: r["cluster_name"] for r in named.collect()} == \
        {"a": "High Demand Products", "b": "Cluster 3", "c": "Cluster 4"}
    listed = clustered_products(named).collect()[0]
    assert listed["Cluster 3"] == "b" and listed["Cluster 4"] == "c"


def test_analysis_service_on_the_required_columns(spark):
    df = spark.createDataFrame([("2024-01-06", 5.0, "p", "Sunny", "No", "Winter", "c"), ("bad", 1.0, "p", "Sunny", "No", "Winter", "c")],
                               "date string, total_sales double, product_name string, weather string, is_holiday string, "
                               "season string, category string")
    out = RP.data_analysis(df)
    assert out["day_of_week_sales"].collect()[0]["day_of_week"] == "Saturday" and out["category_sales"].first()["total_sales"] == 5.0


def test_analysis_service_correlates_raw_columns(spark):
    rows = [(f"2024-01-{d:02d}", float(d % 2 * 10 + d * 0.01), "p", "Sunny", "No", "Winter", "c", d % 2) for d in range(1, 29)]
    df = spark.createDataFrame(rows, "date string, total_sales double, product_name string, weather string, "
                                     "is_holiday string, season string, category string, is_weekend int")
    text = RP.data_analysis(df)["correlation_summary"].first()[0]
    assert "Strong correlation between total_sales and is_weekend" in text


def test_preview_is_a_top_n(spark):
    assert [r["id"] for r in IO.preview(spark.range(100), ["id"], 3).collect()] == [0, 1, 2]


def test_ties_break_on_key(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.5)], "product_name string, return_rate_pct double")
    got = [r["product_name"] for r in S.return_rate_top5(df, n=2).orderBy("rank").collect()]
    assert got == ["a", "b"]


def test_sanitize_predictions(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.5,), (3.5,)], "x double")
    assert [r["s"] for r in df.select(N.sanitize("x").alias("s")).collect()] == [0, 0, 2, 4]


def test_fenced_json(spark):
    good = '```json\n{"store_performance_rating": "good", "key_insights": ["a"], "recommendations": [], "challenges": ["c"]}\n```'
    df = spark.createDataFrame([(good,), ("oops",)], "response string")
    out = RP.parse_report_responses(df).collect()
    assert out[0]["store_performance_rating"] == "good" and out[0]["key_insights"] == ["a"]
    assert out[1]["store_performance_rating"] == "unknown"
    assert out[1]["key_insights"] == ["Error occurred while processing data"]
    assert out[1]["recommendations"] == []


def test_ragged_clusters(spark):
    from storelens.operators.segments import clustered_products
    df = spark.createDataFrame([("a", "High Demand Products"), ("b", "High Demand Products"),
                                ("c", "High Demand Products"), ("d", "Seasonal Products")],
                               "product_name string, cluster_name string")
    out = clustered_products(df).collect()
    assert len(out) == 3
    assert [r["Seasonal Products"] for r in out] == ["d", None, None]
    assert all(r["Low Demand Products"] is None for r in out)


def test_require_columns_lists_missing(spark):
    df = spark.createDataFrame([(1,)], "date int")
    with pytest.raises(ValueError, match="Missing required columns: total_sales, weather"):
        require_columns(df, ["date", "total_sales", "weather"])


def test_align_features(spark):
    df = spark.createDataFrame([(1.0, 2.0, 9.0)], "a double, b double, extra double")
    out = align_features(df, ["b", "missing", "a"])
    assert out.columns == ["b", "missing", "a"] and tuple(out.first()) == (2.0, 0.0, 1.0)


def test_capitalize_and_strip(spark):
    df = spark.createDataFrame([("gOOD", "``json{}``")], "s string, t string")
    r = df.select(X.capitalize_word("s").alias("c"), X.strip_fence("t").alias("f")).first()
    assert r["c"] == "Good" and r["f"] == "{}"


def test_lookup_and_prefix(spark):
    df = spark.createDataFrame([("Smartphone",), ("Unseen",)], "product_name string")
    out = N.lookup(df, "product_name", {"Smartphone": "Gadgets"}, "category", default="Unknown").collect()
    assert [r["category"] for r in out] == ["Gadgets", "Unknown"]
    r = df.select(X.strip_prefix(F.lit("Product Name_Oven"), "Product Name_").alias("p")).first()
    assert r["p"] == "Oven"
