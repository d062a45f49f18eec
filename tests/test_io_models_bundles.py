"""Sources/sinks, forecasting chain invariants and the J3/J4 bundles (sf0.001)."""

import tempfile

import pytest
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from helpers import SF_SMALL
from storelens.operators import forecast as FC
from storelens.operators import segments as G
from storelens.plans import report as RP
from storelens.sources import files as IO
from storelens.sources.schema import SALES_TYPES
from storelens.sources.tables import ORDER_COLS, prepared, sales_view


@pytest.fixture(scope="module")
def sales(spark):
    return sales_view(spark, SF_SMALL).cache()


def test_csv_roundtrip_with_display_names(spark, sales):
    out = tempfile.mkdtemp(prefix="storelens-csv-")
    src = sales.select("transaction_id", "date", "product_name", "quantity_sold", "total_sales", "weather",
                       "is_holiday").withColumn("transaction_id", F.col("transaction_id").cast("string"))
    IO.write_sales(src, out + "/t")
    back = IO.read_sales(spark, out + "/t")
    assert "Product Name" not in back.columns and "product_name" in back.columns
    assert dict(back.dtypes)["date"] == "date" and dict(back.dtypes)["quantity_sold"] == "bigint"
    assert back.count() == src.count()
    assert back.exceptAll(src).count() == 0


def test_to_records(sales):
    rec = IO.to_records(sales.select("product_name", "total_sales").limit(2)).collect()
    assert rec[0]["json"].startswith('{"product_name":')


def test_lenient_coercion(spark):
    df = spark.createDataFrame([("1.5", "x"), ("bad", "y")], "a string, b string")
    assert [r["a"] for r in IO.coerce_numeric(df, ["a"]).collect()] == [1.5, 0.0]


def _quick_models():
    return {
        "forest": lambda f, l, p: RandomForestRegressor(featuresCol=f, labelCol=l, predictionCol=p, numTrees=5,
                                                        maxDepth=4, seed=1),
        "boost": lambda f, l, p: GBTRegressor(featuresCol=f, labelCol=l, predictionCol=p, maxIter=3, maxDepth=2,
                                              seed=1),
    }


def test_training_selection_scoring(spark, sales):
    rows = FC.training_rows(sales, ORDER_COLS)
    vocab = FC.vocabulary(rows)
    frame = FC.with_features(rows, vocab).cache()
    feats = FC.feature_sets(vocab)
    assert "discount_pct" not in feats["discount"] and "discount_pct" in feats["weekly"]
    assert not ({"future_7_day_sales", "monthly_sales"} & set(feats["weekly"]))
    models, metrics = FC.train_all(frame, feats, _quick_models())
    m = metrics.collect()
    assert len(m) == 6
    for task in FC.TARGETS:
        mine = [r for r in m if r["task"] == task]
        best = [r for r in mine if r["selected"]]
        assert len(best) == 1 and best[0]["mse"] == min(r["mse"] for r in mine)
    scored = FC.score(frame, models, feats)
    assert scored.count() == frame.count()
    assert dict(scored.dtypes)["predicted_next_week_sales"] == "bigint"
    per = FC.predictions_by_product(scored)
    assert per.count() == frame.select("product_name").distinct().count()
    assert FC.predictions_by_product(scored, drop_first_product=True).count() == per.count() - 1
    suff = FC.stock_sufficiency(scored, ORDER_COLS).collect()
    assert all(r["adequate"] == (r["projected_stock"] >= 0) for r in suff)
    cvp = FC.current_vs_predicted(scored)
    assert cvp.count() == per.count()

    path = tempfile.mkdtemp(prefix="storelens-models-")
    FC.save_models(models, feats, path, spark, vocab)
    loaded, lfeats = FC.load_models(spark, path)
    assert FC.load_vocabulary(spark, path) == {c: list(v) for c, v in vocab.items()}
    assert lfeats == feats
    again = FC.score(frame, loaded, lfeats)
    key = ["transaction_id", "line_no", "part_key", "supp_key"]
    cols = key + ["predicted_next_week_sales", "predicted_next_month_sales", "predicted_discount_pct"]
    assert again.select(*cols).exceptAll(scored.select(*cols)).count() == 0

    dash = RP.dashboard_analysis(sales, ORDER_COLS, models, feats, vocab)
    assert dash["current_vs_predicted"].count() == per.count()
    assert dash["stock_sufficiency"].count() == per.count()

    row = {"temperature_c": 25.0, "humidity_pct": 70, "precipitation_mm": 0.0, "wind_speed_kmh": 10.0,
           "is_holiday_flag": 0, "is_weekend": 0, "is_special_event": 1, "day": 15, "month": 7, "year": 2023,
           "weather": "Sunny", "season": "Summer", "category": vocab["category"][0],
           "product_name": vocab["product_name"][-1]}
    one = FC.what_if(spark, row, models, feats, vocab).collect()
    assert len(one) == 1 and one[0]["predicted_next_month_sales"] is not None


def test_null_feature_scores_like_zero_and_columns_come_back(spark, sales):
    rows = FC.training_rows(sales, ORDER_COLS)
    models = FC.fit_lines(rows)
    one = rows.limit(1).withColumn("quantity_sold", F.lit(None).cast("long"))
    zero = one.withColumn("quantity_sold", F.lit(0).cast("long"))
    gone = one.drop("quantity_sold")
    got = [[r[c] for c in FC.PREDICTIONS] for f in (one, zero, gone) for r in FC.score(f, models, FC.LINE_FEATURES).collect()]
    assert got[0] == got[1] == got[2]
    assert FC.score(one, models, FC.LINE_FEATURES).first()["quantity_sold"] is None


def test_full_csv_round_trip_with_fractional_lags(spark, sales):
    lagged = FC.training_rows(sales, ORDER_COLS).select(*[c for c in SALES_TYPES])
    typed = lagged.select(*[F.col(c).cast(t).alias(c) for c, t in SALES_TYPES.items()])
    out = tempfile.mkdtemp(prefix="storelens-csv-")
    IO.write_sales(typed, out + "/t")
    assert any(",5.0," in line for line in spark.read.text(out + "/t").toPandas()["value"])
    back = IO.read_sales(spark, out + "/t")
    assert back.dtypes == typed.dtypes and len(back.columns) == 27
    assert back.exceptAll(typed).count() == 0 and back.count() == typed.count()


def test_fact_rows_are_not_dealt_out_by_a_tiny_key(spark, sales):
    from storelens.operators import ordered as O
    rows = sales.select("transaction_id", "line_no", "product_name", "weather", "quantity_sold").checkpoint()
    for df in (O.with_group_mean(rows, "product_name", ["quantity_sold"]), O.factorize(rows, "weather", ["transaction_id", "line_no"])):
        df.count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(product_name" not in plan and "hashpartitioning(weather" not in plan


def test_a_query_joins_only_the_tables_it_needs(spark):
    plan = sales_view(spark, SF_SMALL, ["date", "total_sales"])._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" not in plan and "c_custkey" not in plan and plan.count("Relation") == 2
    assert sales_view(spark, SF_SMALL, ["date", "total_sales"]).columns == ["date", "total_sales"]


def test_segments_invariants(spark, sales):
    prep = prepared(sales)
    vec, weeks = G.product_week_vectors(prep)
    scaled = G.standardise_weekly(vec)
    for r in scaled.collect():
        z = r["scaled"]
        mean = sum(z) / len(z)
        var = sum((x - mean) ** 2 for x in z) / len(z)
        assert abs(mean) < 1e-9 and (abs(var - 1.0) < 1e-9 or var == 0.0)
    clusters, cost = G.segment_products(scaled, restarts=3)
    got = clusters.collect()
    assert len(got) == vec.count() and len({r["product_name"] for r in got}) == len(got)
    assert {r["cluster"] for r in got} <= {0, 1, 2}
    named = G.label_clusters(clusters, by="demand", vectors=vec)
    assert named.filter(F.col("cluster_name").isNull()).count() == 0


def test_bundles(spark, sales):
    res = RP.data_analysis(sales)
    assert set(res) == {"correlation_summary", "category_sales", "weather_sales", "monthly_sales_over_year",
                        "product_sales", "season_sales", "day_of_week_sales"}
    assert res["monthly_sales_over_year"].count() == 12
    assert isinstance(res["correlation_summary"].first()[0], str)
    dash = RP.dashboard_analysis(sales, ORDER_COLS)
    assert dash["sales_by_week_of_month"].count() == 4
    assert dash["bought_together"].count() <= 10
    facts = RP.report_facts(sales, ORDER_COLS)
    assert facts.columns == RP.FACT_COLUMNS


def test_tune_small_grid(spark, sales):
    rows = FC.training_rows(sales, ORDER_COLS)
    vocab = FC.vocabulary(rows)
    frame = FC.with_features(rows, vocab)
    feats = FC.feature_sets(vocab)
    model, params = FC.tune(frame, "weekly", feats["weekly"], grid={"numTrees": [3, 5], "maxDepth": [2, 3]})
    assert set(params) == {"numTrees", "maxDepth"}
    assert model.transform(frame).select("pred_weekly").count() == frame.count()
