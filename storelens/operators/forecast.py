"""Features, model selection and batch scoring.

Training and serving share one feature function and one stored feature list
per task (so the reference's training/serving drift, Q8, cannot happen).  Every
fit is a Spark ML estimator on the assembled vector; scoring is
``PipelineModel.transform``, JVM-side, with no Python on the data path.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import holiday_number
from ..functions.numeric import half_even, projected_stock, sanitize
from ..session import literal_frame, materialize, materialize_packed, release
from ..sources.files import clean, coerce_numeric, reject_invalid_dates
from .ordered import latest_per, with_lags
from .sales import with_monthly_sales
from .stats import regression_metrics
from .trees import DeepForest, SecondOrderBoosting

CATEGORICAL = ["weather", "season", "category", "product_name"]
NUMERIC = ["quantity_sold", "unit_price", "stock_after_sale", "returned", "temperature_c", "humidity_pct",
           "precipitation_mm", "wind_speed_kmh", "is_holiday_flag", "is_weekend", "is_special_event",
           "total_sales", "total_after_discount", "net_sales", "discount_pct",
           "sales_lag_1", "sales_lag_7", "sales_lag_14", "day", "month", "year"]
TARGETS = {"weekly": "future_7_day_sales", "monthly": "monthly_sales", "discount": "discount_pct"}
NOT_FEATURES = {"future_7_day_sales", "monthly_sales"}
KEY_COLS = ("transaction_id", "line_no", "part_key", "supp_key")


def training_rows(df: DataFrame, order_cols: Sequence[str], write_once: bool = True,
                  write: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """The training table: lags 1/7/14 and the 7-row lead per product (E1, E2), rows with a
    missing lag or lead dropped (B16), then the (product, month) quantity total (C2).

    The lagged rows feed several aggregates joined back (monthly totals, group
    means, latest rows) and every model fit; ``write_once`` keeps them as a
    reliable checkpoint so the windowed stage is not recomputed per branch.
    ``write`` makes such checkpoints.
    """
    shifted = with_lags(df, order_cols, write=write)
    kept = shifted.na.drop(subset=["sales_lag_1", "sales_lag_7", "sales_lag_14", "future_7_day_sales"])
    return with_monthly_sales(write(kept) if write_once else kept)


def vocabulary(df: DataFrame, cols: Sequence[str] = CATEGORICAL) -> dict[str, list[str]]:
    """Sorted distinct values of each categorical column (one small aggregate per column).

    Meant for categorical columns (weather, season, category, product): the
    vocabulary becomes the stored feature list.  A column with a vocabulary in
    the millions belongs in ``sparse_encoder`` instead.
    """
    return {c: sorted(r[0] for r in df.filter(F.col(c).isNotNull()).select(c).distinct().collect())
            for c in cols}


def dummy_table(vocab: Mapping[str, Sequence[str]], drop_first: bool = True) -> list[tuple[str, str, str]]:
    """(column, value, dummy name) of every dummy: named by position (``weather_0001``), so no two values can
    share a name whatever their characters; the alphabetically first value has none."""
    skip = 1 if drop_first else 0
    return [(c, v, f"{c}_{i:04d}") for c, values in vocab.items() for i, v in enumerate(values) if i >= skip]


def one_hot(df: DataFrame, vocab: Mapping[str, Sequence[str]], drop_first: bool = True) -> DataFrame:
    """A 0/1 column per value of ``dummy_table``; NULL is all zeros."""
    cols = {name: F.when(F.col(c) == F.lit(v), 1).otherwise(0).cast("int") for c, v, name in dummy_table(vocab, drop_first)}
    return df.withColumns(cols) if cols else df


def dummy_names(vocab: Mapping[str, Sequence[str]], drop_first: bool = True) -> list[str]:
    return [name for _, _, name in dummy_table(vocab, drop_first)]


def sparse_encoder(cols: Sequence[str]) -> Pipeline:
    """I9 for large vocabularies: sparse 0/1 vectors ``<col>_onehot``, no column per value.

    Values are numbered alphabetically and the last one is dropped (a vector
    encoder drops the last category); unseen values and NULL are all zeros.
    """
    index = StringIndexer(inputCols=list(cols), outputCols=[f"{c}_index" for c in cols],
                          stringOrderType="alphabetAsc", handleInvalid="keep")
    return Pipeline(stages=[index, OneHotEncoder(inputCols=[f"{c}_index" for c in cols],
                                                 outputCols=[f"{c}_onehot" for c in cols], handleInvalid="keep")])


def with_features(df: DataFrame, vocab: Mapping[str, Sequence[str]]) -> DataFrame:
    """I11 inputs: date parts (Day, Month, Year), the holiday flag as a number, one-hot columns."""
    out = df.withColumns({
        "day": F.dayofmonth("date"), "month": F.month("date"), "year": F.year("date"),
        "is_holiday_flag": holiday_number("is_holiday"),
    })
    return one_hot(out, vocab)


def feature_sets(vocab: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """The stored feature list of each task (target and the other targets excluded)."""
    base = [c for c in NUMERIC if c not in NOT_FEATURES] + dummy_names(vocab)
    return {task: [c for c in base if c != target] for task, target in TARGETS.items()}


def hash_split(df: DataFrame, key_cols: Sequence[str], test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Deterministic 80/20 split: ``is_test`` from the first 8 hex digits of md5(seed|keys).

    Independent of partitioning and reproducible in any SQL engine with md5.
    """
    threshold = format(int((1.0 - test_fraction) * (1 << 32)), "08x")
    h = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols])), 1, 8)
    return df.withColumn("is_test", (h >= F.lit(threshold)).cast("int"))


def task_memory_mb(spark: SparkSession) -> int | None:
    """Configured memory of one executor (the driver in local mode), in MB; None when it is not configured."""
    conf = spark.sparkContext.getConf()
    key = "spark.driver.memory" if spark.sparkContext.master.startswith("local") else "spark.executor.memory"
    text = (conf.get(key, None) or "").strip().lower()
    if not text:
        return None
    units = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}
    if text[-1] in units:
        return int(float(text[:-1]) * units[text[-1]])
    return int(float(text) / (1024 * 1024))


def candidates(seed: int = 42, key_cols: Sequence[str] = KEY_COLS) -> dict:
    """I12-I14 with library defaults: a 100-tree forest without depth limit, all features at each split; 100 boosting
    rounds at rate 0.1 depth 3; and 100 second-order rounds at rate 0.3 depth 6 with leaf penalty 1."""
    return {
        "random_forest": lambda f, l, p: DeepForest(f, l, p, key_cols, trees=100, seed=seed),
        "gradient_boosting": lambda f, l, p: GBTRegressor(
            featuresCol=f, labelCol=l, predictionCol=p, maxIter=100, stepSize=0.1, maxDepth=3, seed=seed),
        "boosted_trees": lambda f, l, p: SecondOrderBoosting(f, l, p, rounds=100, rate=0.3, depth=6, lam=1.0),
    }


ROWS_PER_TASK = 8_000  # rows of one partition of the model table


def model_table(frame: DataFrame, features: Mapping[str, list[str]], key_cols: Sequence[str] = KEY_COLS,
                test_fraction: float = 0.2) -> DataFrame:
    """What every fit reads, written once: labels, ``is_test`` and the assembled vector of each task.

    NULL features are 0 (as in ``score``).  Tasks with one feature list share a
    vector.  Rows are dealt out by key into as many partitions as their number
    asks for, and sorted, so bagging does not depend on the session's settings.
    They are stored packed, a column per feature, and assembled where they are read.
    """
    lists = {tuple(f): f"_features_{t}" for t, f in reversed(list(features.items()))}
    used = sorted({c for f in lists for c in f})
    split = hash_split(_zero_filled(frame, used), key_cols, test_fraction)
    labels = [c for c in dict.fromkeys(TARGETS[t] for t in features)]
    held = materialize_packed(split.select(*dict.fromkeys([*key_cols, *labels, "is_test", *used])))
    parts = 1 + held.count() // ROWS_PER_TASK
    table = materialize_packed(held.repartition(parts, *key_cols).sortWithinPartitions(*key_cols))
    for cols, name in lists.items():
        table = VectorAssembler(inputCols=list(cols), outputCol=name, handleInvalid="keep").transform(table)
    return table.select(*key_cols, *labels, "is_test", *lists.values())


def _filled_columns(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """Every listed column as a double: NULL is 0, and so is a column that is not there."""
    have = set(df.columns)
    return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0) for c in cols]


def _zero_filled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns(dict(zip(cols, _filled_columns(df, cols))))


def train_all(frame: DataFrame, features: Mapping[str, list[str]], models: Mapping | None = None,
              key_cols: Sequence[str] = KEY_COLS, test_fraction: float = 0.2,
              parallelism: int = 9) -> tuple[dict[str, PipelineModel], DataFrame]:
    """I16 + I17: for each task fit every candidate on the train split, score the test
    split (I15), keep the lowest-MSE model.  Returns the winners and the metrics table.

    Fits are independent Spark jobs over one stored table; up to ``parallelism`` of
    them are submitted at once from driver threads so small boosting iterations
    overlap.  A memory that is configured limits how many.
    """
    from concurrent.futures import ThreadPoolExecutor

    spark = frame.sparkSession
    mem_mb = task_memory_mb(spark)
    if mem_mb:
        parallelism = max(1, min(parallelism, mem_mb // 2048))
    models = models or candidates(key_cols=key_cols)
    table = model_table(frame, features, key_cols, test_fraction)
    release(spark)
    train, test = table.filter("is_test = 0"), table.filter("is_test = 1")
    vectors = {t: next(v for v in (f"_features_{u}" for u, f in features.items() if f == features[t])
                       if v in table.columns) for t in features}

    def fit_one(job):
        task, name = job
        fitted = models[name](vectors[task], TARGETS[task], f"pred_{task}").fit(train)
        m = regression_metrics(fitted.transform(test), TARGETS[task], f"pred_{task}").first()
        release(spark)
        return task, name, float(m["mse"]), None if m["r2"] is None else float(m["r2"]), fitted

    jobs = [(t, n) for t in features for n in models]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        results = list(pool.map(fit_one, jobs))
    winners, rows = {}, []
    for task in features:
        mine = [r for r in results if r[0] == task]
        best = min(mine, key=lambda r: r[2])
        assemble = VectorAssembler(inputCols=list(features[task]), outputCol=vectors[task], handleInvalid="keep")
        winners[task] = PipelineModel(stages=[assemble, best[4]])
        rows += [(task, n, mse, r2, n == best[1]) for _, n, mse, r2, _ in mine]
    schema = T.StructType([T.StructField("task", T.StringType()), T.StructField("model", T.StringType()),
                           T.StructField("mse", T.DoubleType()), T.StructField("r2", T.DoubleType()),
                           T.StructField("selected", T.BooleanType())])
    return winners, literal_frame(spark, rows, schema)


# One-feature lines: the feature of each task.
LINE_FEATURES = {"weekly": ["sales_lag_7"], "monthly": ["quantity_sold"], "discount": ["quantity_sold"]}


def fit_lines(frame: DataFrame, features: Mapping[str, list[str]] = LINE_FEATURES) -> dict[str, PipelineModel]:
    """A least-squares model per task (normal equations, no penalty): a closed form that SQL has too,
    so the scoring chain can be checked row by row."""
    models = {}
    used = list(dict.fromkeys([c for cols in features.values() for c in cols] + [TARGETS[t] for t in features]))
    # Read several times by every fit: only its columns, written once.
    frame = materialize(frame.select(*[c for c in used if c in frame.columns]))
    for task, cols in features.items():
        vec = f"_features_{task}"
        models[task] = Pipeline(stages=[
            VectorAssembler(inputCols=list(cols), outputCol=vec, handleInvalid="keep"),
            LinearRegression(featuresCol=vec, labelCol=TARGETS[task], predictionCol=f"pred_{task}", solver="normal",
                             regParam=0.0)]).fit(_zero_filled(frame, cols).withColumn(
                                 TARGETS[task], F.col(TARGETS[task]).cast("double")))
    return models


def score(frame: DataFrame, models: Mapping[str, PipelineModel], features: Mapping[str, list[str]],
          keep: Sequence[str] | None = None) -> DataFrame:
    """Three predictions per row, sanitised.

    As the reference does before it predicts, NULL features are 0 and features
    that the frame lacks are 0 (B15).  The frame's own columns come back unchanged.
    """
    keep = list(keep) if keep is not None else list(frame.columns)
    out = frame
    for task, model in models.items():
        cols = list(features[task])
        out = out.withColumns({f"_{task}_{i}": c for i, c in enumerate(_filled_columns(frame, cols))})
        stages = [s.copy() for s in model.stages]
        stages[0] = stages[0].copy({stages[0].inputCols: [f"_{task}_{i}" for i in range(len(cols))]})
        out = PipelineModel(stages=stages).transform(out).drop(stages[0].getOutputCol()) \
            .withColumn(f"pred_{task}", sanitize(f"pred_{task}"))
    return out.select(*keep, *[F.col(f"pred_{t}") for t in models]).withColumnsRenamed({
        "pred_weekly": "predicted_next_week_sales",
        "pred_monthly": "predicted_next_month_sales",
        "pred_discount": "predicted_discount_pct",
    })


PREDICTIONS = ["predicted_next_week_sales", "predicted_next_month_sales", "predicted_discount_pct"]


def predictions_by_product(scored: DataFrame, drop_first_product: bool = False,
                           key: str = "product_name") -> DataFrame:
    """Mean prediction per product, rounded half-even to an integer.

    ``drop_first_product=True`` reproduces the reference's missing first product (Q9).
    """
    src = scored.filter(F.col(key).isNotNull())
    if drop_first_product:
        first = src.agg(F.min(key)).first()[0]  # one scalar
        src = src.filter(F.col(key) != F.lit(first))
    return (src.groupBy(key)
            .agg(*[F.rint(F.avg(c)).cast("long").alias(c) for c in PREDICTIONS])
            .orderBy(key))


def current_vs_predicted(scored: DataFrame, key: str = "product_name") -> DataFrame:
    """Per product the rounded current averages (E6) and the rounded mean predictions, from one aggregate."""
    cols = {"current_avg_weekly_sales": "future_7_day_sales", "predicted_next_week_sales": "predicted_next_week_sales",
            "predicted_next_month_sales": "predicted_next_month_sales", "current_avg_discount_pct": "discount_pct",
            "predicted_discount_pct": "predicted_discount_pct"}
    return (scored.groupBy(key).agg(*[half_even(F.avg(c), 0).alias(name) for name, c in cols.items()])
            .orderBy(key))


def stock_sufficiency(scored: DataFrame, order_cols: Sequence[str], key: str = "product_name",
                      predicted: str = "predicted_next_month_sales") -> DataFrame:
    """The latest row per product (E7), projected stock = current - predicted (B7),
    and ``adequate`` (projection >= 0); split with ``filter('adequate')`` / ``filter('NOT adequate')``."""
    cols = list(dict.fromkeys([key, *order_cols, "stock_after_sale", predicted]))
    return _projected(latest_per(scored.select(*cols), key, order_cols), key, predicted)


def stock_against_mean(rows: DataFrame, order_cols: Sequence[str], value: str = "monthly_sales",
                       key: str = "product_name", predicted: str = "predicted_next_month_sales") -> DataFrame:
    """I21 with the product's rounded mean of ``value`` as the prediction: latest stock and mean from one aggregate."""
    latest = (rows.filter(F.col(key).isNotNull()).groupBy(key)
              .agg(F.max_by("stock_after_sale", F.struct(*[F.col(c) for c in order_cols])).alias("stock_after_sale"),
                   half_even(F.avg(value), 0).alias(predicted)))
    return _projected(latest, key, predicted)


def _projected(latest: DataFrame, key: str, predicted: str) -> DataFrame:
    proj = projected_stock("stock_after_sale", predicted)
    return latest.select(key, F.col("stock_after_sale").alias("current_stock"), F.col(predicted),
                         proj.alias("projected_stock"), (proj >= 0).alias("adequate"))


def predict_products(df: DataFrame, models: Mapping[str, PipelineModel], features: Mapping[str, list[str]],
                     vocab: Mapping[str, Sequence[str]]) -> DataFrame:
    """The prediction service in one call: a raw sales frame to one row of mean predictions per product.

    Dates are checked (A7), numbers that came as text are coerced and gaps are 0
    (B18, B20), categories become the stored dummies (I9), missing features are 0
    (B15), predictions are sanitised (H12) and averaged per product (I19).
    """
    dated = reject_invalid_dates(df)
    text = {c for c, t in dated.dtypes if t == "string"}
    coerced = coerce_numeric(dated, [c for c in NUMERIC if c in text])
    frame = clean(with_features(coerced, vocab), fill=0)
    return predictions_by_product(score(frame, models, features))


def what_if(spark: SparkSession, row: Mapping[str, object], models: Mapping[str, PipelineModel],
            features: Mapping[str, list[str]], vocab: Mapping[str, Sequence[str]]) -> DataFrame:
    """Score one hand-made row; absent features are 0."""
    df = spark.createDataFrame([dict(row)])
    for c in CATEGORICAL:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    encoded = one_hot(df, vocab)
    return score(encoded, models, features, keep=[c for c in df.columns])


def save_models(models: Mapping[str, PipelineModel], features: Mapping[str, list[str]], path: str,
                spark: SparkSession, vocab: Mapping[str, Sequence[str]] | None = None) -> None:
    """A4: one PipelineModel directory per task, a (task, position, feature) table, and with ``vocab`` the
    (source, position, value, feature) table of the dummies."""
    for task, model in models.items():
        model.write().overwrite().save(f"{path}/{task}")
    rows = [(t, i, f) for t, feats in features.items() for i, f in enumerate(feats)]
    schema = "task string, position int, feature string"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/features")
    if vocab is not None:
        named = {(c, v): name for c, v, name in dummy_table(vocab)}
        rows = [(c, i, v, named.get((c, v))) for c, values in vocab.items() for i, v in enumerate(values)]
        schema = "source string, position int, value string, feature string"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/dummies")


def load_vocabulary(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The vocabulary stored by ``save_models``."""
    vocab: dict[str, list[str]] = {}
    for r in spark.read.parquet(f"{path}/dummies").orderBy("source", "position").collect():
        vocab.setdefault(r["source"], []).append(r["value"])
    return vocab


def load_models(spark: SparkSession, path: str) -> tuple[dict[str, PipelineModel], dict[str, list[str]]]:
    rows = spark.read.parquet(f"{path}/features").orderBy("task", "position").collect()
    features: dict[str, list[str]] = {}
    for r in rows:
        features.setdefault(r["task"], []).append(r["feature"])
    return {t: PipelineModel.load(f"{path}/{t}") for t in features}, features


# The search space of the tuning run, in Spark ML terms.  No depth limit is 30, the greatest depth
# Spark trees have.  The least rows to split a node (2 to 19) and the least rows of a leaf (1 to 19) are one
# parameter here: a split needs at least that many rows on either side.
TUNE_GRID = {
    "numTrees": [50, 100, 200],
    "maxDepth": [10, 20, 30],
    "minInstancesPerNode": [1, 5, 10, 19],
    "featureSubsetStrategy": ["0.5", "0.75", "sqrt", "log2", "all"],
}


def tune(frame: DataFrame, task: str, features: list[str], grid: Mapping[str, Sequence] | None = None,
         train_ratio: float = 0.8, seed: int = 42, parallelism: int = 4) -> tuple[PipelineModel, dict]:
    """Grid search of the forest (trees, depth, min rows per leaf, features per split)
    with a train/validation split, minimising MSE.  Returns the refitted best pipeline and its
    parameters."""
    vec = f"_features_{task}"
    rf = RandomForestRegressor(featuresCol=vec, labelCol=TARGETS[task], predictionCol=f"pred_{task}", seed=seed)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol=vec, handleInvalid="keep"), rf])
    builder = ParamGridBuilder()
    for name, values in (grid or TUNE_GRID).items():
        builder = builder.addGrid(rf.getParam(name), list(values))
    maps = builder.build()
    evaluator = RegressionEvaluator(labelCol=TARGETS[task], predictionCol=f"pred_{task}", metricName="mse")
    frame = _zero_filled(frame, features)
    tvs = TrainValidationSplit(estimator=pipe, estimatorParamMaps=maps, evaluator=evaluator,
                               trainRatio=train_ratio, seed=seed, parallelism=parallelism)
    model = tvs.fit(frame)
    best = min(range(len(maps)), key=lambda i: model.validationMetrics[i])
    return model.bestModel, {p.name: v for p, v in maps[best].items()}
