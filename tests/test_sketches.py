"""Quantile and distinct sketches against exact ranks and counts; merged sketches against sketches of everything."""

import random

from pyspark.sql import functions as F

from storelens.operators import sketches as K
from storelens.operators import stats as ST

SCHEMA = "day int, item string, a double, b long"


def table(spark, n=20_000, seed=3):
    rng = random.Random(seed)
    return [(rng.randrange(10), f"i{rng.randrange(50)}" if i % 17 else None, rng.gauss(0, 1) if i % 5 else None, rng.randrange(40))
            for i in range(n)]


def within(values, estimate, prob, error=K.RANK_ERROR):
    values = sorted(values)
    below, upto = sum(v < estimate for v in values), sum(v <= estimate for v in values)
    return below <= (prob + error) * len(values) and upto >= (prob - error) * len(values)


def test_describe_approx_is_exact_but_for_quartiles_within_the_error(spark):
    rows = table(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    exact = {r["stat"]: r for r in ST.describe_numeric(df, ["a", "b"]).collect()}
    approx = {r["stat"]: r for r in ST.describe_numeric(df, ["a", "b"], approx=True).collect()}
    assert list(approx) == ST.STATS
    for i, c in ((2, "a"), (3, "b")):
        values = [r[i] for r in rows if r[i] is not None]
        for s in ("count", "mean", "std", "min", "max"):
            assert abs(approx[s][c] - exact[s][c]) < 1e-9 * max(1.0, abs(exact[s][c]))
        for p in ST.PROBS:
            assert within(values, approx[f"{int(p * 100)}%"][c], p)


def test_merged_sketches_stand_for_all_rows(spark):
    rows = table(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    daily = K.column_sketches(df, ["a", "b"], ["day"])
    merged = {r["column"]: r for r in K.merge_sketches(daily).withColumns(
        {f"q{int(p * 100)}": K.sketch_quantile(p) for p in ST.PROBS}).collect()}
    for i, c in ((2, "a"), (3, "b")):
        values = [r[i] for r in rows if r[i] is not None]
        assert merged[c]["n"] == len(values) and merged[c]["lo"] == min(values) and merged[c]["hi"] == max(values)
        assert all(within(values, merged[c][f"q{int(p * 100)}"], p) for p in ST.PROBS)
    # A check that must fail: the median is not the first quartile.
    wrong = spark.createDataFrame([("a", 0.25, float(sorted(r[2] for r in rows if r[2] is not None)[len(rows) * 2 // 5]))],
                                  "column string, prob double, estimate double")
    assert [r["within"] for r in K.rank_check(df, wrong).collect()] == [False]


def test_distinct_sketches_of_unions(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10), f"i{rng.randrange(30)}", None, rng.randrange(60_000)) for _ in range(40_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    held = K.distinct_sketches(df, "b", ["day", "item"])
    whole = K.distinct_estimates(held).first()["estimate"]
    exact = len({r[3] for r in rows})
    assert abs(whole - exact) <= K.DISTINCT_ERROR * exact
    per_day = {r["day"]: r["estimate"] for r in K.distinct_estimates(held, ["day"]).collect()}
    for d in range(10):
        n = len({r[3] for r in rows if r[0] == d})
        assert abs(per_day[d] - n) <= K.DISTINCT_ERROR * n + 1


def test_empty_columns(spark):
    df = spark.createDataFrame([(1, "x", None, 5), (1, "y", None, None)], SCHEMA)
    got = {r["stat"]: r for r in ST.describe_numeric(df, ["a", "b"], approx=True).collect()}
    assert got["count"]["a"] == 0 and got["mean"]["a"] is None and got["50%"]["a"] is None
    assert got["count"]["b"] == 1 and got["50%"]["b"] == 5.0 and got["std"]["b"] is None
    none = {r["stat"]: r for r in ST.describe_numeric(df.filter(F.lit(False)), ["b"], approx=True).collect()}
    assert none["count"]["b"] == 0 and none["max"]["b"] is None
