"""Invariants of the scalable primitives: halos, carries, partition independence."""

import random

from pyspark.sql import functions as F

from helpers import SF_SMALL
from storelens.operators import sequence as Q
from storelens.operators import stats as ST
from storelens.plans.catalog import QUERIES


def _brute_lags(data, ks):
    out, last = {}, {}
    by = {}
    for o, g, v in sorted(data, key=lambda r: (r[1], r[0])):
        by.setdefault(g, []).append((o, v))
    for g, items in by.items():
        for i, (o, v) in enumerate(items):
            out[o] = {k: (items[i - k][1] if 0 <= i - k < len(items) else None) for k in ks}
    return out


def test_shifts_across_small_buckets(spark):
    rnd = random.Random(7)
    data = [(i, rnd.choice(["a", "b", "hot", "hot", "hot"]), rnd.randint(1, 50)) for i in range(700)]
    df = spark.createDataFrame(data, "o int, g string, v int")
    ks = [1, 7, 14, -7]
    out = Q.with_shifts(df, ["o"], ["g"], {f"s{k}": ("v", k) for k in ks}, bucket_rows=64)
    want = _brute_lags(data, ks)
    for r in out.collect():
        for k in ks:
            assert r[f"s{k}"] == want[r["o"]][k], (r["o"], k)


def test_forward_fill_carry_across_buckets(spark):
    # long NULL run crossing several buckets: the value must come from the carry table
    data = [(i, "g", (5.0 if i == 3 else None) if i < 200 else float(i)) for i in range(260)]
    df = spark.createDataFrame(data, "o int, g string, v double")
    out = Q.with_shifts(df, ["o"], ["g"], {"p": ("v", 1)}, fill_forward=["v"], bucket_rows=16)
    got = {r["o"]: (r["v"], r["p"]) for r in out.collect()}
    assert got[2] == (None, None) and got[3] == (5.0, None) and got[150] == (5.0, 5.0)
    assert got[200] == (200.0, 5.0) and got[201] == (201.0, 200.0)


def test_sequence_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5000)
    seqd, total = Q.sequence_rows(df, ["k"])
    assert total == 5000
    assert [r["_seq"] for r in seqd.orderBy("k").select("_seq").collect()] == list(range(5000))


def test_partition_count_independence(spark):
    names = ["sales_lags", "category_performance", "frequent_itemsets", "describe_numeric", "product_week_sales",
             "latest_per_product", "scored_rows", "weather_codes"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = {}
    for parts in ["1", "8"]:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results[parts] = {n: sorted(map(tuple, QUERIES[n](spark, SF_SMALL).collect()), key=repr) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results["1"] == results["8"]


def test_quantiles_and_moments_match_sorted_values(spark):
    rnd = random.Random(3)
    rows = [(rnd.gauss(0, 1) * 50 if rnd.random() < 0.9 else None, float(rnd.randint(0, 3)), float(i // 400), None)
            for i in range(2001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(7)
    got = {r["stat"]: r for r in ST.describe_numeric(df, ["a", "b", "c", "d"]).collect()}
    for i, c in enumerate("abc"):
        vals = sorted(r[i] for r in rows if r[i] is not None)
        mean = sum(vals) / len(vals)
        want = {"count": len(vals), "mean": mean, "min": vals[0], "max": vals[-1],
                "std": (sum((v - mean) ** 2 for v in vals) / (len(vals) - 1)) ** 0.5}
        for p in (25, 50, 75):
            h = (len(vals) - 1) * p / 100
            lo = int(h)
            hi = min(lo + 1, len(vals) - 1)
            want[f"{p}%"] = vals[lo] + (vals[hi] - vals[lo]) * (h - lo)
        for stat, v in want.items():
            assert abs(got[stat][c] - v) < 1e-9, (stat, c)
    assert got["count"]["d"] == 0.0 and all(got[s]["d"] is None for s in ST.STATS[1:])


def test_correlations_with_gaps_follow_the_pairwise_rule(spark):
    rnd = random.Random(4)
    rows = [(float(i), i * 2.0 + rnd.random() if i % 3 else None, rnd.random(), 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    got = {(r["col1"], r["col2"]): r["correlation"] for r in ST.correlation_pairs(df, ["a", "b", "c", "k"]).collect()}

    def pearson(i, j):
        xs = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        mx, my = (sum(v[n] for v in xs) / len(xs) for n in (0, 1))
        sxy = sum((x - mx) * (y - my) for x, y in xs)
        return sxy / (sum((x - mx) ** 2 for x, _ in xs) * sum((y - my) ** 2 for _, y in xs)) ** 0.5
    for (i, a), (j, b) in [((0, "a"), (1, "b")), ((1, "b"), (2, "c")), ((0, "a"), (2, "c"))]:
        assert abs(got[(a, b)] - pearson(i, j)) < 1e-9 and got[(a, b)] == got[(b, a)]
    assert got[("k", "a")] is None and got[("k", "k")] is None and abs(got[("b", "b")] - 1.0) < 1e-12


def test_correlations_of_many_columns_take_one_pass(spark, monkeypatch):
    from pyspark.sql import DataFrame

    rnd = random.Random(6)
    rows = [tuple(1e9 + rnd.random() if i % 7 else None if j == 3 else 5.0 for j in range(16)) + (0.1,) for i in range(3000)]
    cols = [f"c{j}" for j in range(16)] + ["flat"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(7)
    aggregates = []
    whole = DataFrame.agg
    monkeypatch.setattr(DataFrame, "agg", lambda self, *e: aggregates.append(len(e)) or whole(self, *e))
    got = {(r["col1"], r["col2"]): r["correlation"] for r in ST.correlation_pairs(df, cols).collect()}
    assert not aggregates  # 17 columns would be hundreds of sums in one aggregate
    for a, b in [(0, 1), (3, 5), (2, 15)]:
        xs = [(r[a], r[b]) for r in rows if r[a] is not None and r[b] is not None]
        mx, my = (sum(v[n] for v in xs) / len(xs) for n in (0, 1))
        want = sum((x - mx) * (y - my) for x, y in xs) / (
            sum((x - mx) ** 2 for x, _ in xs) * sum((y - my) ** 2 for _, y in xs)) ** 0.5
        assert abs(got[(f"c{a}", f"c{b}")] - want) < 1e-6
    assert got[("flat", "c0")] is None and got[("flat", "flat")] is None and got[("c0", "c0")] == 1.0


def test_monthly_totals_do_not_deal_rows_by_product(spark):
    import contextlib
    import io

    from storelens.operators.sales import with_monthly_sales
    df = spark.createDataFrame([("a", "2020-01-03", 2), ("a", "2020-01-09", 3), ("a", "2020-02-01", 4), (None, "2020-01-01", 5),
                                ("b", None, 6), ("a", "2020-01-09", 3)], "product_name string, date string, quantity_sold int")
    out = with_monthly_sales(df.withColumn("date", F.col("date").cast("date")))
    got = sorted((str(r["product_name"]), r["quantity_sold"], r["monthly_sales"]) for r in out.collect())
    assert got == [("None", 5, None), ("a", 2, 8), ("a", 3, 8), ("a", 3, 8), ("a", 4, 4), ("b", 6, None)]
    assert out.columns[:2] == ["product_name", "month_period"]
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain()
    assert "SortMergeJoin" not in buf.getvalue() and "Exchange hashpartitioning" not in buf.getvalue()


def test_segments_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for parts in ["1", "8"]:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(map(tuple, QUERIES["product_segments"](spark, SF_SMALL).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def _brute_shift_ffill(data, k):
    """Per group in order: forward-fill v, then the filled value k rows back."""
    by = {}
    for o, g, v in sorted(data, key=lambda r: (r[1], r[0])):
        by.setdefault(g, []).append((o, v))
    out = {}
    for items in by.values():
        filled, last = [], None
        for o, v in items:
            last = v if v is not None else last
            filled.append((o, last))
        for i, (o, f) in enumerate(filled):
            out[o] = (f, filled[i - k][1] if i - k >= 0 else None)
    return out


from hypothesis import given, settings, strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None)
@given(n=st.integers(20, 240), groups=st.integers(1, 4), null_rate=st.floats(0.0, 0.9),
       bucket=st.integers(8, 64), k=st.integers(1, 5), seed=st.integers(0, 10_000))
def test_shift_with_fill_matches_brute_force(spark, n, groups, null_rate, bucket, k, seed):
    rnd = random.Random(seed)
    data = [(i, f"g{rnd.randrange(groups)}", None if rnd.random() < null_rate else float(rnd.randint(1, 99)))
            for i in range(n)]
    df = spark.createDataFrame(data, "o int, g string, v double")
    out = Q.with_shifts(df, ["o"], ["g"], {"p": ("v", k)}, fill_forward=["v"], bucket_rows=bucket)
    want = _brute_shift_ffill(data, k)
    got = {r["o"]: (r["v"], r["p"]) for r in out.collect()}
    assert got == want


def test_literal_frame_round_trip_and_flat_cost(spark):
    import math
    import time

    from pyspark.sql import types as T

    from storelens.session import literal_frame

    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.StringType()),
                           T.StructField("c", T.LongType()), T.StructField("d", T.BooleanType())])
    rows = [(1e-05, "it's", 2 ** 40, True), (-2.5, "back\\slash", None, False), (float("nan"), None, 0, None),
            (float("inf"), "x", -1, True), (5e-324, "Brand#1", 3, False)]
    got = [tuple(r) for r in literal_frame(spark, rows, schema).collect()]
    for want, g in zip(rows, got):
        for x, y in zip(want, g):
            assert x == y or (isinstance(x, float) and math.isnan(x) and math.isnan(y))
    # one row per partition at cluster scale must not cost per-row driver calls
    t0 = time.time()
    big = literal_frame(spark, [(i, i * 3) for i in range(20000)],
                        T.StructType([T.StructField("p", T.LongType()), T.StructField("o", T.LongType())]))
    assert big.count() == 20000 and time.time() - t0 < 60


def test_packed_checkpoints_keep_rows_order_and_partitions_on_less_disk(spark):
    import os
    from storelens.session import materialize, materialize_packed

    df = (spark.range(0, 30000, 1, 3).selectExpr("id", "CAST(id % 11 AS double) AS a", "IF(id % 5 = 0, NULL, CAST(id % 7 AS string)) AS s",
                                                 "date_add(DATE'2024-01-01', CAST(id % 400 AS int)) AS d",
                                                 *[f"CAST(id % {k} = 0 AS int) AS b{k}" for k in range(2, 30)]))

    def written(write):
        top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        sizes = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(top) for f in fs)
        before = sizes()
        out = write(df)
        return out, sizes() - before

    plain, size = written(materialize)
    packed, less = written(materialize_packed)
    assert packed.schema == df.schema and less < size / 4
    assert packed.withColumn("_p", F.spark_partition_id()).collect() == df.withColumn("_p", F.spark_partition_id()).collect()
    assert materialize_packed(df.limit(0)).columns == df.columns and materialize_packed(df.limit(0)).count() == 0
