import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm.top_k import search_shard, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, _floor string"


def brute(rows, k=10):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = [math.floor(1024 * float(np.float32(x))) for x in v]
    out = []
    for q in sorted(i for i in ok if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best[:k])]
    return out


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in
                  top_k(df, F.col("vec_id") % 100 == 0, **options).collect())


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "query_rows": 2, "leaf_rows": 4}])
def test_matches_brute_force(spark, options):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)], 0, "x") for i in range(450)]
    rows += [(1000 + i, rows[3][1], 0, "x") for i in range(60)]  # ties
    rows += [(2000, None, 0, "x"), (2001, [1.0, None] + [0.0] * 6, 0, "x"), (2002, [float("nan")] * 8, 0, "x"),
             (2100, [float("inf")] * 8, 0, "x"), (2200, [1.0, 2.0], 0, "x"), (2201, [3.0, 4.0], 0, "x"), (None, [1.0] * 8, 0, "x")]
    assert got(spark, rows, **options) == brute(rows)


def test_few_candidates_and_empty_table(spark):
    rows = [(0, [0.5, -0.5], 0, None), (1, [0.1, 0.1], 0, None), (2, [0.2, 0.1], 0, None)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, [(0, [1.0], 0, None)]) == []
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_large_numbers_stay_exact():
    x = np.array([[2 ** 29, 1], [2 ** 29, 0], [-(2 ** 29), 5]], np.int64)
    q = np.array([[2 ** 29, 1]], np.int64)
    i, who, score = search_shard(x, np.array([1, 2, 3]), q, np.array([0]), np.array([-(1 << 63)]), k=2, leaf_rows=1)
    assert who.tolist() == [1, 2] and score.tolist() == [2 ** 58 + 1, 2 ** 58]
