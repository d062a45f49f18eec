import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from storelens.operators import trees as T


def _frame(spark, n=600, constant=False):
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 40, n), rng.integers(0, 3, n), rng.normal(size=n)
    y = np.full(n, 3.0) if constant else 2.0 * a + 10.0 * (b == 1) + c
    rows = [(i, float(a[i]), float(b[i]), float(c[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(df)


def _sse(y, w):
    return float(np.sum(w * (y - np.average(y, weights=w)) ** 2)) if w.sum() else 0.0


@pytest.mark.parametrize("min_leaf", [1, 4])
def test_every_split_is_the_best_by_brute_force(min_leaf):
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, 9, 70), rng.integers(0, 2, 70), rng.integers(0, 60, 70)], 1)
    y, w = rng.normal(size=70), rng.integers(1, 4, 70).astype(float)
    t = T.grow_whole(x, y, w, [9, 2, 60], 2, min_leaf)
    members = {0: np.arange(70)}
    for n in range(len(t["feature"])):
        rows = members[n]
        assert t["value"][n] == pytest.approx(np.average(y[rows], weights=w[rows]))
        options = [(_sse(y[rows[m]], w[rows[m]]) + _sse(y[rows[~m]], w[rows[~m]]))
                   for f in range(3) for v in range(60) for m in [x[rows, f] <= v]
                   if min(w[rows[m]].sum(), w[rows[~m]].sum()) >= min_leaf and m.any() and not m.all()]
        f = t["feature"][n]
        if f < 0:
            assert not options or len(rows) < 2 or np.ptp(y[rows]) == 0
            continue
        m = x[rows, f] <= t["bin"][n]
        members[t["left"][n]], members[t["right"][n]] = rows[m], rows[~m]
        assert _sse(y[rows[m]], w[rows[m]]) + _sse(y[rows[~m]], w[rows[~m]]) == pytest.approx(min(options))


def test_depth_has_no_limit():
    n = 60
    y = np.where(np.arange(n) % 2, 1.0, -1.0) * 4.0 ** np.arange(n)  # each split takes off the last row
    t = T.grow_whole(np.arange(n)[:, None], y, np.ones(n), [n])
    depth = np.zeros(len(t["feature"]), int)
    for i, (a, b) in enumerate(zip(t["left"], t["right"])):
        if a >= 0:
            depth[a] = depth[b] = depth[i] + 1
    assert depth.max() > 30
    assert (T.walk(t, np.arange(n)[:, None]) == pytest.approx(y))


def test_levels_over_frames_grow_the_same_trees_as_tasks(spark):
    df = _frame(spark)
    whole = T.DeepForest("x", "y", "p", ["id"], trees=3, seed=1).fit(df)
    levels = T.DeepForest("x", "y", "p", ["id"], trees=3, seed=1, finish_rows=40).fit(df.repartition(5))
    assert whole.plain()["levels"] == 0 and levels.plain()["levels"] >= 3
    a = {r["id"]: r["p"] for r in whole.transform(df).select("id", "p").collect()}
    b = {r["id"]: r["p"] for r in levels.transform(df).select("id", "p").collect()}
    assert len(a) == 600 and a == pytest.approx(b)
    y = {r["id"]: r["y"] for r in df.select("id", "y").collect()}
    assert np.mean([(a[i] - y[i]) ** 2 for i in y]) < 0.05 * np.var(list(y.values()))


def test_rows_that_cannot_be_split_are_one_leaf(spark):
    df = spark.range(300).select("id", F.lit(1.0).alias("a"), (F.col("id") % 2).cast("double").alias("y"))
    df = VectorAssembler(inputCols=["a"], outputCol="x").transform(df)
    m = T.DeepForest("x", "y", "p", ["id"], trees=2, finish_rows=50).fit(df)
    assert m.nodes.count() == 2 and m.transform(df).select("p").distinct().count() == 1
    flat = _frame(spark, 80, constant=True)
    assert {r["p"] for r in T.SecondOrderBoosting("x", "y", "p", rounds=2).fit(flat).transform(flat).collect()} == {3.0}


def test_boosting_equals_a_plain_loop_and_partitions_do_not_matter(spark, monkeypatch):
    df = _frame(spark, 300)
    fit = lambda d, **k: T.SecondOrderBoosting("x", "y", "p", rounds=4, depth=3, store_every=2, **k).fit(d)
    model = fit(df)
    x = np.array([[r["a"], r["b"], r["c"]] for r in df.collect()])
    y = np.array([r["y"] for r in df.collect()])
    p = np.full(len(y), y.mean())
    cuts = model.plain()["cuts"]

    def grow(rows, g, depth):
        if depth:
            best = (0.0, None)
            for f, cc in enumerate(cuts):
                for c in cc:
                    m = x[rows, f] >= c
                    if m.any() and not m.all():
                        s = lambda k: g[rows[k]].sum() ** 2 / (k.sum() + 1)
                        gain = 0.5 * (s(m) + s(~m) - s(np.ones(len(rows), bool)))
                        if gain > best[0] + 1e-9:
                            best = (gain, m)
            if best[1] is not None:
                return grow(rows[best[1]], g, depth - 1) + grow(rows[~best[1]], g, depth - 1)
        return [(rows, -0.3 * g[rows].sum() / (len(rows) + 1))]

    for _ in range(4):
        for rows, v in grow(np.arange(len(y)), p - y, 3):
            p[rows] += v
    got = [r["p"] for r in model.transform(df).collect()]
    assert got == pytest.approx(p)
    monkeypatch.setattr(T, "TASK_ROWS", 50)
    assert [r["p"] for r in fit(df.repartition(4)).transform(df).collect()] == pytest.approx(p)
    assert len(fit(df, gamma=1e12).splits(["a", "b", "c"])) == 0


def test_models_are_stored_and_read_back(spark, tmp_path):
    df = _frame(spark, 200)
    for i, est in enumerate([T.DeepForest("x", "y", "p", ["id"], trees=2, finish_rows=50),
                             T.SecondOrderBoosting("x", "y", "p", rounds=3)]):
        model = PipelineModel(stages=[est.fit(df)])
        model.write().overwrite().save(f"{tmp_path}/{i}")
        read = PipelineModel.load(f"{tmp_path}/{i}")
        want = {r["id"]: r["p"] for r in model.transform(df).collect()}
        assert {r["id"]: r["p"] for r in read.transform(df).collect()} == pytest.approx(want)


def test_a_grown_tree_is_one_row_and_rows_are_dealt_in_blocks(spark):
    df = _frame(spark)
    est = T.DeepForest("x", "y", "p", ["id"], trees=3, seed=1)
    model = est.fit(df)
    nodes = model.nodes.collect()
    assert sorted(r["node"] for r in nodes) == ["0", "1", "2"] and all(len(r["feature"]) > 100 for r in nodes)
    # Every row counts as often as its draw says, in the root of each tree.
    key = F.xxhash64("id", F.lit(1))
    draws = df.select([(F.pmod(F.xxhash64(key, F.lit(t)), F.lit(1 << 32)) / F.lit(float(1 << 32))).alias(str(t)) for t in range(3)])
    want = {str(t): sum(sum(r[t] >= p for p in T.POISSON) for r in draws.collect()) for t in range(3)}
    assert {r["node"]: r["weight"][0] for r in nodes} == want


def test_every_feature_kind_and_open_leaf_in_a_large_node():
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 2, 4000), rng.integers(0, 256, 4000), np.zeros(4000, int), rng.integers(0, 2, 4000)], 1)
    y = np.where(x[:, 0] == 1, 7.0, np.floor(x[:, 1] / 50) + x[:, 3])
    t = T.grow_whole(x.astype(np.uint8), y, np.ones(4000), [2, 256, 1, 2])
    assert (T.walk(t, x.astype(np.uint8)) == y).all() and t["weight"][t["feature"] < 0].sum() == 4000
    assert len(t["feature"]) < 60  # pure nodes end


def test_rows_are_stored_once_whatever_the_number_of_trees(spark, monkeypatch):
    df, stored = _frame(spark), []

    def watched(frame, write=T.materialize):
        out = write(frame)
        if "n" in out.columns:  # blocks of rows
            stored.append(out.agg(F.sum("n")).first()[0])
        return out

    monkeypatch.setattr(T, "materialize", watched)
    T.DeepForest("x", "y", "p", ["id"], trees=6, finish_rows=60).fit(df)
    assert stored == [600]


def test_trees_dealt_out_in_turns_are_the_same_trees(spark, tmp_path):
    df = _frame(spark)
    scores = []
    for i, rows in enumerate([T.DEALT_ROWS, 1300, 1]):
        model = T.DeepForest("x", "y", "p", ["id"], trees=5, finish_rows=90, dealt_rows=rows).fit(df)
        assert len(model.parts) == [1, 3, 5][i]
        scores.append({r["id"]: r["p"] for r in model.transform(df).collect()})
    assert len(scores[0]) == 600 and scores[0] == pytest.approx(scores[1]) and scores[0] == pytest.approx(scores[2])


def test_rows_scored_in_turns_and_chunks_get_the_same_mean(spark, monkeypatch):
    df = _frame(spark).repartition(7)
    model = T.DeepForest("x", "y", "p", ["id"], trees=4, finish_rows=100).fit(df)
    want = {r["id"]: r["p"] for r in model.transform(df).collect()}
    monkeypatch.setattr(T, "DEALT_ROWS", 700)
    monkeypatch.setattr(T, "CHUNK_ROWS", 150)
    monkeypatch.setattr(T, "BLOCK_ROWS", 50)
    out = model.transform(df)
    assert out.columns == [*df.columns, "p"] and {r["id"]: r["p"] for r in out.collect()} == pytest.approx(want)
    assert model.transform(df.limit(0)).count() == 0


def test_packed_trees_are_the_grown_ones():
    rng = np.random.default_rng(8)
    x = np.stack([rng.integers(0, 200, 900), rng.integers(0, 2, 900)], 1).astype(np.uint8)
    t = T.grow_whole(x, rng.normal(size=900), rng.integers(1, 4, 900), [200, 2])
    back = T._unpack_tree(T._pack_tree(t), whole=True)
    for c in ("feature", "bin", "left", "right"):
        assert (back[c] == t[c]).all()
    assert back["value"] == pytest.approx(t["value"]) and back["weight"] == pytest.approx(t["weight"])
    assert sum(len(b) for b in T._pack_tree(t)[1:]) < 0.5 * sum(v.astype(T.NODE_TYPES[c]).nbytes for c, v in t.items())
