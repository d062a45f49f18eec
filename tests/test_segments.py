"""k-means on whole numbers against a plain version of the same draws and steps, and odd frames."""

import hashlib
import math

import numpy as np

from storelens.operators import segments as G


def plain(rows, k, restarts, seed, max_iter=G.MAX_ITER):
    """{product: cluster} and the cost, one product at a time."""
    pts = [(name, [round(x * G.MICRO) for x in z]) for name, z in rows]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def race(r, step, name, w):
        u = (int(hashlib.md5(f"{seed}|{r}|{step}|{name}".encode()).hexdigest()[:8], 16) + 0.5) / 2 ** 32
        return -math.log(u) / w, name

    results = []
    for r in range(restarts):
        centres = []
        for step in range(k):
            left = [(race(r, step, n, min([far(z, c) for c in centres], default=1)), z) for n, z in pts
                    if not centres or min(far(z, c) for c in centres)]
            if left:
                centres.append(min(left)[1])
        for _ in range(max_iter):
            own = [min(range(len(centres)), key=lambda i: (far(z, centres[i]), i)) for _, z in pts]
            moved = []
            for i, c in enumerate(centres):
                mine = [z for (_, z), o in zip(pts, own) if o == i]
                moved.append([(2 * sum(col) + len(mine)) // (2 * len(mine)) for col in zip(*mine)] if mine else c)
            if moved == centres:
                break
            centres = moved
        own = [min(range(len(centres)), key=lambda i: (far(z, centres[i]), i)) for _, z in pts]
        results.append((sum(far(z, centres[o]) for (_, z), o in zip(pts, own)), r, dict(zip((n for n, _ in pts), own))))
    cost, _, best = min(results, key=lambda x: x[:2])
    return best, cost / G.MICRO ** 2


def frame(spark, rows):
    return spark.createDataFrame(rows, "product_name string, scaled array<double>")


def segments(df, **kw):
    out, cost = G.segment_products(df, **kw)
    return {r["product_name"]: r["cluster"] for r in out.collect()}, cost


def test_equals_the_plain_version(spark):
    rng = np.random.default_rng(6)
    middle = rng.normal(0, 1, (4, 5))
    rows = [(f"p{i}", [float(x) for x in middle[i % 4] + rng.normal(0, 0.4, 5)]) for i in range(60)]
    rows += [(f"copy{i}", rows[0][1]) for i in range(5)]
    for k, restarts in ((3, 4), (1, 1), (5, 2)):
        got, cost = segments(frame(spark, rows).repartition(3), k=k, restarts=restarts, seed=9)
        want, least = plain(rows, k, restarts, 9)
        assert got == want and abs(cost - least) < 1e-9
    # More restarts cost no more, and separated groups are found whole.
    assert segments(frame(spark, rows), restarts=8)[1] <= segments(frame(spark, rows), restarts=1)[1]
    apart = [(f"q{i}", [float(100 * (i % 3)), float(i % 2)]) for i in range(30)]
    found, _ = segments(frame(spark, apart))
    assert all(len({found[f"q{i}"] for i in range(j, 30, 3)}) == 1 for j in range(3)) and len(set(found.values())) == 3


def test_odd_frames(spark):
    assert segments(frame(spark, [])) == ({}, 0.0)
    assert segments(frame(spark, [("a", [1.0, 2.0])])) == ({"a": 0}, 0.0)
    got, cost = segments(frame(spark, [("a", [1.0]), ("b", [1.0]), (None, [5.0]), ("c", [2.0])]))
    assert set(got) == {"a", "b", "c"} and got["a"] == got["b"] != got["c"] and cost == 0.0
