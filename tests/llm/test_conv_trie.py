"""The conversation trie against a dictionary of prefixes, and centroid decomposition against plain sums."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import conv_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth string, _c string, _n string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c in own:
        head = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = own.get(base, [])[:head] + own[c][head:]
    members, ends = {}, {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        gain = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += gain
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
                    sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
                   for p, m in members.items()), key=repr)


def result(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def random_rows(seed, n):
    """Conversations of one family and others, with shared heads, copies, gaps and odd turns."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        c = int(c if c % 3 else c * 7 + 1000)
        depth = int(rng.integers(1, 4)) if c % 11 else 40
        for t in range(depth):
            rows.append((c, t, ["user", "assistant"][t % 2], f"t{int(rng.integers(0, 3))}" * (1 + t % 3)))
    return rows


ODD = [(None, 0, "user", "nobody"), (-150, 1, "user", "a"), (-150, None, None, None), (-100, 0, "user", "hé\U0001F600"),
       (-3, 5, "user", "x"), (100, 2, None, "z"), (100, 2, "user", None), (100, 2, "user", ""), (7, 0, "user", "y" * 20_000),
       (7, 0, "user", "y" * 20_000), (103, 0, "u", "w"), (103, 1, "u", "w"), (103, 2, "u", "w"), (10 ** 17 + 1, 0, "u", "far")]


@pytest.mark.parametrize("limit", [1, 5, 4096])
def test_trie_equals_brute_force(spark, limit):
    rows = random_rows(3, 60) + ODD
    assert result(T.conversation_trie(table(spark, rows), limit)) == brute(rows)


def test_copies_and_long_member_lists(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(1, 400) for t in range(7)]
    old, T.RUN = T.RUN, 16
    try:
        assert result(T.conversation_trie(table(spark, rows))) == brute(rows)
    finally:
        T.RUN = old


def test_empty_table(spark):
    assert T.conversation_trie(table(spark, [])).count() == 0
    assert T.conversation_trie(table(spark, [(None, 0, "user", "nobody")])).count() == 0


def test_running_sums_over_several_runs(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"), F.lit(1).alias("v"), (F.col("id") * 3).alias("x"))
    up = {r["o"]: (r["n"], r["s"]) for r in T.running_sums(df, "k", "o", {"n": F.col("v"), "s": F.col("x")}, run=8).collect()}
    down = {r["o"]: r["n"] for r in T.running_sums(df, "k", "o", {"n": F.col("v")}, run=8, falling=True).collect()}
    for o in range(100):
        same = [i for i in range(o % 2, o + 1, 2)]
        assert up[o] == (len(same), 3 * sum(same)) and down[o] == 51 - len(same)


def test_centroid_totals_equal_plain_sums():
    rng = np.random.default_rng(1)
    shapes = [np.array([-1]), np.arange(-1, 200), np.r_[-1, np.zeros(99, int)], np.array([-1, 0, -1, 2, 2])]
    shapes += [np.array([-1, *[int(rng.integers(-1 if i % 17 == 0 else 0, i)) for i in range(1, n)]]) for n in (2, 30, 500)]
    for parent in shapes:
        values = rng.integers(0, 100, (len(parent), 2))
        want = values.copy()
        for i in range(len(parent) - 1, 0, -1):
            if parent[i] >= 0:
                want[parent[i]] += want[i]
        assert T.centroid_totals(parent, values).tolist() == want.tolist()
