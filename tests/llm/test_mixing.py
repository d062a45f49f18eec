import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from storelens.llm.mixing import fit_budget, mix_sources, mixed_documents
from tests.llm.conftest import rows_of, words


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight; the excess over the cap is reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        rest = total - sum(done.values())
        free = [s for s in names if s not in done]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return done | share
        done |= {s: float(cap * sizes[s]) for s in over}


def test_targets_sizes_and_budgets(frame, odd_texts):
    rng = np.random.default_rng(3)
    texts = [t for t in odd_texts if len(t or "") < 10_000] + [" ".join(words(rng, "en", int(n))) for n in rng.integers(1, 300, 400)]
    rows = rows_of(texts)
    rows = [(*r[:3], "zz" if i == 25 else r[3], *r[4:]) for i, r in enumerate(rows)]  # a tiny source of great weight
    got = mix_sources(frame(rows)).collect()
    source = {r[0]: r[3] for r in rows}
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    total = defaultdict(int)
    for d, s in source.items():
        total[s] += size[d]
    want, taken = targets(total), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= 1
    again = {r.doc_id: r.taken for r in mix_sources(frame(rows)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_a_document_too_long_for_the_budget_is_left_out(frame):
    rows = [(i, "w " * n, None, s, *[None] * 6) for i, (n, s) in enumerate([(900, "b"), (40, "b"), (30, "b"), (900, "a"), (10, "a")])]
    got = {r.doc_id: r for r in mix_sources(frame(rows)).collect()}
    assert got[0].target < 900 and (got[0].taken, got[1].taken, got[2].taken) == (0, 40, 30)


def test_repeated_rows_empty_table_and_documents(frame):
    rows = rows_of(["one two three", "one two three", None, "four five", "six"]) * 3
    got = mix_sources(frame(rows)).collect()
    assert len(got) == 15
    assert mix_sources(frame([])).count() == 0 and mixed_documents(frame([])).count() == 0
    mixed = mixed_documents(frame(rows))
    assert mixed.columns == frame(rows).columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 6)), min_size=1, max_size=8, unique_by=lambda x: x[0]),
       st.integers(0, 900))
def test_fit_is_best_subset_sum(pairs, budget):
    lengths, counts = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    take = fit_budget(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    reach = {0}
    for length, count in pairs:
        reach = {r + length * c for r in reach for c in range(count + 1)}
    got, best = int((take * lengths).sum()), max(r for r in reach if r <= budget)
    assert got <= budget
    # The proportional share comes first, so the sum can miss the best by less than the longest length.
    assert best - got < max(lengths) + 1


def test_fit_of_large_budgets_meets_them():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(5, 20_000, 2000))
    counts = rng.integers(1, 50, len(lengths))
    total = int((lengths * counts).sum())
    for share in (0.001, 0.2, 0.77, 0.999):
        take = fit_budget(lengths, counts, int(total * share))
        assert int((take * lengths).sum()) == int(total * share)
