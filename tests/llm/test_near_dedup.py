from collections import Counter

import numpy as np
import pytest

from storelens.llm.components import components
from storelens.llm.near_dedup import drop_near_copies, near_classes, signatures
from storelens.llm.shingles import shingle_hashes
from tests.llm.conftest import rows_of, words


def multiset(text):
    w = (text or "").split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    total = sum((a | b).values())
    return both / total if total else 1.0


def brute_classes(rows, limit=0.8):
    sets = [(d, multiset(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if (bool(x) == bool(y)) and similarity(x, y) >= limit:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d, _ in sets}


@pytest.fixture(scope="module")
def family():
    """Copies of one text with few or many edits (chains, stragglers), a shared passage, repeated words, exact copies."""
    rng = np.random.default_rng(8)
    base = words(rng, "en", 300)
    texts = []
    for edits in [0, 1, 2, 3, 4, 5, 5, 6, 6, 7, 8, 9, 10, 12, 14, 20] * 4:
        w = list(base)
        for at in rng.integers(0, len(w), edits):
            w[at] = words(rng, "fr", 1)[0]
        texts.append(" ".join(w))
    passage = words(rng, "de", 60)
    texts += [" ".join(passage + words(rng, "en", int(n))) for n in rng.integers(5, 60, 40)]
    texts += [" ".join(words(rng, "en", 80)) for _ in range(40)]
    texts += ["ha " * n for n in (30, 31, 33, 36, 60)]
    texts += [texts[3], texts[3] + " ", texts[70]]
    return texts


def test_matches_brute_force(frame, family, odd_texts):
    rows = rows_of(family + odd_texts)
    want = brute_classes([(r[0], r[1]) for r in rows])
    got = near_classes(frame(rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_straggler_blocks_give_the_same_classes(frame, family):
    rows = rows_of(family)
    want = brute_classes([(r[0], r[1]) for r in rows])
    got = near_classes(frame(rows), block_chars=5000).collect()
    assert {r.doc_id: r.class_id for r in got} == want


def test_pipeline_form_keeps_one_document_of_each_class(frame, family):
    rows = rows_of(family) * 2
    kept = drop_near_copies(frame(rows))
    assert kept.columns == frame(rows).columns
    want = set(brute_classes([(r[0], r[1]) for r in rows_of(family)]).values())
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert near_classes(frame([])).count() == 0 and drop_near_copies(frame([])).count() == 0


def test_registers_agree_as_often_as_the_weighted_jaccard_similarity():
    rng = np.random.default_rng(1)
    n = 200
    a, b = rng.integers(1, 12, n), rng.integers(1, 12, n)
    a[:40], b[40:80] = 0, 0
    elements = rng.integers(1, 1 << 62, n).astype(np.uint64)
    shingles = np.concatenate((np.repeat(elements, a), np.repeat(elements, b)))
    owner = np.repeat([0, 1], [a.sum(), b.sum()])
    sig = signatures(shingles, owner, 2, 4096)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - truth) < 4 * np.sqrt(truth * (1 - truth) / 4096)


def test_shingles_do_not_depend_on_slices(monkeypatch):
    import storelens.llm.shingles as shingles
    texts = [t.encode() for t in ("a b c d e f", "", " one  two ", "é é é é é é é", "x y z")]
    one = shingle_hashes(texts)
    monkeypatch.setattr(shingles, "SLICE_BYTES", 3)
    two = shingle_hashes(texts)
    assert all((x == y).all() for x, y in zip(one, two))
    assert one[2].tolist() == [2, 0, 1, 3, 1]
    alone = [shingle_hashes([t])[0].tolist() for t in texts]
    assert sum(alone, []) == one[0].tolist()


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 11), (12, 11), (7, 7)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 7)}, 10: 10, 11: 10, 12: 10, **{i: 100 for i in range(100, 150)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_straggler_search_finds_all_similar_pairs(family):
    from storelens.llm.near_dedup import _Overlap, _similar_pairs
    texts = family + ["one", "one", "", "a b c d e"]
    sets = [multiset(t) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(len(texts))
            if i % 7 != j % 5 and sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8}
    a = _Overlap(texts, 5)
    comp_m, comp_p = np.arange(len(texts)) % 5, np.arange(len(texts)) % 7
    for entries in (4_000_000, 50):
        i, j = _similar_pairs(a, _Overlap(texts, 5), comp_m, comp_p, 0.8, entries)
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want
