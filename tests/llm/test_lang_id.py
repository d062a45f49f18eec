import itertools
import zlib

import numpy as np
import pytest

from storelens.llm import lang_id as L
from storelens.llm.lang_id import Crf, fit, identify, keep_identified, label_texts
from tests.llm.conftest import rows_of, words


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(12)
    langs = ["en", "fr", "de"] * 60
    return [" ".join(words(rng, lang, int(rng.integers(5, 120)))) for lang in langs], langs


def test_posteriors_equal_the_sum_over_all_labelings():
    rng = np.random.default_rng(0)
    model = Crf(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)))
    lengths = np.array([5, 1, 4])
    em = rng.normal(size=(10, 3))
    got = model.posteriors(em, lengths)
    at = 0
    for n in lengths:
        total = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            # The chain starts from an even mix of labels.
            first = np.log(np.exp(model.transitions[:, path[0]]).sum())
            s = np.exp(first + sum(em[at + i, y] for i, y in enumerate(path))
                       + sum(model.transitions[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                total[i, y] += s
        assert np.allclose(got[at:at + n], total / total.sum(axis=1, keepdims=True))
        at += n


def test_blocks_give_the_same_posteriors(monkeypatch):
    import storelens.llm.lang_id as lang_id
    rng = np.random.default_rng(3)
    model = Crf(["a", "b"], np.zeros((1, 2)), rng.normal(size=(2, 2)))
    lengths = np.array([300, 64, 65, 1, 128])
    em = rng.normal(size=(int(lengths.sum()), 2)) * 5
    one = model.posteriors(em, lengths)
    monkeypatch.setattr(lang_id, "BLOCK", 1000)
    assert np.allclose(one, model.posteriors(em, lengths))


def test_words_of_mixed_text_are_labelled(labelled):
    model = fit(*labelled)
    rng = np.random.default_rng(44)
    parts = [words(rng, "en", 20), words(rng, "fr", 20), words(rng, "de", 20)]
    flat = sum(parts, [])
    post = model.posteriors(model.emissions(flat), np.array([60]))
    best = [model.labels[i] for i in post.argmax(axis=1)]
    truth = ["en"] * 20 + ["fr"] * 20 + ["de"] * 20
    assert np.mean([a == b for a, b in zip(best, truth)]) > 0.9


def test_held_out_accuracy_and_contract(frame, labelled, odd_texts):
    texts, langs = labelled
    rows = [(i, t, lang, *[None] * 7) for i, (t, lang) in enumerate(zip(texts, langs))]
    rows += [(1000 + i, t, None, *[None] * 7) for i, t in enumerate(odd_texts)]
    got = {r.doc_id: r for r in identify(frame(rows)).collect()}
    assert len(got) == len(rows)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1
    hidden = [d for d in range(len(texts)) if got[d].held_out]
    assert hidden and np.mean([got[d].lang_pred == langs[d] for d in hidden]) >= 0.95
    for i, t in enumerate(odd_texts):
        letter = t is not None and any(c.isalpha() for c in t)
        assert (got[1000 + i].lang_pred == "und") == (not letter)


def test_predictions_do_not_read_other_columns(frame, labelled):
    texts, langs = labelled
    rows = [(i, t, lang, *[None] * 7) for i, (t, lang) in enumerate(zip(texts, langs))]
    one = {r.doc_id: (r.lang_pred, r.score) for r in identify(frame(rows)).collect()}
    wrong = [(*r[:2], "de" if zlib.crc32(str(r[0]).encode()) % 4 == 2 else r[2], "another", *r[4:]) for r in rows]
    assert one == {r.doc_id: (r.lang_pred, r.score) for r in identify(frame(wrong)).collect()}


def test_no_labels_empty_table_and_long_texts(frame, labelled, monkeypatch):
    assert identify(frame([])).count() == 0
    assert {r.lang_pred for r in identify(frame([(1, "some text", *[None] * 8)])).collect()} == {"und"}
    model = fit(*labelled)
    text = " ".join(labelled[0][:30])
    whole = label_texts(model, [text])
    monkeypatch.setattr("storelens.llm.lang_id.PIECE_CHARS", 300)
    cut = label_texts(model, [text])
    assert whole[0] == cut[0] and abs(whole[1][0] - cut[1][0]) < 0.05


def test_filter_keeps_clean_documents_and_columns(frame, labelled):
    texts, langs = labelled
    rows = [(i, t, lang, *[None] * 7) for i, (t, lang) in enumerate(zip(texts, langs))]
    rows += [(900, None, None, *[None] * 7), (901, "123 !!", None, *[None] * 7)]
    kept = keep_identified(frame(rows))
    assert kept.columns == frame(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(len(texts)))


def test_gradient_equals_differences_of_the_log_likelihood():
    rng = np.random.default_rng(4)
    k, lengths = 3, np.array([5, 1, 70, 4])
    gold = rng.integers(0, k, lengths.sum())
    em = rng.normal(0, 1, (lengths.sum(), k))
    trans = rng.normal(0, 1, (k, k))

    def likelihood(em, trans):
        total, at = 0.0, 0
        for n in lengths:
            e, y = em[at:at + n], gold[at:at + n]
            start = np.logaddexp.reduce(trans, axis=0)  # after an unseen word
            score = start[y[0]] + e[np.arange(n), y].sum() + trans[y[:-1], y[1:]].sum()
            a = start + e[0]
            for t in range(1, n):
                a = np.logaddexp.reduce(a[:, None] + trans, axis=0) + e[t]
            total, at = total + score - np.logaddexp.reduce(a), at + n
        return total

    by_word, by_transition = L.gradient(L.Crf(list("abc"), np.zeros((L.FEATURES, k)), trans), em, lengths, gold)
    for i in range(k):
        for j in range(k):
            step = np.zeros((k, k))
            step[i, j] = 1e-5
            slope = (likelihood(em, trans + step) - likelihood(em, trans - step)) / 2e-5
            assert abs(slope - by_transition[i, j]) < 1e-5
    for t, c in ((0, 0), (4, 1), (5, 2), (40, 0), (79, 2)):
        step = np.zeros_like(em)
        step[t, c] = 1e-5
        assert abs((likelihood(em + step, trans) - likelihood(em - step, trans)) / 2e-5 - by_word[t, c]) < 1e-5


def test_a_repeated_text_takes_no_other_languages_place(frame):
    rng = np.random.default_rng(8)
    hot = " ".join(words(rng, "en", 40))
    rows = [(i, hot, "en", "s", 5, "x", "y", "z", 7, "s") for i in range(2000)]
    rows += [(5000 + i, " ".join(words(rng, "fr", 30)), "fr", "s", 5, "x", "y", "z", 7, "s") for i in range(60)]
    model = L.train(frame(rows), sample_rows=10)
    assert model.labels == ["en", "fr"]
