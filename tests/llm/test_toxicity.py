"""The toxicity classifier: features and ratios against plain counting, planted insults on held-out rows, odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest

from storelens.llm import toxicity as X
from tests.llm.conftest import rows_of, words

LABELS = "doc_id long, quality int, toxic int, text string, score string, _id string"
MASK = 0xFFFFFFFF


def number(gram):
    """The feature of an n-gram, one code point after another."""
    h = 0
    for c in gram:
        h = (h ^ ord(c)) * 0x9E3779B1 & MASK
        h ^= h >> 15
    return ((h + len(gram)) * 0x85EBCA6B & MASK) >> 32 - X.BITS


def brute_features(text):
    clean = " " + " ".join(text.lower().split()) + " "
    return Counter(number(clean[i:i + n]) for n in X.ORDERS for i in range(len(clean) - n + 1))


def corpus(seed=1, n=240):
    """Texts in three languages; a quarter holds insults of its language, a few times each."""
    rng = np.random.default_rng(seed)
    texts, toxic = [], []
    for i in range(n):
        lang = ["en", "fr", "de"][i % 3]
        w = words(rng, lang, int(rng.integers(60, 300)))
        bad = int(rng.random() < 0.25)
        for _ in range(int(rng.integers(2, 6)) if bad else 0):
            w.insert(int(rng.integers(0, len(w))), {"en": ["nitwit", "cretin"], "fr": ["andouille"], "de": ["dummkopf"]}[lang][
                int(rng.integers(0, 2)) if lang == "en" else 0])
        texts.append(" ".join(w))
        toxic.append(bad)
    return texts, toxic


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def marks(spark, pairs):
    return spark.createDataFrame([(i, 1, t, "x", "y", "z") for i, t in pairs], LABELS)


@pytest.mark.parametrize("text", ["", "a", " \t\n", "Some  words\nÉ \U0001F600 and MORE words", "x" * 3000, "lone \ud800 half"])
def test_features_equal_plain_counting(text):
    found, counts = X.features(text)
    assert dict(zip(found.tolist(), counts.tolist())) == dict(brute_features(text))


def test_long_texts_are_counted_whole_in_pieces(monkeypatch):
    text = " ".join(words(np.random.default_rng(2), "en", 3000))
    monkeypatch.setattr(X, "PIECE_CHARS", 1000)
    found, counts = X.features(text)
    assert X.features("x" * 50_000)[1].sum() > 140_000  # no white space to cut at
    want = Counter()
    for piece in X._pieces(text):
        want += brute_features(piece)
    assert "".join(X._pieces(text)) == text and dict(zip(found.tolist(), counts.tolist())) == dict(want)


def test_ratios_and_optimum():
    seen = np.array([[5.0, 0, 2, 0], [1, 3, 2, 0]])
    p, q = seen[1] + 1, seen[0] + 1
    want = np.log(p / p.sum() / (q / q.sum()))
    assert np.allclose(X.log_count_ratios(seen), [*want[:3], 0.0])
    # At the end the loss does not fall in any direction that was tried.
    rng = np.random.default_rng(0)
    rows = [(np.array([0, 1, 2]), rng.integers(1, 5, 3)) for _ in range(40)]
    y = np.array([int(n[1] > n[0]) for _, n in rows])
    ratios = np.zeros(X.FEATURES)
    ratios[:3] = [-1.0, 1.0, 0.3]
    m = X.fit(np.concatenate([f for f, _ in rows]), np.concatenate([n for _, n in rows]), np.full(40, 3), y, ratios, steps=200)

    def loss(w, b):
        each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(rows)
        z = np.array([X._vector(f, n, m.ratios) @ w[f] + b for f, n in rows])
        return (each * np.logaddexp(0, -np.where(y == 1, 1, -1) * z)).sum() + X.PENALTY / 2 * (w ** 2).sum()

    best = loss(m.weights.astype(float), m.bias)
    for _ in range(50):
        w = m.weights.astype(float).copy()
        w[:3] += rng.normal(0, 0.01, 3)
        assert loss(w, m.bias + rng.normal(0, 0.01)) >= best - 1e-4


def test_planted_insults_are_found_in_held_out_rows(spark, frame):
    texts, toxic = corpus()
    docs = frame(rows_of(texts))
    got = {r["doc_id"]: r for r in X.toxicity(docs, marks(spark, enumerate(toxic))).collect()}
    assert len(got) == len(texts) and all(r["held_out"] == is_held_out(i) for i, r in got.items())
    held = [i for i in got if is_held_out(i)]
    assert np.mean([got[i]["predicted"] == toxic[i] for i in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    # Labels of held-out rows, sources and languages are no inputs.
    other = [(i, 1 - t if is_held_out(i) else t) for i, t in enumerate(toxic)]
    again = {r["doc_id"]: r["score"] for r in X.toxicity(docs.drop("lang", "source"), marks(spark, other)).collect()}
    assert all(again[i] == got[i]["score"] for i in got)


def test_odd_rows(spark, frame, odd_texts):
    texts, toxic = corpus(3, 90)
    rows = rows_of(texts) + rows_of(odd_texts, 1000)
    rows += [rows[0], rows[0], (None, "no id", "en", "s", 5, *rows[0][5:])]
    labels = marks(spark, [*enumerate(toxic), (0, 0), (0, 1), (1, None), (None, 1), (99_999, 1)])
    got = X.toxicity(frame(rows), labels).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r[0]) for r in rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    assert all(len(s) == 1 for s in by_id.values()) and by_id[1000] == by_id[1001]


def test_nothing_to_learn_from(spark, frame, odd_texts):
    docs = frame(rows_of(odd_texts))
    share = lambda pairs: {r["score"] for r in X.toxicity(docs, marks(spark, pairs)).collect()}
    assert share([]) == {0.0} and share([(1, 0), (2, 0)]) == {0.0} and share([(i, 1) for i in range(6)]) == {1.0}
    empty = X.toxicity(frame([]), marks(spark, [(1, 1), (2, 0)]))
    assert empty.count() == 0 and empty.columns == ["doc_id", "held_out", "score", "predicted"]


def test_copies_of_a_sampled_text_leave_a_task_once():
    import pyarrow as pa
    from storelens.llm import toxicity as X

    texts = ["the same long text again and again"] * 300 + ["another text"]
    batch = pa.RecordBatch.from_pydict({"l": [1] * 300 + [0], "t": texts, "h": [7] * 300 + [8], "s": [True] * 301},
                                       schema=pa.schema([("l", pa.int32()), ("t", pa.string()), ("h", pa.int64()), ("s", pa.bool_())]))
    out = pa.Table.from_batches(list(X._count_features(iter([batch.slice(0, 100), batch.slice(100)])))).to_pylist()
    assert sorted((r["label"], r["text_hash"], r["text"]) for r in out if r["text"] is not None) == [
        (0, 8, "another text"), (1, 7, texts[0])]
    counts = {r["feature"]: (r["n_clean"], r["n_toxic"]) for r in out if r["feature"] is not None}
    own = set(X.features(texts[0])[0].tolist())
    assert all(counts[f][1] == 300 for f in own) and all(counts[f][0] == 1 for f in X.features("another text")[0].tolist())
    assert max(b.num_rows for b in X._count_features(iter([batch]))) <= X.COUNT_ROWS
