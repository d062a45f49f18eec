"""Toxicity scores by a character n-gram linear classifier on naive Bayes log-count ratios.

A text's features are its n-grams (5 to 7 characters, hashed) of the lower-cased text with white space as one
space, with their counts.  For every feature the documents of either label that have it are counted over all labelled documents; the
smoothed log ratio of their shares scales the feature's count, the scaled counts of a text are brought to one length, and a logistic
regression is fitted on them.  So a score is the logistic function of a weighted sum over the whole text's n-grams.

1. Labels meet texts in one join; from it each task returns counts per feature (summed by Spark, one row per feature)
   and the features of the rows that the regression is fitted on.
2. The regression is fitted on the driver on a bounded sample: at most ``sample_rows`` distinct texts per label, those with
   the smallest seeded hash, whole texts, without features that less than ``MIN_SHARE`` of the labelled documents have.
   Both labels weigh the same.
3. Scoring reads whole texts, about a million characters at a time, and needs no shuffle.

Defined results: null text is the empty text, whose score is that of the bias; a document labelled both ways is toxic; null labels and
labels of unknown documents are ignored; repeated rows get the same score; if only one label (or none) is there to learn from, every
score is the share of toxic rows (0 if there are no labels); n-grams across the cuts of a very long text (at white space) are not
counted; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, text_or_empty
from .shingles import slices

ORDERS = (5, 6, 7)
BITS = 18
FEATURES = 1 << BITS
SAMPLE_ROWS = 500       # texts per label in the regression's sample, at most
MIN_SHARE = 0.001       # of the labelled documents have a feature of the regression, at least (and three documents)
SMOOTHING = 1.0
LENGTH = 30.0           # of a text's vector of scaled counts
PENALTY = 0.1           # of the squared weights
STEPS = 60              # of the optimiser, at most
BLOCK_ROWS = 100        # texts of the regression taken at a time
SEED = 20240811
PIECE_CHARS = 1_000_000
COUNT_ROWS = 16_384     # feature counts that leave a task in one batch

_SPACE = re.compile(r"\s+")


def _hashes(code: np.ndarray) -> np.ndarray:
    """Feature numbers of all n-grams of a text given as code points; a longer n-gram's hash goes on from the shorter one's."""
    h, found = np.zeros(len(code), np.uint32), []
    for n in range(1, ORDERS[-1] + 1):
        size = max(len(code) - n + 1, 0)
        h = (h[:size] ^ code[n - 1:n - 1 + size]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            x = (h + np.uint32(n)) * np.uint32(0x85EBCA6B)
            found.append((x >> np.uint32(32 - BITS)).astype(np.int32))
    return np.concatenate(found)


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PIECE_CHARS:
        space = _SPACE.search(text, start + PIECE_CHARS)
        stop = space.start() if space and space.start() < start + 2 * PIECE_CHARS else start + PIECE_CHARS
        yield text[start:stop]
        start = stop
    yield text[start:]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature numbers of a text, ascending, and how often each occurs."""
    numbers, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for piece in _pieces(text):
        clean = " " + _SPACE.sub(" ", piece.lower()).strip() + " "
        at = np.sort(_hashes(np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), dtype="<u4")))
        first = np.flatnonzero(np.diff(at, prepend=-1))
        more, n = at[first], np.diff(np.append(first, len(at)))
        if len(numbers):
            both = np.concatenate((numbers, more))
            more, which = np.unique(both, return_inverse=True)
            n = np.bincount(which, weights=np.concatenate((counts, n))).astype(np.int64)
        numbers, counts = more, n
    return numbers, counts


def _vector(found: np.ndarray, counts: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The counts of a text's features, scaled by their ratios and brought to ``LENGTH``."""
    x = counts * ratios[found]
    return x * (LENGTH / max(float(np.sqrt((x * x).sum())), 1e-9))


@dataclass
class Model:
    """Log-count ratio and regression weight of each feature, and the bias; without them, a constant score."""

    bias: float
    ratios: np.ndarray | None = None
    weights: np.ndarray | None = None
    constant: float = 0.0

    def score(self, texts: list[str | None]) -> list[float]:
        if self.weights is None:
            return [self.constant] * len(texts)
        sums = []
        for t in texts:
            found, counts = features(t or "")
            sums.append(float(_vector(found, counts, self.ratios) @ self.weights[found]) + self.bias)
        return (1.0 / (1.0 + np.exp(-np.clip(np.array(sums, dtype=np.float64), -500, 500)))).tolist()


def log_count_ratios(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Of each feature, the log ratio of its smoothed shares among the documents' features of label 1 and label 0; 0 where it was never seen."""
    p, q = counts[1] + smoothing, counts[0] + smoothing
    return np.where(counts.sum(axis=0) > 0, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def fit(found: np.ndarray, counts: np.ndarray, sizes: np.ndarray, labels: np.ndarray, ratios: np.ndarray,
        penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """Logistic regression on the vectors of texts, by limited-memory BFGS; both labels weigh the same.

    ``found`` and ``counts`` are the features of all texts one after another, ``sizes`` how many each has.  The loss is
    summed over ``BLOCK_ROWS`` texts at a time, so little is held beside the vectors.
    """
    ratios = ratios.astype(np.float32)
    stop = np.cumsum(sizes)
    start = stop - sizes
    x = np.empty(len(found), np.float32)
    for a, b in zip(start.tolist(), stop.tolist()):
        x[a:b] = _vector(found[a:b], counts[a:b], ratios)
    y = np.where(labels == 1, 1.0, -1.0)
    each = np.where(labels == 1, 0.5 / max((labels == 1).sum(), 1), 0.5 / max((labels == 0).sum(), 1)) * len(labels)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        total, grad = 0.0, np.append(penalty * w[:-1], 0.0)
        for i in range(0, len(labels), BLOCK_ROWS):
            j = min(i + BLOCK_ROWS, len(labels))
            part = slice(start[i], stop[j - 1])
            owner = np.repeat(np.arange(j - i), sizes[i:j])
            sums = np.bincount(owner, weights=w[found[part]] * x[part], minlength=j - i) + w[-1]
            margin = y[i:j] * sums
            total += float((each[i:j] * np.logaddexp(0.0, -margin)).sum())
            pull = -each[i:j] * y[i:j] / (1.0 + np.exp(np.clip(margin, -500, 500)))
            grad[:-1] += np.bincount(found[part], weights=pull[owner] * x[part], minlength=FEATURES)
            grad[-1] += pull.sum()
        return total + penalty / 2 * float((w[:-1] ** 2).sum()), grad

    w = np.zeros(FEATURES + 1)
    loss, grad = value(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = grad.copy(), []
        for s, g, rho in reversed(past):
            alphas.append(rho * (s @ d))
            d -= alphas[-1] * g
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0 / max(1.0, np.linalg.norm(grad))
        for (s, g, rho), a in zip(past, reversed(alphas)):
            d += (a - rho * (g @ d)) * s
        slope, step = -(grad @ d), 1.0
        while True:
            new, new_grad = value(w - step * d)
            if new <= loss + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        if step < 1e-10:
            break
        s, g = -step * d, new_grad - grad
        if s @ g > 1e-12:
            past = [*past, (s, g, 1.0 / (s @ g))][-8:]
        done = loss - new <= 1e-7 * max(loss, 1e-9)
        w, loss, grad = w + s, new, new_grad
        if done:
            break
    return Model(float(w[-1]), ratios, w[:-1].astype(np.float32))


def held_out(id_col: str | Column) -> Column:
    """Documents that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(F.encode(col.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, the documents of each label that have a feature; and the sampled texts."""
    seen = np.zeros((2, FEATURES), np.int64)
    names = ["feature", "n_clean", "n_toxic", "label", "text_hash", "text"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]

    def batch(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    sent = set()  # at most the sample's distinct texts
    for whole in batches:
        for part in slices(whole):
            rows = []
            for label, text, hash_, sampled in zip(*[part.column(i).to_pylist() for i in range(4)]):
                seen[label, features(text)[0]] += 1
                if sampled and (label, hash_) not in sent:  # copies of one text are one row of the sample
                    sent.add((label, hash_))
                    rows.append((None, None, None, label, hash_, text))
            if rows:
                yield batch(*zip(*rows))
    at = np.flatnonzero(seen.any(axis=0))
    for i in range(0, len(at), COUNT_ROWS):
        some = at[i:i + COUNT_ROWS]
        nothing = [None] * len(some)
        yield batch(some.astype(np.int32), seen[0, some], seen[1, some], nothing, nothing, nothing)


def _sampled_features(mask: np.ndarray):
    """The features, with their counts, of sampled texts; only those of the mask (one bit per feature)."""
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(mask).astype(bool)
        for whole in batches:
            for part in slices(whole):
                lists = [features(t) for t in part["text"].to_pylist()]
                on = [keep[f] for f, _ in lists]
                yield pa.RecordBatch.from_arrays(
                    [part["label"], part["text_hash"],
                     *[pa.array([x[i][k].astype("<i4").tobytes() for x, k in zip(lists, on)], pa.binary()) for i in (0, 1)]],
                    names=["label", "text_hash", "found", "counts"])
    return sampled


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = SEED, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the labelled documents."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max((F.col(label_col) == 1).cast("int")).alias("_label"))
    # Merge joins at every size: the labels grow with the corpus, and adaptive execution can split a hot id of a stored table.
    marks = store(marks, "toxicity-labels").hint("merge")
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    # The sample: the distinct texts of each label with the smallest hashes; the hashes are narrow rows.
    hashed = texts.select("_id", F.xxhash64(F.lit(seed), "_text").alias("_hash")).join(marks, "_id") \
        .groupBy("_label", "_hash").agg(F.count(F.lit(1)).alias("_copies"))
    hashed = store(hashed, "toxicity-hashes")
    sizes = {r["_label"]: r["n"] for r in hashed.groupBy("_label").agg(F.sum("_copies").alias("n")).collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        return Model(0.0, constant=sizes.get(1, 0) / total if total else 0.0)
    last = {}
    for label in sizes:  # the hash at the bound, one number per label
        few = hashed.filter(F.col("_label") == label).select("_hash").orderBy("_hash").limit(sample_rows)
        last[label] = few.agg(F.max("_hash")).first()[0]
    sampled = F.col("_hash") <= F.when(F.col("_label") == 1, F.lit(last[1])).otherwise(F.lit(last[0]))
    joined = texts.join(marks, "_id").withColumn("_hash", F.xxhash64(F.lit(seed), "_text")).select(
        "_label", "_text", "_hash", sampled.alias("_sampled"))
    made = store(joined.mapInArrow(_count_features, "feature int, n_clean long, n_toxic long, label int, text_hash long, text string"),
                 "toxicity-counts")
    seen = np.zeros((2, FEATURES))
    summed = made.filter(F.col("feature").isNotNull()).groupBy("feature").agg(F.sum("n_clean").alias("n0"), F.sum("n_toxic").alias("n1")).toArrow()
    for label in (0, 1):  # at most FEATURES rows
        seen[label, summed["feature"].to_numpy()] = summed[f"n{label}"].to_numpy()
    often = seen.sum(axis=0) >= max(3.0, MIN_SHARE * total)
    # Copies of one text are one row of the sample.
    rows = made.filter(F.col("text").isNotNull()).select("label", "text_hash", "text").dropDuplicates(["label", "text_hash"]) \
        .mapInArrow(_sampled_features(np.packbits(often)), "label int, text_hash long, found binary, counts binary").toArrow() \
        .sort_by([("label", "ascending"), ("text_hash", "ascending")])
    found, counts = [np.concatenate([np.frombuffer(b.as_buffer(), "<i4") for b in rows[c]]) for c in ("found", "counts")]
    sizes_ = np.array([len(b.as_buffer()) // 4 for b in rows["found"]])
    marked = rows["label"].to_numpy()
    del rows
    return fit(found, counts, sizes_, marked, log_count_ratios(seen) * often)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.bias, model.ratios, model.weights, model.constant))  # two numbers per feature

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for whole in batches:
            for part in slices(whole):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.score(part.column(1).to_pylist()), pa.float64())],
                                                 names=["_id", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(score, f"_id {rows.schema['_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted``; learns from the labels of documents that are not held out."""
    model = train(docs, labels.filter(~held_out(id_col)), sample_rows, id_col=id_col, text_col=text_col, label_col=label_col)
    scored = score_texts(docs, model, id_col, text_col)
    return scored.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
