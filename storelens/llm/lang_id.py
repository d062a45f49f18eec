"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a language label; its score is the sum of weights of
its affixes, its character n-grams and the word itself (a learned lexicon), and
learned transition weights tie neighbouring words.  Forward-backward gives each
word's posterior, and a document's language is the one with the highest mean
posterior over its words, so code-switched text is labelled word by word.

The model is fitted on a bounded sample of labelled rows (about ``sample_rows`` distinct texts per
language, a seeded window of at most ``sample_chars`` of each): short runs of
words of different documents are strung together, so that transitions between
languages are seen, and the conditional likelihood is raised by gradient steps.
Prediction reads whole texts.  It works on blocks of words at once: the product
of a block's transition matrices carries the chain over the block, so the pass
over a long text is a pass over its blocks.

Defined results: ``und`` with score 0 if the text is null or has no letter, or
if no row is labelled; a text of more than a million characters is labelled in
pieces of about that size, cut at white space; an empty table gives no rows;
repeated rows get the same answer; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import worker_state
from .shingles import slices

UNKNOWN = "und"
FEATURES = 1 << 16
SAMPLE_ROWS = 400       # labelled rows per language, about
SAMPLE_CHARS = 8_000    # of each of them
EPOCHS = 4
RATE = 0.3
SEED = 20240607
PIECE_CHARS = 1_000_000
SLICE_BYTES = 1 << 18   # text labelled at a time
BLOCK = 64              # words of one block of the forward-backward pass
MIN_SHARE = 0.3         # of the words' posterior, for a document to be kept by ``keep_identified``

_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _hash(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint32)
    for p in parts:
        h = (h ^ p) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h & np.uint32(FEATURES - 1)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words and the word of each: two- and three-letter
    n-grams with the word's edges, prefixes and suffixes of three and four letters, and the whole word."""
    code = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    owner = np.repeat(np.arange(len(words)), size)
    out, who = [], []
    for n in (2, 3):
        at = np.flatnonzero(np.arange(len(code)) + n <= ends[owner])
        out.append(_hash(np.full(len(at), n, np.uint32), *[code[at + i] for i in range(n)]))
        who.append(owner[at])
    for n in (3, 4):
        long_ = np.flatnonzero(size - 2 >= n)
        for kind, at in ((10 + n, starts[long_] + 1), (20 + n, ends[long_] - 1 - n)):
            out.append(_hash(np.full(len(at), kind, np.uint32), *[code[at + i] for i in range(n)]))
            who.append(long_)
    # The whole word: a sum of its letters' hashes by place.
    place = (np.arange(len(code)) - starts[owner]).astype(np.uint32)
    letter = (code ^ (place * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    letter ^= letter >> np.uint32(13)
    out.append(_hash(np.add.reduceat(letter * np.uint32(0x27D4EB2F), starts)))
    who.append(np.arange(len(words)))
    return np.concatenate(out).astype(np.int64), np.concatenate(who)


@dataclass
class Crf:
    """Labels, feature weights (features x labels) and transition weights (from x to)."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        f, who = features(words)
        return np.stack([np.bincount(who, weights=self.weights[f, k], minlength=len(words))
                         for k in range(len(self.labels))], axis=1)

    def posteriors(self, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Posterior of every label at every word; ``lengths`` are the words of each sequence, one after another."""
        g = np.multiply(*self._passes(emission, lengths)[:2])
        return g / g.sum(axis=1, keepdims=True)

    def expected(self, emission: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors, and the expected number of each transition between neighbouring words.

        A sequence follows a word that is not seen, whose label is any.
        """
        alpha, beta, score = self._passes(emission, lengths)
        before = np.vstack((np.ones((1, alpha.shape[1])), alpha[:-1]))
        before[np.cumsum(lengths) - lengths] = 1.0
        pair = before[:, :, None] * np.exp(self.transitions) * (score * beta)[:, None, :]
        g = alpha * beta
        return g / g.sum(axis=1, keepdims=True), (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)

    def _passes(self, emission: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward messages and emission factors of every word, each up to a factor per word."""
        n, k = emission.shape
        a = np.exp(self.transitions)
        blocks = -(-lengths // BLOCK)
        first = np.cumsum(blocks) - blocks
        total = int(blocks.sum())
        seq = np.repeat(np.arange(len(lengths)), blocks)
        inside = np.arange(total) - first[seq]
        size = np.minimum(BLOCK, lengths[seq] - inside * BLOCK)
        start = (np.cumsum(lengths) - lengths)[seq] + inside * BLOCK
        score = np.exp(emission - emission.max(axis=1, keepdims=True))
        here = np.arange(BLOCK) < size[:, None]
        e = np.ones((total, BLOCK, k))
        e[here] = score[(start[:, None] + np.arange(BLOCK))[here]]
        whole = np.broadcast_to(np.eye(k), (total, k, k)).copy()
        for t in range(BLOCK):
            on = here[:, t]
            step = (whole[on] @ a) * e[on, t][:, None, :]
            whole[on] = step / step.sum(axis=(1, 2), keepdims=True)
        # Over the blocks of each sequence, all sequences at a time.
        into, out = np.full((total, k), 1.0 / k), np.ones((total, k))
        for j in range(1, int(blocks.max(initial=0))):
            at = first[blocks > j] + j
            v = np.einsum("bi,bij->bj", into[at - 1], whole[at - 1])
            into[at] = v / v.sum(axis=1, keepdims=True)
            back = first[blocks > j] + blocks[blocks > j] - 1 - j
            v = np.einsum("bij,bj->bi", whole[back + 1], out[back + 1])
            out[back] = v / v.sum(axis=1, keepdims=True)
        alpha, beta = np.empty((total, BLOCK, k)), np.ones((total, BLOCK, k))
        v = into
        for t in range(BLOCK):
            v = (v @ a) * e[:, t]
            v = v / v.sum(axis=1, keepdims=True)
            alpha[:, t] = v
        v = out.copy()
        for t in range(BLOCK - 1, -1, -1):
            beta[:, t] = v
            on = here[:, t]
            w = (e[on, t] * v[on]) @ a.T
            v[on] = w / w.sum(axis=1, keepdims=True)
        return alpha[here], beta[here], score


def gradient(model: Crf, emission: np.ndarray, lengths: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the conditional log-likelihood of the labels ``gold``: by the emissions, and by the transition weights."""
    k = emission.shape[1]
    post, pair = model.expected(emission, lengths)
    delta = -post
    delta[np.arange(len(gold)), gold] += 1
    first = np.cumsum(lengths) - lengths
    right = np.delete(np.arange(len(gold)), first)
    seen = np.bincount(gold[right - 1] * k + gold[right], minlength=k * k).reshape(k, k).astype(float)
    a = np.exp(model.transitions)
    np.add.at(seen.T, gold[first], (a / a.sum(axis=0)).T[gold[first]])  # of the unseen word before
    return delta, seen - pair


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Crf:
    """A model of the labelled texts, by AdaGrad on the conditional log-likelihood of strung runs of words."""
    labels = sorted(set(langs))
    number = {v: i for i, v in enumerate(labels)}
    k = len(labels)
    rng = np.random.Generator(np.random.PCG64(seed))
    model = Crf(labels, np.zeros((FEATURES, k)), np.zeros((k, k)))
    runs: list[tuple[list[str], int]] = []
    for text, lang in zip(texts, langs):
        w = words_of(text)
        at = 0
        while at < len(w):
            n = int(rng.integers(6, 25))
            runs.append((w[at:at + n], number[lang]))
            at += n
    gw, gt = np.full((FEATURES, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(epochs if k > 1 else 0):
        order = rng.permutation(len(runs))
        for i in range(0, len(order), 1024):
            part = [runs[j] for j in order[i:i + 1024]]
            words = [w for run, _ in part for w in run]
            gold = np.repeat([y for _, y in part], [len(run) for run, _ in part])
            # Strings of four runs.
            sizes = np.array([len(run) for run, _ in part])
            lengths = np.add.reduceat(sizes, np.arange(0, len(sizes), 4))
            distinct: dict[str, int] = {}
            at = np.array([distinct.setdefault(w, len(distinct)) for w in words])
            f, who = features(list(distinct))
            em = np.stack([np.bincount(who, weights=model.weights[f, c], minlength=len(distinct)) for c in range(k)], axis=1)
            delta, by_transition = gradient(model, em[at], lengths, gold)
            per_word = np.stack([np.bincount(at, weights=delta[:, c], minlength=len(distinct)) for c in range(k)], axis=1)
            grad = np.stack([np.bincount(f, weights=per_word[who, c], minlength=FEATURES) for c in range(k)], axis=1)
            grad = grad / len(words) * 100 - 1e-4 * model.weights
            gw += grad ** 2
            model.weights += rate * grad / np.sqrt(gw)
            tgrad = by_transition / len(words)
            gt += tgrad ** 2
            model.transitions += 0.1 * tgrad / np.sqrt(gt)
    model.weights = model.weights.astype(np.float32)
    return model


def held_out(id_col: str | Column) -> Column:
    """Documents that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(F.encode(col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, seed: int = SEED,
          text_col: str = "text", lang_col: str = "lang") -> Crf:
    """Fit on a seeded sample of about ``sample_rows`` distinct texts per language, at most twice as many.

    The draw is by the text's hash and copies count once, so a repeated text takes no other's place and every
    language has its own share.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    hashed = rows.withColumn("draw", F.xxhash64(F.lit(seed), "text"))
    counts = hashed.groupBy("lang", "draw").agg(F.count(F.lit(1)).alias("copies")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n")).collect()  # one row per language
    if not counts:
        return Crf([], np.zeros((FEATURES, 0)), np.zeros((0, 0)))
    part = F.pmod("draw", F.lit(1 << 30))
    wanted = F.lit(False)
    for r in counts:
        wanted = wanted | ((F.col("lang") == r["lang"]) & (part < int(min(1.0, sample_rows / r["n"]) * (1 << 30))))
    room = F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1
    window = F.substring("text", F.lit(1) + F.pmod(F.xxhash64(F.lit(seed + 1), "text"), room).cast("int"), F.lit(sample_chars))
    drawn = hashed.filter(wanted).select("lang", "draw", window.alias("text")).groupBy("lang", "draw").agg(F.first("text").alias("text"))
    least = Window.partitionBy("lang").orderBy("draw")  # over the drawn rows only
    sample = drawn.withColumn("at", F.row_number().over(least)).filter(F.col("at") <= 2 * sample_rows).select("lang", "text").collect()
    sample.sort(key=lambda r: (r["lang"], r["text"]))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample], seed=seed)


def label_texts(model: Crf, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and mean posterior of each text."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not model.labels:
        return langs, scores
    distinct: dict[str, int] = {}
    at, lengths, owner = [], [], []
    for i, text in enumerate(texts):
        if text is None or not has_letter(text):
            continue
        start = 0
        while start < len(text):
            stop = len(text)
            if stop - start > PIECE_CHARS:
                space = re.compile(r"\s").search(text, start + PIECE_CHARS)
                stop = space.end() if space else stop
            w = words_of(text[start:stop])
            if w:
                at += [distinct.setdefault(x, len(distinct)) for x in w]
                lengths.append(len(w))
                owner.append(i)
            start = stop
    if not at:
        return langs, scores
    post = model.posteriors(model.emissions(list(distinct))[at], np.array(lengths))
    ends = np.cumsum(lengths)
    sums = np.add.reduceat(post, ends - lengths, axis=0)
    total = np.zeros((len(texts), len(model.labels)))
    np.add.at(total, owner, sums)
    n = np.bincount(owner, weights=lengths, minlength=len(texts))
    for i in set(owner):
        best = int(total[i].argmax())
        langs[i], scores[i] = model.labels[best], float(min(1.0, total[i, best] / n[i]))
    return langs, scores


def predict(docs: DataFrame, model: Crf, text_col: str = "text", lang_as: str = "lang_pred",
            score_as: str = "score") -> DataFrame:
    """``docs`` with the language and score of its texts; columns of those names are replaced."""
    # Plain arrays: one row of numbers per feature, a fixed size per language.
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.transitions))
    keep = [c for c in docs.columns if c not in (lang_as, score_as)]
    place = keep.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("languages")  # drops what earlier stages kept
        crf = Crf(*shared.value)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                langs, scores = label_texts(crf, part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                                 names=[*part.schema.names, lang_as, score_as])

    rows = docs.select(*keep)
    schema = T.StructType([*rows.schema.fields, T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())])
    return rows.mapInArrow(label, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learns from the labelled documents that are not held out."""
    model = train(docs.filter(~held_out(id_col)), text_col=text_col, lang_col=lang_col, **options)
    found = predict(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, "_text",
                    "lang_pred", "score")
    return found.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_share: float = MIN_SHARE, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang", **options) -> DataFrame:
    """``docs`` without those of no language (``und``) or in which no language holds ``min_share`` of the words."""
    model = train(docs.filter(~held_out(id_col)), text_col=text_col, lang_col=lang_col, **options)
    found = predict(docs, model, text_col, "_lang_pred", "_lang_score")
    return found.filter((F.col("_lang_pred") != UNKNOWN) & (F.col("_lang_score") >= min_share)).select(*docs.columns)
