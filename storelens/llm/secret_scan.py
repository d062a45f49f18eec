"""Secret scan with false-positive removal by a random forest (DataFrame and Spark ML functions only).

A white-space separated word is cut into parts: runs of ``[A-Za-z0-9_+/-]`` with
up to two ``=`` of base64 padding, and whole values of credential names inside the
word (``API_KEY=..``, ``token="..."``, ``"password":"..."``), up to the closing quote
or the next delimiter.  A part that stands right after another one and ``=`` or
``:`` has that one as its name; the name is not part of the value.  A word can hold
any number of candidates, which are

* parts of at least 16 characters with a digit;
* shorter values with a digit of a credential name inside the word;
* values of ``name=value`` if both together are at least 16 characters with a digit.

So a value without any digit, and a value under 16 characters whose name is no
credential's or stands in another word, is none.  Features of a candidate:

* its length, its share of different characters, digits and upper case, and how
  often the character class changes along it;
* the mean log-probability of its character transitions, under transition
  counts of all words of the corpus;
* dictionary coverage: the share of its letters that lie in runs which the
  corpus has as words often enough;
* the parts of its name in the word, the words before and after it and the parts
  of its path (the document's source), hashed.

A random forest is trained on labelled findings (a bounded, seeded sample of
``sample_rows``) and gives every candidate the probability of being a secret.
``rule_labels`` labels findings where no reviewed labels exist: a value that is
assigned to the name of a credential, in the word itself or in the words before
it, is one, any other and a number of up to eight digits is not.

Defined results: null or empty text has no candidates; an empty table gives no
rows; without findings of both labels the score is the share of true labels;
null sources count as empty paths; repeated rows give repeated findings;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, text_or_empty

RUN = "[A-Za-z0-9_+/=-]{16,}"
CREDENTIAL = "(?i)(token|secret|passw(or)?d|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer)"
ASSIGN = "[\\\\\"'\\])]{0,4}(?::=|=>|[=:]{1,2})[\\\\\"'(\\[]{0,4}"  # with the quotes and brackets around it
# A look-behind needs a bound: up to 64 characters of the name may follow what makes it a credential's.
_NAMED = f"(?<=[=:>\"'(\\[\\\\])(?<={CREDENTIAL}[A-Za-z0-9_.-]{{0,64}}{ASSIGN})"
PART = (f"{_NAMED}(?<=[\"'])[^\"'\\\\]+"  # in quotes: up to the closing one
        f"|{_NAMED}(?![=:>])[^\"'\\\\,;&(){{}}\\[\\]<>]*[^\"'\\\\,;&(){{}}\\[\\]<>.:?#]"  # else to a delimiter
        # Any run; = is padding unless a value, in quotes or not, comes after it.
        "|[A-Za-z0-9_+/-]+(?:={1,2}(?![A-Za-z0-9_+/=>-]|[\\\\\"'(\\[]{1,4}[^\\\\\"'()\\[\\]{},;:.#&<>]))?")
MIN_WORD_COUNT = 5       # occurrences that make a corpus word a dictionary word
SAMPLE_ROWS = 20_000     # labelled findings of the training sample
TREES, DEPTH, SEED = 24, 8, 11
HASHED = 256
THRESHOLD = 0.5
NUMERIC = ["log_length", "distinct_share", "digit_share", "upper_share", "class_changes", "transition", "coverage"]


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``_finding, _id, _path, word, start, value, name, first, before2, before, after`` of every candidate.

    ``word`` is the number of the word in the text, ``start`` the offset of the value in characters, ``name`` the
    name in the word that the value is assigned to (or empty), ``first`` whether the value is the word's first part.
    """
    text = text_or_empty(text_col)
    words = F.col("_words")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("_path"),
                       F.split(text, "[ \\t-\\r]", -1).alias("_words"))
    hit = lambda w: w.rlike("[0-9]") & (((F.length(w) >= 16) & w.rlike(RUN))
                                        | (w.rlike("[=:]") & w.rlike(CREDENTIAL)))
    at = F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())
    found = rows.withColumn("_at", at).filter(F.size("_at") > 0).select("_id", "_path", "_words", F.explode("_at").alias("word"))
    prefix = F.when(F.col("word") > 0, F.length(F.array_join(F.slice(words, F.lit(1), F.col("word")), " ")) + 1).otherwise(0)
    near = lambda k: F.lower(F.coalesce(F.get(words, F.col("word") + k), F.lit("")))
    values = found.withColumn("_value", F.explode(_values(F.get(words, F.col("word")))))
    return values.select(
        F.monotonically_increasing_id().alias("_finding"), "_id", "_path", F.col("word").cast("long").alias("word"),
        (prefix + F.col("_value.start")).cast("long").alias("start"), F.col("_value.value").alias("value"),
        F.col("_value.name").alias("name"), F.col("_value.first").alias("first"), near(-2).alias("before2"), near(-1).alias("before"), near(1).alias("after"))


def _values(word: Column) -> Column:
    """Array of ``value, start, name, first``: the candidates among the parts of ``word``, with their offsets in it."""
    parts, gaps = F.regexp_extract_all(word, F.lit(PART), F.lit(0)), F.split(word, PART, -1)
    places = F.sequence(F.lit(0), F.size(parts) - 1)
    # The end of the part before each part; the gaps are what stands before, between and after the parts.
    ends = F.aggregate(places, F.array(F.lit(0)), lambda a, i: F.concat(
        a, F.array(F.element_at(a, -1) + F.length(F.get(gaps, i)) + F.length(F.get(parts, i)))))
    found = F.transform(places, lambda i: F.struct(
        F.get(parts, i).alias("value"), (F.get(ends, i) + F.length(F.get(gaps, i))).alias("start"),
        F.when((i > 0) & F.get(gaps, i).rlike(f"^{ASSIGN}$"), F.get(parts, i - 1)).otherwise("").alias("name"),
        F.get(gaps, i).alias("gap"), (i == 0).alias("first")))
    digit = lambda c: c.rlike("[0-9]")
    joined = lambda v: F.concat(v["name"], v["gap"], v["value"])
    return F.filter(found, lambda v: (digit(v["value"]) & ((F.length(v["value"]) >= 16) | v["name"].rlike(CREDENTIAL)))
                    | ((v["name"] != "") & v["gap"].rlike("^=+$") & (F.length(joined(v)) >= 16) & digit(joined(v))))


def corpus_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``w, n``: every word (letters, lower case, 2 to 40 of them) of the corpus with its count."""
    return docs.select(F.explode(F.split(F.lower(text_or_empty(text_col)), "[^\\p{L}]+")).alias("w")) \
        .filter(F.length("w").between(2, 40)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def _symbols(col: Column) -> Column:
    """Lower case with everything but a-z and digits as #: 37 symbols."""
    return F.regexp_replace(F.lower(col), "[^a-z0-9]", "#")


def _pairs(col: Column) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(col) - 1), lambda i: F.substring(col, i, F.lit(2))))


def transitions(words: DataFrame) -> DataFrame:
    """``pair, logp``: smoothed log-probability of the second symbol after the first; at most 37 x 37 rows."""
    pairs = words.withColumn("s", F.concat(_symbols(F.col("w")), F.lit("#"))).select(_pairs(F.col("s")).alias("pair"), "n") \
        .groupBy("pair").agg(F.sum("n").alias("n"))
    first = pairs.groupBy(F.substring("pair", 1, 1).alias("a")).agg(F.sum("n").alias("m"))
    return pairs.join(F.broadcast(first), F.substring("pair", 1, 1) == F.col("a")).select(  # 37 rows
        "pair", F.log((F.col("n") + 1) / (F.col("m") + 37)).alias("logp"))


def with_features(findings: DataFrame, words: DataFrame, min_word_count: int = MIN_WORD_COUNT) -> DataFrame:
    """``findings`` with the numeric features and ``context``, the hashed parts."""
    v = F.col("value")
    n = F.length(v)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        v, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1"), "[^aB1]", "_")
    changes = F.length(F.regexp_replace(classes, "(.)\\1+", "$1")) - 1
    share = lambda c: F.length(F.regexp_replace(v, f"[^{c}]", "")) / n
    base = findings.withColumns({
        "log_length": F.log(n.cast("double")),
        "distinct_share": F.size(F.array_distinct(F.split(v, ""))) / n,
        "digit_share": share("0-9"), "upper_share": share("A-Z"), "class_changes": changes / n,
        "context": F.concat(F.array(F.concat(F.lit("b2:"), "before2"), F.concat(F.lit("b1:"), "before"),
                                    F.concat(F.lit("a1:"), "after")),
                            F.transform(F.split(F.lower("name"), "[_.-]+"), lambda p: F.concat(F.lit("n:"), p)),
                            F.transform(F.split("_path", "[/\\\\.]+"), lambda p: F.concat(F.lit("p:"), p)))})
    logp = findings.select("_finding", _pairs(_symbols(v)).alias("pair")) \
        .join(F.broadcast(transitions(words)), "pair", "left") \
        .groupBy("_finding").agg(F.avg(F.coalesce("logp", F.lit(-6.0))).alias("transition"))
    runs = findings.select("_finding", n.alias("len"), F.explode(F.split(F.lower(v), "[^\\p{L}]+")).alias("w")) \
        .filter(F.length("w") >= 3)
    known = runs.join(words.filter(F.col("n") >= min_word_count).select("w"), "w") \
        .groupBy("_finding").agg((F.sum(F.length("w")) / F.first("len")).alias("coverage"))
    return base.join(logp, "_finding", "left").join(known, "_finding", "left") \
        .fillna(0.0, ["coverage"]).fillna(-6.0, ["transition"])


def rule_labels(findings: DataFrame) -> DataFrame:
    """``label`` 1 for a value that is assigned to the name of a credential.

    The name stands in the value's own word (``name=value``, ``"name":"value"``) or, for the first part of a word, in
    the words before it (``name = value``, ``name: value``).  Numbers of up to eight digits (``max_tokens=4096``) are 0.
    """
    spaced = (F.col("before2").rlike(CREDENTIAL) & F.col("before").rlike("^[=:]+$")) | \
        (F.col("before").rlike(CREDENTIAL) & F.col("before").rlike("[=:]$"))
    named = (F.col("name").rlike(CREDENTIAL) | (F.col("first") & spaced)) & ~F.col("value").rlike("^[0-9]{1,8}$")
    return findings.withColumn("label", F.when(named, 1.0).otherwise(0.0))


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """A fitted pipeline from findings with features and ``label``, or the share of true labels if they are all alike."""
    rows = labelled.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), "value", "_id"), F.lit(1 << 30))
    sample = store(labelled.filter(draw < int(min(1.0, sample_rows / max(rows, 1)) * (1 << 30)))
                   .select(*NUMERIC, "context", "label"), "labelled-findings")
    counts = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("p")).first()
    if counts["p"] in (0.0, counts["n"]):
        return float(counts["p"] / max(counts["n"], 1))
    stages = [HashingTF(numFeatures=HASHED, binary=True, inputCol="context", outputCol="_hashed"),
              VectorAssembler(inputCols=[*NUMERIC, "_hashed"], outputCol="_features"),
              RandomForestClassifier(featuresCol="_features", labelCol="label", probabilityCol="_probability",
                                     rawPredictionCol="_raw", predictionCol="_prediction",
                                     numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(sample)


def score(findings: DataFrame, model) -> DataFrame:
    """``findings`` with ``score``, the probability of being a secret."""
    if isinstance(model, float):
        return findings.withColumn("score", F.lit(model))
    return model.transform(findings).withColumn("score", vector_to_array("_probability")[1])


def scan(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
         path_col: str = "source", model=None, **training) -> DataFrame:
    """``doc_id, word, start, value, score, secret`` of every candidate of ``docs``; trains on rule labels unless given a ``model``."""
    findings = store(find_candidates(docs, id_col, text_col, path_col), "candidates")
    words = store(corpus_words(docs, text_col), "corpus-words")
    ready = store(with_features(findings, words), "finding-features")
    if model is None:
        model = train(rule_labels(ready), **training)
    return score(ready, model).select(
        F.col("_id").alias(id_col), "word", "start", "value", "score", (F.col("score") >= threshold).alias("secret"))
