"""Small document tables for the corpus operators; the session fixture comes from the folder above."""

import numpy as np
import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use for their own columns.
    T.StructField("size", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("piece", T.StringType()),
    T.StructField("_row", T.LongType()), T.StructField("score", T.StringType()),
])
SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti".split(),
             "fr": "le ai ou eu qu on re de en es la un que eau oi è é ç".split(),
             "de": "en er ch ei ie sch ung te be ge ver zu ü ö ß au st".split()}


def words(rng, lang, n):
    s = SYLLABLES[lang]
    return ["".join(s[i] for i in rng.integers(0, len(s), rng.integers(1, 5))) for _ in range(n)]


def rows_of(texts, start=0):
    """Rows of DOC_SCHEMA; every third has a null source, languages in turn."""
    return [(i + start, t, ["en", "fr", "de", None][i % 4], None if i % 3 == 2 else f"src{i % 2}",
             None if t is None else len(t), "x", "y", "z", 7, "s") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and white texts, ties, repeated rows, a very long text, separators and special strings."""
    rng = np.random.default_rng(5)
    long_ = " ".join(words(rng, "en", 40_000))
    line = "this very line is found in many documents"
    return [None, "", " \t\n", "a", "A b c d", "a", "É x\x85y  z", "<|endoftext|> token", "naïve 中文 text́ ½ ² ok",
            long_, long_, long_ + " tail", f"first\n  {line.upper()} \nlast", f"{line}\n{line}\nmore", f"\t{line}", f"{line} \n",
            "\n\n", "x" * 5000, "it's 10,000.50\n\n\n  two   spaces\tand\ttabs", "!!! ??? ...", "12345 67890"]
