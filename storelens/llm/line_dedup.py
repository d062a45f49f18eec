"""Line dedup: drop lines that many documents share (DataFrame functions only).

Method: explode the normalised lines, hash them, count distinct documents per
hash, drop the lines over the threshold and reassemble by position.

Only hashes and positions are shuffled for the counting; the texts move once, to
meet the sorted list of their dropped positions.  A line that a third of all
documents hold costs one row per document in a join that adaptive execution can
split, and one pre-aggregated row per task in the count.

Defined results: null or empty text is one empty line; an empty table gives an
empty table; rows with the same ``doc_id`` are one document, and each of them
keeps its own text; null ``doc_id`` is one document that comes before all
others; further columns pass through, and ``n_lines`` / ``n_dropped`` columns
of the input are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, join_on, store, text_or_empty

MIN_CHARS = 20
MIN_DOCS = 3


def _ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, other letters as they are (``lower`` is the same on pure ASCII and much faster)."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(
        F.translate(col, string.ascii_uppercase, string.ascii_lowercase))


def line_key(line: Column) -> Column:
    """The line with white space stripped at both ends and A-Z lower-cased."""
    return _ascii_lower(F.btrim(line, F.lit(WHITE)))


def _hashes(line: Column, min_chars: int) -> Column:
    """Two 64-bit hashes of different seeds (128 bits together); null for a key that is too short."""
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.struct(
        F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))


def _text_tag(text: Column) -> Column:
    """Tells apart different texts under one doc_id, whose line positions differ."""
    return F.xxhash64(text)


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _tag, _drop``: the sorted 0-based positions of the dropped lines of each text that has any."""
    text = text_or_empty(text_col)
    keyed = docs.select(
        F.col(id_col).alias("_id"), _text_tag(text).alias("_tag"),
        F.posexplode(F.transform(F.split(text, "\n", -1), lambda x: _hashes(x, min_chars))).alias("_pos", "_h"),
    ).filter(F.col("_h").isNotNull())
    lines = store(keyed.select("_id", "_tag", "_pos", F.col("_h.h1").alias("_h1"), F.col("_h.h2").alias("_h2")),
                  "lines")
    frequent = store(
        lines.select("_h1", "_h2", "_id").distinct()
        .groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_docs"), F.max("_id").alias("_last"))
        .filter(F.col("_docs") >= min_docs).select("_h1", "_h2", "_last"), "frequent-lines")
    return (lines.join(frequent, ["_h1", "_h2"])
            .filter(~F.col("_id").eqNullSafe(F.col("_last")))
            .groupBy("_id", "_tag").agg(F.sort_array(F.collect_set("_pos")).alias("_drop")))


def _without(lines: Column, drop: Column) -> Column:
    """``lines`` without the sorted positions ``drop``: the slices between them, in time linear in both."""
    ends = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines)))
    return F.flatten(F.transform(
        F.sequence(F.lit(1), F.size(ends) - 1),
        lambda j: F.slice(lines, ends[j - 1] + 2, ends[j] - ends[j - 1] - 1)))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text`` without its repeated lines, and ``n_lines`` (before) and ``n_dropped``.

    A key of at least ``min_chars`` code points found in at least ``min_docs``
    documents loses all its lines except those of the largest id that holds it.
    """
    own = {"_id": "_line_dedup_id", "_tag": "_line_dedup_tag", "_drop": "_line_dedup_drop"}  # beside the input's columns
    drops = dropped_positions(docs, min_chars, min_docs, id_col, text_col).withColumnsRenamed(own)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    left = docs.select(*names).withColumns({own["_id"]: F.col(id_col), own["_tag"]: _text_tag(text_or_empty(text_col))})
    lines = F.split(text_or_empty(text_col), "\n", -1)
    joined = join_on(left, drops, [own["_id"], own["_tag"]], "left")
    drop = F.col(own["_drop"])
    kept = F.when(drop.isNull(), text_or_empty(text_col)).otherwise(F.array_join(_without(lines, drop), "\n"))
    out = [kept.alias(c) if c == text_col else F.col(c) for c in names]
    return joined.select(*out, F.size(lines).cast("long").alias("n_lines"),
                         F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"))
