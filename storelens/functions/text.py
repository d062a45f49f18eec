"""String, set and JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def join_items(items: str | Column, sep: str = ", ") -> Column:
    """A set of names as one sorted, comma-joined string."""
    return F.array_join(F.array_sort(_c(items)), sep)


def fixed2(x: str | Column) -> Column:
    """Two-decimal text."""
    return F.format_string("%.2f", _c(x))


def capitalize_word(s: str | Column) -> Column:
    """First character upper case, the rest lower case."""
    s = _c(s)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


# The shape of a report response and its fallback record.
REPORT_SCHEMA = T.StructType([
    T.StructField("store_performance_rating", T.StringType()),
    T.StructField("key_insights", T.ArrayType(T.StringType())),
    T.StructField("recommendations", T.ArrayType(T.StringType())),
    T.StructField("challenges", T.ArrayType(T.StringType())),
])
FALLBACK_RATING = "unknown"
FALLBACK_INSIGHTS = ["Error occurred while processing data"]
FALLBACK_CHALLENGES = ["Unable to analyze due to processing error."]


def strip_ws(text: str | Column) -> Column:
    """Trim all whitespace (Spark's ``trim`` removes spaces only)."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def strip_fence(text: str | Column) -> Column:
    """Trim whitespace, then strip the characters ` j s o n from both ends (a character set)."""
    return F.regexp_replace(strip_ws(text), r"^[`json]+|[`json]+$", "")


def parse_report(text: str | Column) -> Column:
    """Parse a response into the report struct, or the fallback record when it is not JSON."""
    cleaned = strip_fence(text)
    parsed = F.from_json(cleaned, REPORT_SCHEMA, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json(cleaned).isNotNull() & F.startswith(strip_ws(cleaned), F.lit("{"))
    fallback = F.struct(
        F.lit(FALLBACK_RATING).alias("store_performance_rating"),
        F.array(*[F.lit(x) for x in FALLBACK_INSIGHTS]).alias("key_insights"),
        F.array().cast("array<string>").alias("recommendations"),
        F.array(*[F.lit(x) for x in FALLBACK_CHALLENGES]).alias("challenges"),
    )
    return F.when(valid, parsed).otherwise(fallback)


def strip_prefix(s: str | Column, prefix: str) -> Column:
    """The text after ``prefix`` when it starts with it, else NULL."""
    s = _c(s)
    return F.when(F.startswith(s, F.lit(prefix)), F.substring(s, len(prefix) + 1, 1 << 30))
