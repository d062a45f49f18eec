"""Reading, writing and cleaning the sales table.

CSV files are read in one pass with every column as text (no schema-inference
pass over the data), then cast to the fixed schema: strictly (ANSI cast, a bad
value fails the job) or leniently (``try_cast``, a bad value becomes NULL).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import SALES_TYPES, from_display, to_display


INVALID_DATE = "Invalid date found in data"  # fixed value: the message callers match on


def _typed(df: DataFrame, strict: bool) -> DataFrame:
    cols = []
    for name in df.columns:
        want = SALES_TYPES.get(name)
        c = F.col(name)
        if want is None or isinstance(want, T.StringType):
            cols.append(c)
        elif isinstance(want, T.DateType):
            cols.append(parse_date(c, strict).alias(name))
        elif strict:
            cols.append(c.cast(want).alias(name))
        else:
            cols.append(c.try_cast(want).alias(name))
    return df.select(*cols)


def read_sales(spark: SparkSession, path: str, fmt: str = "csv", strict: bool = True) -> DataFrame:
    """A1: load a sales table written with display names (CSV) or our names (parquet)."""
    if fmt == "csv":
        raw = (spark.read.option("header", True).option("inferSchema", False)
               .option("mode", "FAILFAST").csv(path))
        return _typed(from_display(raw), strict)
    if fmt == "parquet":
        return from_display(spark.read.parquet(path))
    raise ValueError(f"unsupported format: {fmt}")


def write_sales(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A3: header CSV with display names, no index column."""
    to_display(df).write.mode(mode).option("header", True).csv(path)


def to_records(df: DataFrame) -> DataFrame:
    """A5: one JSON object per row, as a single ``json`` column."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("json"))


def preview(df: DataFrame, order_cols: Iterable[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows in the order of ``order_cols`` (a top-n, no full sort)."""
    return df.orderBy(*order_cols).limit(n)


def csv_text(df: DataFrame) -> DataFrame:
    """A3 without a folder: one CSV line per row under the display names, as a ``line`` column."""
    shown = to_display(df)
    return shown.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in shown.columns])).alias("line"))


def from_csv_text(lines: DataFrame, columns: Iterable[str], strict: bool = True) -> DataFrame:
    """A1 without a folder: parse CSV lines with every column as text, then type them as ``read_sales`` does."""
    names = list(columns)
    text = T.StructType([T.StructField(c, T.StringType()) for c in names])
    schema = ", ".join(f"`{f.name}` STRING" for f in text.fields)
    return _typed(lines.select(F.from_csv("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*"), strict)


def parse_date(c: str | Column, strict: bool = False) -> Column:
    """Text to date.  Strict raises on a bad value; lenient gives NULL."""
    c = F.col(c) if isinstance(c, str) else c
    if strict:
        return F.to_timestamp(c).cast("date")
    return F.try_to_timestamp(c).cast("date")


def reject_invalid_dates(df: DataFrame, col: str = "date") -> DataFrame:
    """Fail when any date is missing or unparseable; otherwise return a typed frame.

    The probe is ``filter(...).limit(1)``, so the check stops at the first bad row.
    """
    parsed = df.withColumn(col, parse_date(F.col(col).cast("string"), strict=False))
    if not parsed.filter(F.col(col).isNull()).limit(1).isEmpty():
        raise ValueError(INVALID_DATE)
    return parsed


def clean(df: DataFrame, drop_any: bool = False, subset: Iterable[str] | None = None,
          fill: object | None = None) -> DataFrame:
    """Drop rows with any NULL, or with a NULL in ``subset``; then fill.

    ``fill=0`` fills numeric columns with 0 and text columns with ``'0'``
    (the reference puts the number 0 into text keys, Q16).
    """
    if drop_any:
        df = df.na.drop("any")
    if subset:
        df = df.na.drop(subset=list(subset))
    if fill is not None:
        df = df.na.fill(fill)
        if isinstance(fill, (int, float)):
            df = df.na.fill(str(fill).removesuffix(".0"))
    return df


def fill_label(df: DataFrame, col: str, label: str = "Unknown") -> DataFrame:
    """NULL text becomes a label."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(label)))


def coerce_numeric(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Every listed column to double; a bad value becomes NULL, then 0."""
    names = set(cols) if cols is not None else set(df.columns)
    return df.select(*[
        F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) if c in names else F.col(c)
        for c in df.columns
    ])
