"""Calendar and flag columns.

All are native Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Temperature bins are right-closed, (-10,10] (10,20] (20,30] (30,40].
TEMPERATURE_BINS = [(-10.0, 10.0, "Cold"), (10.0, 20.0, "Mild"), (20.0, 30.0, "Warm"), (30.0, 40.0, "Hot")]
TEMPERATURE_LABELS = [label for _, _, label in TEMPERATURE_BINS]

# Calendar month names in calendar order.
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December"]


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def day_name(d: str | Column) -> Column:
    """H1: Monday ... Sunday."""
    return F.date_format(_c(d), "EEEE")


def day_number(d: str | Column) -> Column:
    """H2: Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(d)).cast("int")


def iso_week(d: str | Column) -> Column:
    """H3: ISO-8601 week number."""
    return F.weekofyear(_c(d)).cast("int")


def month_name(d: str | Column) -> Column:
    """H5."""
    return F.date_format(_c(d), "MMMM")


def month_period(d: str | Column) -> Column:
    """H6: ``YYYY-MM``."""
    return F.date_format(_c(d), "yyyy-MM")


def week_of_month(d: str | Column) -> Column:
    """H7: (day - 1) // 7 + 1."""
    return (F.floor((F.dayofmonth(_c(d)) - 1) / 7) + 1).cast("int")


def weekend_flag(d: str | Column) -> Column:
    """H8: 1 on Saturday and Sunday."""
    return F.when(F.weekday(_c(d)) >= 5, 1).otherwise(0).cast("int")


def holiday_flag(x: str | Column) -> Column:
    """1 only when the value is the text ``Yes``."""
    return F.when(_c(x) == "Yes", 1).otherwise(0).cast("int")


def holiday_number(x: str | Column) -> Column:
    """The holiday column as a model feature: 1 for ``Yes``, true or a number other than 0; 0 for anything else."""
    text = F.lower(_c(x).cast("string"))
    return F.when(text.isin("yes", "true"), 1).otherwise(
        F.when(F.coalesce(text.try_cast("double"), F.lit(0.0)) != 0, 1).otherwise(0)).cast("int")


def temperature_bin(t: str | Column) -> Column:
    """H9: right-closed bins; anything outside (-10, 40] is NULL."""
    t = _c(t)
    expr = None
    for low, high, label in TEMPERATURE_BINS:
        cond = (t > low) & (t <= high)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def season_of(d: str | Column) -> Column:
    """Meteorological season of a date: 12-2 Winter, 3-5 Spring, 6-8 Summer, 9-11 Fall."""
    m = F.month(_c(d))
    return (F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring")
            .when(m.isin(6, 7, 8), "Summer").otherwise("Fall"))


def with_calendar(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Adds every calendar column the analyses group by, in one projection."""
    d = F.col(date_col)
    return df.withColumns({
        "day_of_week": day_name(d),
        "day_number": day_number(d),
        "iso_week": iso_week(d),
        "year": F.year(d).cast("int"),
        "month": F.month(d).cast("int"),
        "day": F.dayofmonth(d).cast("int"),
        "week_of_month": week_of_month(d),
        "month_name": month_name(d),
        "month_period": month_period(d),
        "is_weekend": weekend_flag(d),
    })
