"""The retail sales table: fixed schema, display names, column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The display names used by the retail CSV files, mapped to our column names.
DISPLAY_NAMES = {
    "Transaction ID": "transaction_id",
    "Date": "date",
    "Product Name": "product_name",
    "Quantity Sold": "quantity_sold",
    "Sales Price per Unit ($)": "unit_price",
    "Discount (%)": "discount_pct",
    "Stock After Sale": "stock_after_sale",
    "Returned": "returned",
    "Weather Condition": "weather",
    "Temperature (°C)": "temperature_c",
    "Humidity (%)": "humidity_pct",
    "Precipitation (mm)": "precipitation_mm",
    "Wind Speed (km/h)": "wind_speed_kmh",
    "Is Holiday": "is_holiday",
    "Is Weekend": "is_weekend",
    "Is Special Event": "is_special_event",
    "Season": "season",
    "Category": "category",
    "Total Sales ($)": "total_sales",
    "Total Sales After Discount ($)": "total_after_discount",
    "Net Sales Value ($)": "net_sales",
    "Sales_Lag_1": "sales_lag_1",
    "Sales_Lag_7": "sales_lag_7",
    "Sales_Lag_14": "sales_lag_14",
    "Future_7_Day_Sales": "future_7_day_sales",
    "Month": "month_period",
    "Monthly Sales": "monthly_sales",
}
COLUMN_TO_DISPLAY = {v: k for k, v in DISPLAY_NAMES.items()}

SALES_TYPES: dict[str, T.DataType] = {
    "transaction_id": T.StringType(),
    "date": T.DateType(),
    "product_name": T.StringType(),
    "quantity_sold": T.LongType(),
    "unit_price": T.DoubleType(),
    "discount_pct": T.DoubleType(),
    "stock_after_sale": T.LongType(),
    "returned": T.IntegerType(),
    "weather": T.StringType(),
    "temperature_c": T.DoubleType(),
    "humidity_pct": T.IntegerType(),
    "precipitation_mm": T.DoubleType(),
    "wind_speed_kmh": T.DoubleType(),
    "is_holiday": T.StringType(),
    "is_weekend": T.IntegerType(),
    "is_special_event": T.IntegerType(),
    "season": T.StringType(),
    "category": T.StringType(),
    "total_sales": T.DoubleType(),
    "total_after_discount": T.DoubleType(),
    "net_sales": T.DoubleType(),
    # Shifted columns are fractional in the files ("5.0").
    "sales_lag_1": T.DoubleType(),
    "sales_lag_7": T.DoubleType(),
    "sales_lag_14": T.DoubleType(),
    "future_7_day_sales": T.DoubleType(),
    "month_period": T.StringType(),
    "monthly_sales": T.LongType(),
}
SALES_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in SALES_TYPES.items()])

# Fixed value: the message callers match on.
MISSING_COLUMNS = "Missing required columns: "

# Columns the analysis entry point needs (API analysis, in display order).
ANALYSIS_REQUIRED = ["date", "total_sales", "product_name", "weather", "is_holiday", "season", "category"]


def require_columns(df: DataFrame, cols: Iterable[str]) -> None:
    """A2: raise listing every missing column, comma-joined.  Schema only, no job."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(MISSING_COLUMNS + ", ".join(missing))


def columns_of_type(df: DataFrame, kind: str = "numeric") -> list[str]:
    """Column names by type family: ``numeric``, ``string``, ``date`` or ``boolean``."""
    fam = {
        "numeric": (T.NumericType,),
        "string": (T.StringType,),
        "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
        "boolean": (T.BooleanType,),
    }[kind]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, fam)]


def align_features(df: DataFrame, names: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """Exactly ``names`` in that order; missing columns are 0, extra ones dropped.

    ``keep`` columns (keys, labels) are carried in front untouched.
    """
    present = set(df.columns)
    cols = [F.col(k) for k in keep]
    cols += [(F.col(n) if n in present else F.lit(0)).cast("double").alias(n) for n in names]
    return df.select(*cols)


def to_display(df: DataFrame) -> DataFrame:
    """Rename our columns back to the display names (for CSV output)."""
    return df.select(*[F.col(c).alias(COLUMN_TO_DISPLAY.get(c, c)) for c in df.columns])


def from_display(df: DataFrame) -> DataFrame:
    """Rename display-name columns to our names; unknown columns keep their names."""
    return df.select(*[F.col(f"`{c}`").alias(DISPLAY_NAMES.get(c, c)) for c in df.columns])
