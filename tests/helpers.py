import math

import pandas as pd

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canon(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    rows = [tuple(norm(x) for x in rec) for rec in pdf[cols].itertuples(index=False)]
    return cols, sorted(rows, key=repr)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
