"""Rows as sorted, comparable texts."""

import pandas as pd


def cell(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([cell(x) for x in v])
    if v is None or pd.isna(v):
        return None
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def whole(column):
    """A column of whole numbers and gaps, which pandas may hold as floats, as whole numbers."""
    known = column.dropna()
    if len(known) < len(column) and column.dtype == float and (known % 1 == 0).all():
        return column.astype("Int64")
    return column


def rows(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].apply(whole)
    return cols, sorted((tuple(cell(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=str)
