"""Helpers for registered query outputs: flat, typed, comparable columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def r6(c) -> Column:
    """Doubles in query outputs are rounded to 6 decimals (float sums are order dependent)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6)


def ts_text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(c.cast("string"), 1, 19)  # a zone-free timestamp stays as it is


def flat(df: DataFrame) -> DataFrame:
    """Round every double to 6 decimals and render timestamps as text."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(r6(f.name).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(ts_text(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
