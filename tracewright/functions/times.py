"""Time columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truncated(df: DataFrame, ts: str, unit: str) -> Column:
    """The start of the hour, day or such of a timestamp, of the column's own type."""
    return F.date_trunc(unit, ts).cast(dict(df.dtypes)[ts])


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))
