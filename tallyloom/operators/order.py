"""Order and top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Top


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """By all keys, ascending, nulls last; all rows."""
    return df.orderBy(*(F.asc_nulls_last(k) for k in keys))


def topped(df: DataFrame, keys: list[str], period: str, measure: str, top: Top) -> DataFrame:
    """The first n by the measure or the period, nulls last in both directions; ties by the keys in order."""
    first = measure if top.by == "metric" else period
    lead = F.desc_nulls_last(first) if top.direction == "desc" else F.asc_nulls_last(first)
    return df.orderBy(lead, *(F.asc_nulls_last(k) for k in keys if k != first)).limit(top.n)
