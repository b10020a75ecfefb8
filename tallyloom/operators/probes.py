"""Checks before serving: promised keys, tables, certified numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..refusal import Refusal


def key_probe(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_keys and n_distinct over rows whose key columns are all set; the key is unique if they agree."""
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return df.agg(F.count(F.when(whole, 1)).alias("n_keys"), F.countDistinct(*keys).alias("n_distinct"))


def require_unique(df: DataFrame, keys: list[str], name: str) -> None:
    row = key_probe(df, keys).first()
    if row["n_keys"] != row["n_distinct"]:
        raise Refusal("declared_key_not_unique", f"{name}: {keys}")


def size_in_bytes(df: DataFrame) -> int:
    """Spark's estimate of what a plan reads, before it runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
