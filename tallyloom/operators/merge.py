"""Merging answers of several facts on all their keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..refusal import Refusal
from .joins import kind


def _same_kinds(a: DataFrame, b: DataFrame, keys: list[str], period: str) -> None:
    for k in keys:
        x, y = a.schema[k].dataType, b.schema[k].dataType
        if x != y and kind(x) != kind(y):
            raise Refusal("bucket_kind_mismatch" if k == period else "key_kind_mismatch", k)


def full_merge(arms: list[DataFrame], keys: list[str], period: str = "period", absent: dict[str, object] | None = None) -> DataFrame:
    """A full join of the arms on every key, where null equals null; a key comes from the first arm that has it. What an
    arm has no row for is null, or the value that `absent` names for the column."""

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        _same_kinds(a, b, keys, period)
        left, right = a.withColumn("_l", F.lit(True)).alias("l"), b.withColumn("_r", F.lit(True)).alias("r")
        same = reduce(lambda x, y: x & y, (F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys))
        own = lambda side, mark, c: F.when(F.col(f"{side}.{mark}").isNull(), F.lit(absent[c])).otherwise(F.col(f"{side}.`{c}`")).alias(c) if absent and c in absent else F.col(f"{side}.`{c}`")
        measures = [own("l", "_l", c) for c in a.columns if c not in keys] + [own("r", "_r", c) for c in b.columns if c not in keys]
        return left.join(right, same, "full").select(*(F.coalesce(f"l.`{k}`", f"r.`{k}`").alias(k) for k in keys), *measures)

    return reduce(two, arms)


def stacked(arms: list[DataFrame], keys: list[str]) -> DataFrame:
    """The arms, each with its own measures, one above the other, and the maximum of each measure for every key: one
    exchange of finished rows instead of a join for each further arm."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), arms)
    for k in keys:
        for arm in arms[1:]:
            _same_kinds(arms[0], arm, [k], "period")
    return whole.groupBy(*keys).agg(*(F.max(c).alias(c) for arm in arms for c in arm.columns if c not in keys))
