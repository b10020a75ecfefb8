"""Reads of a database table in parts that together hold every row once."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession

#: Rows that one stream may carry.
STREAM_ROWS = 1_000_000


def hash_buckets(keys: list[str], parts: int) -> list[str]:
    """Predicates over integer keys; a null counts as 0."""
    total = " + ".join(f'MOD(COALESCE("{k}", 0), {parts})' for k in keys)
    return [f"MOD(MOD({total}, {parts}) + {parts}, {parts}) = {i}" for i in range(parts)]


def page_ranges(pages: int, parts: int) -> list[str]:
    """Predicates over a Postgres table's physical pages; the last one is open."""
    step = max(1, ceil(pages / parts))
    cuts = list(range(0, pages, step)) or [0]
    return [f"ctid >= '({a},0)'::tid" + (f" AND ctid < '({a + step},0)'::tid" if a != cuts[-1] else "") for a in cuts]


def parts_of(rows: int, most: int = STREAM_ROWS) -> int:
    return max(1, ceil(rows / most))


def read(spark: SparkSession, url: str, table: str, predicates: list[str] | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    """One task for each predicate; Spark pushes filters, columns and limits down into each."""
    props = {"fetchsize": "10000"} | (properties or {})
    return spark.read.jdbc(url, table, predicates=predicates, properties=props) if predicates else spark.read.jdbc(url, table, properties=props)
