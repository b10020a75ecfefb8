"""Folds and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused


def held_out(doc_id: Column) -> Column:
    """True where the crc32 of the id's digits is 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, by: str, n: int, seed: str) -> DataFrame:
    """Of each value of the column `by` at most `n` rows, all if there are no more: those with the smallest hashes of their
    doc_id (ties by `by`, then by all columns), so the same rows each time. Of a common value only the rows whose hash is
    low enough are sorted. `by` has few values, whose counts reach the driver."""
    counts = {r[by]: r["count"] for r in rows.groupBy(by).count().collect()}
    if not counts:
        return rows
    hashed = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000_000))
    shares = F.create_map(*(F.lit(x) for k, v in counts.items() for x in (k, int(1_000_000_000 * min(1.0, 2.0 * n / v + 100.0 / v)))))
    place, rank = unused(rows, "place"), unused(rows, "rank")
    low = rows.withColumn(place, hashed).filter(F.col(place) <= shares[F.col(by)])
    order = Window.partitionBy(by).orderBy(place, *(F.xxhash64(c) for c in rows.columns))
    return low.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n).drop(place, rank)
