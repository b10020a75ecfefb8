"""Metrics over streams: the calendar bucket of a question as a watermarked window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates
from ..model import Measure
from ..refusal import Refusal

_LENGTHS = {"day": "1 day", "week": "7 days"}


def rolled_up(stream: DataFrame, time_column: str, grain: str, measures: dict[str, Measure], keys: tuple[str, ...] = (), late: str = "1 day") -> DataFrame:
    """keys, period and measures of a stream of facts, by day or week. Facts later than `late` are dropped by the
    watermark, state is bounded by it, and exact distinct counts, which have no bounded state, are refused."""
    if grain not in _LENGTHS:
        raise Refusal("grain_not_supported", grain)
    if any(t.aggregate == "count_distinct" for m in measures.values() for t in m.terms):
        raise Refusal("federation_not_executable", "count_distinct of a stream")
    offset = "4 days" if grain == "week" else None  # 1970-01-05 was a Monday
    window = F.window(F.col(time_column), _LENGTHS[grain], _LENGTHS[grain], offset) if offset else F.window(F.col(time_column), _LENGTHS[grain])
    finished = []
    for name, m in measures.items():
        terms = [aggregates.term(t, F.col(t.column), stream.schema[t.column].dataType) for t in m.terms]
        finished.append((terms[0] if len(terms) == 1 else aggregates.divided(m, *terms)).alias(name))
    out = stream.withWatermark(time_column, late).groupBy(*keys, window.alias("_w")).agg(*finished)
    return out.select(*keys, F.col("_w.start").cast("date").alias("period"), *measures)
