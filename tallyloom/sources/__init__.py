"""Where tables come from: files, JDBC systems, frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..model import Model
from ..refusal import Refusal
from . import files


class Sources:
    """Named sources, each a folder or a function from a table's name to a DataFrame."""

    def __init__(self, spark: SparkSession, places: dict[str, str | Callable[[str], DataFrame]]):
        self.spark, self.places = spark, places

    def frame(self, model: Model) -> DataFrame:
        place = self.places.get(model.source)
        if place is None:
            raise Refusal("source_unavailable", model.source)
        df = place(model.table) if callable(place) else files.attached(self.spark, place, model.table, model.columns)
        missing = [c for c in model.columns if c not in df.columns]
        if missing:
            raise Refusal("missing_table", f"{model.table}: no columns {missing}")
        return df.select(*model.columns)
