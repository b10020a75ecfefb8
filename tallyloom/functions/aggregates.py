"""The closed set of aggregates, whole and split into parts that can be summed again above a join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Measure, Term
from ..refusal import Refusal


def exact(column: Column, kind: T.DataType) -> Column:
    """A column that sums without overflow: integers as decimals; decimals keep their scale with room for the sum."""
    if isinstance(kind, T.IntegralType):
        return column.cast("decimal(28,0)")
    if isinstance(kind, T.DecimalType):
        return column.cast(T.DecimalType(max(28, kind.precision), kind.scale)) if kind.precision < 28 else column
    if isinstance(kind, T.DoubleType):
        return column
    raise Refusal("non_numeric_leaf", f"sum of {kind.simpleString()}")


def term(t: Term, column: Column, kind: T.DataType, guard: Column | None = None) -> Column:
    """One aggregate; rows outside `guard` do not take part. avg averages doubles; count_if counts true as a sum, so that
    it is null over no rows."""
    if t.aggregate == "count_if":
        hit = column.eqNullSafe(F.lit(True))
        counted = F.when(hit, 1).otherwise(0)
        return F.sum(counted if guard is None else F.when(guard, counted))
    value = column if guard is None else F.when(guard, column)
    if t.aggregate == "sum":
        return F.sum(exact(value, kind))
    if t.aggregate == "avg":
        return F.avg(value.cast("double"))
    return {"count": F.count, "count_distinct": F.countDistinct, "min": F.min, "max": F.max}[t.aggregate](value)


def divided(measure: Measure, numerator: Column, denominator: Column) -> Column:
    """The ratio of finished terms; under ANSI a zero denominator that is not made null fails the query."""
    below = denominator if measure.zero == "fails" else F.nullif(denominator, F.lit(0))
    return numerator.cast("double") / below


def finite(column: Column, kind: T.DataType) -> Column:
    """Refuses NaN and infinities, in a column that the answer needs."""
    if not isinstance(kind, T.FractionalType) or isinstance(kind, T.DecimalType):
        return column
    bad = F.isnan(column) | (F.abs(column) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("non_finite: a measure is not a finite number")).cast("double")).otherwise(column)


class Parts:
    """A term as partial aggregates of a leg and the aggregate above that finishes them."""

    def __init__(self, t: Term, name: str):
        self.t, self.name = t, name

    def below(self, column: Column, kind: T.DataType) -> dict[str, Column]:
        """Empty for count_distinct, whose column becomes a grouping key of the leg instead."""
        t, n = self.t, self.name
        if t.aggregate == "count_distinct":
            return {}
        if t.aggregate == "avg":
            return {f"{n}_s": F.sum(column.cast("double")), f"{n}_c": F.count(column)}
        return {f"{n}_p": term(t, column, kind)}

    def key(self, column: Column, kind: T.DataType) -> dict[str, Column]:
        if self.t.aggregate != "count_distinct":
            return {}
        return {f"{self.name}_d": column + F.lit(0.0) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else column}

    def above(self) -> Column:
        n, a = self.name, self.t.aggregate
        if a == "count_distinct":
            return F.countDistinct(f"{n}_d")
        if a == "avg":
            return F.sum(f"{n}_s") / F.nullif(F.sum(f"{n}_c"), F.lit(0))
        return {"min": F.min, "max": F.max}.get(a, F.sum)(f"{n}_p")
