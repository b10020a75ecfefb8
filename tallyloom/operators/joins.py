"""Joins from a fact to its dimensions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import bucket
from ..model import Catalog, Relationship
from ..refusal import Refusal


def kind(t: T.DataType) -> str:
    """The kind of a link's key; keys of different kinds are never compared, and floats never are keys."""
    if isinstance(t, T.IntegralType):
        return "exact_integer"
    if isinstance(t, T.DecimalType):
        return "exact_decimal"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(t, T.BooleanType):
        return "boolean"
    raise Refusal("float_link_key" if isinstance(t, T.FractionalType) else "link_kinds_not_joined", t.simpleString())


def alarm(code: str, detail: str) -> Column:
    """Fails the answer where it is computed; the engine reads the code again from the error."""
    return F.raise_error(F.lit(f"{code}: {detail}"))


def compared(column: Column, t: T.DataType, other: T.DataType, compare_as: str | None) -> tuple[Column, str]:
    """The origin's key as it is compared, and its kind; a declared comparison casts text to integer or integer to
    decimal, and a value that does not cast fails the answer rather than become null."""
    own = kind(t)
    if compare_as == "exact_integer" and own == "text":
        cast, own = column.try_cast("bigint"), "exact_integer"
    elif compare_as == "exact_decimal" and own == "exact_integer":
        to = T.DecimalType(38, other.scale if isinstance(other, T.DecimalType) else 0)
        cast, own = column.try_cast(to), "exact_decimal"
    else:
        return column, own
    failed = alarm("link_value_not_cast", "a link's value is no number of the declared kind").cast(T.LongType() if own == "exact_integer" else to)
    return F.when(column.isNotNull() & cast.isNull(), failed).otherwise(cast), own


def on(relationship: Relationship, left: Callable[[str], Column], right: Callable[[str], Column], left_type: Callable[[str], T.DataType], right_type: Callable[[str], T.DataType]) -> Column:
    """The conjunction of a relationship's keys, after the check of their kinds."""
    terms = []
    for k in relationship.keys:
        column, own = compared(left(k.origin), left_type(k.origin), right_type(k.target), relationship.compare_as)
        if k.grain:
            column, own = bucket(column, k.grain), "date"
        other = kind(right_type(k.target))
        if own != other:
            raise Refusal("link_type_mismatch", f"{relationship.name}: {own} and {other}")
        target = right(k.target)
        terms.append(column == (target.cast("date") if k.grain else target))
    return reduce(lambda a, b: a & b, terms)


class Chain:
    """A fact with its dimension tables, each relationship joined once, rows without a match kept under null. A target with
    several rows for one link, which would repeat the fact's rows, fails the answer with `ambiguous`."""

    def __init__(self, catalog: Catalog, frame: Callable[[str], DataFrame], model: str, ambiguous: str = "ambiguous_link"):
        self.catalog, self.frame, self.base, self.ambiguous = catalog, frame, model, ambiguous
        self.alias = {(): "f"}
        self.types = {(): frame(model).schema}
        self.df = frame(model).alias("f")

    def column(self, via: tuple[str, ...], name: str) -> Column:
        return F.col(f"{self.alias[via]}.`{name}`")

    def type(self, via: tuple[str, ...], name: str) -> T.DataType:
        return self.types[via][name].dataType

    def join(self, via: tuple[str, ...], how: str = "left") -> None:
        """Joins the hops of `via` that are not there yet. The far side is read with its needed columns only (Catalyst
        prunes), cut to one row for each link, and whether it is broadcast is left to Spark's own check of its size. Where
        it is not, the join uses the exchange that the cut has made."""
        for i in range(1, len(via) + 1):
            here, before = via[:i], via[: i - 1]
            if here in self.alias:
                continue
            r = self.catalog.relationships[here[-1]]
            alias = f"d{len(self.alias)}"
            target = self.frame(r.target)
            links = {k.target: f"_link{n}" for n, k in enumerate(r.keys)}
            at = [(F.col(k.target).cast("date") if k.grain else F.col(k.target)).alias(links[k.target]) for k in r.keys]
            one = unique_lookup(target.select(*at, *target.columns), list(links.values()), target.columns, self.ambiguous)
            condition = on(r, lambda c, b=before: self.column(b, c), lambda c, a=alias, names=links: F.col(f"{a}.`{names[c]}`"), lambda c, b=before: self.type(b, c), lambda c, t=target: t.schema[c].dataType)
            self.df = self.df.join(one.alias(alias), condition, how)
            self.alias[here], self.types[here] = alias, target.schema


def unique_lookup(lookup: DataFrame, links: list[str], columns: list[str], code: str = "ambiguous_link") -> DataFrame:
    """One row for each link, by one aggregate. Rows that agree in a column are one; a link whose rows differ in a column that
    the answer uses fails the answer, inside that column, so that no optimisation drops the check, and columns that it
    does not use are neither read nor compared. Null links match nothing and go."""
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in links))
    low, high, many = ({c: f"_{k}{n}" for n, c in enumerate(columns)} for k in ("low", "high", "many"))
    aggregates = [x for c in columns for x in (_lowest(lookup, c).alias(low[c]), _lowest(lookup, c, F.max).alias(high[c]), F.count(c).alias(many[c]))]
    one = lookup.filter(known).groupBy(*links).agg(F.count("*").alias("_n"), *aggregates)

    def agreed(c: str) -> Column:
        differ = (F.col(many[c]) > 0) & (F.col(many[c]) < F.col("_n"))
        differ = differ | (F.col("_n") > 1 if _unordered(lookup, c) else F.col(low[c]) != F.col(high[c]))
        return F.when(differ, alarm(code, "a lookup has several rows for one link").cast(lookup.schema[c].dataType)).otherwise(F.col(low[c])).alias(c)

    return one.select(*links, *map(agreed, columns))


def _unordered(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.MapType, T.VariantType))


def _lowest(df: DataFrame, column: str, other: Callable = F.min) -> Column:
    return F.any_value(column) if _unordered(df, column) else other(column)
