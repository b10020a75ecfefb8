"""The definitions that a catalog holds, and the question that a caller asks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date

from .refusal import Refusal

GRAINS = ("day", "week", "month", "quarter", "year")
AGGREGATES = ("sum", "count", "count_distinct", "avg", "min", "max", "count_if")
CARDINALITIES = ("one_to_one", "many_to_one", "one_to_many")
FILTERS = ("equals", "not_equals", "in", "not_in")


def identifier(name: object) -> str:
    """`[A-Za-z_][A-Za-z0-9_]*`, 63 characters at most; its case is kept."""
    if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,62}", name):
        raise Refusal("invalid_definition", f"not an identifier: {name!r}")
    return name


@dataclass(frozen=True)
class TextPolicy:
    """Redactions (pattern, replacement) in order, and the most bytes that a text may show."""

    redactions: tuple[tuple[str, str], ...] = ()
    clip_bytes: int | None = None


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "VARCHAR"
    description: str = ""
    nullable: bool = True
    policy: TextPolicy | None = None


@dataclass(frozen=True)
class Model:
    name: str
    source: str
    table: str
    columns: dict[str, Column]
    primary_key: tuple[str, ...] = ()
    audience: str = "open"


@dataclass(frozen=True)
class Key:
    """origin = target, or the origin cut to the first day of its grain = target."""

    origin: str
    target: str
    grain: str | None = None


@dataclass(frozen=True)
class Relationship:
    """compare_as: exact_integer (from text) or exact_decimal (from integers), for a link between two sources."""

    name: str
    origin: str
    target: str
    keys: tuple[Key, ...]
    join_type: str = "many_to_one"
    compare_as: str | None = None


@dataclass(frozen=True)
class Dimension:
    """A column of the metric's model, or of the last model on the chain of relationships `via`. Only a dimension with
    declared values can be filtered on. `second` is the chain from the other fact of a ratio over two models."""

    name: str
    column: str
    via: tuple[str, ...] = ()
    values: tuple[str, ...] | None = None
    description: str = ""
    second: tuple[str, ...] = ()


@dataclass(frozen=True)
class Term:
    aggregate: str
    column: str
    model: str | None = None


@dataclass(frozen=True)
class Measure:
    """A term, or the ratio of two; zero: `yields_null` or `fails` on a zero denominator."""

    numerator: Term
    denominator: Term | None = None
    zero: str = "yields_null"

    @property
    def terms(self) -> tuple[Term, ...]:
        return (self.numerator,) if self.denominator is None else (self.numerator, self.denominator)


@dataclass(frozen=True)
class Required:
    """A filter of the definition: equals, not_equals, is_true or is_not_null."""

    op: str
    column: str
    value: object = None


@dataclass(frozen=True)
class Metric:
    """`expression`: an authored SQL aggregate instead of a measure. `calendars`: for a ratio over two models, the
    relationship from each model to the calendar that both share; `time_column` is then the calendar's."""

    name: str
    model: str
    time_column: str
    grains: tuple[str, ...]
    measure: Measure | None = None
    expression: str | None = None
    required: tuple[Required, ...] = ()
    dimensions: dict[str, Dimension] = field(default_factory=dict)
    anchor: tuple[date, date, str] | None = None
    audience: str = "open"
    calendars: dict[str, str] = field(default_factory=dict)
    description: str = ""

    @property
    def second_model(self) -> str | None:
        others = {t.model for t in (self.measure.terms if self.measure else ()) if t.model and t.model != self.model}
        return next(iter(others), None)


@dataclass(frozen=True)
class Note:
    """Knowledge about definitions: glossary, caveat, not_defined or example."""

    kind: str
    name: str
    about: tuple[str, ...]
    text: str


@dataclass(frozen=True)
class Catalog:
    models: dict[str, Model]
    relationships: dict[str, Relationship]
    metrics: dict[str, Metric]
    notes: tuple[Note, ...] = ()


@dataclass(frozen=True)
class Filter:
    dimension: str
    op: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Top:
    n: int
    by: str = "metric"
    direction: str = "desc"


@dataclass(frozen=True)
class Question:
    """Metrics at a grain over [start, end), by dimensions, narrowed by filters, perhaps only the top."""

    metrics: tuple[str, ...]
    grain: str
    start: date
    end: date
    dimensions: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    top: Top | None = None


@dataclass(frozen=True)
class Limits:
    """How much one question may ask for."""

    dimensions: int = 4
    metrics: int = 8
    filters: int = 8
    days: int = 3653
    rows: int = 10_000
    values: int = 64
    lookups: int = 3
    sources: int = 4
    legs: int = 6
    seconds: float = 30.0
    answer_bytes: int = 8 << 20
    scan_bytes: int | None = None


def question(raw: dict, today: date | None = None) -> Question:
    """Reads a caller's question; unknown fields are refused. `range` has start and end, or last {count, unit,
    include_current}, which is resolved from `today`."""
    from .functions.calendar import relative_range

    def strict(x: dict, allowed: set[str], what: str) -> dict:
        if not isinstance(x, dict) or set(x) - allowed:
            raise Refusal("invalid_definition", f"{what}: unknown fields {sorted(set(x) - allowed) if isinstance(x, dict) else x!r}")
        return x

    def day(x: object) -> date:
        try:
            return x if isinstance(x, date) else date.fromisoformat(str(x))
        except ValueError:
            raise Refusal("invalid_definition", f"not a date: {x!r}") from None

    strict(raw, {"metrics", "grain", "range", "dimensions", "filters", "top"}, "question")
    span = strict(raw.get("range") or {}, {"start", "end", "last"}, "range")
    if ("last" in span) == ("start" in span or "end" in span):
        raise Refusal("invalid_definition", "range: start and end, or last")
    if "last" in span:
        last = strict(span["last"], {"count", "unit", "include_current"}, "last")
        start, end = relative_range(today or date.today(), int(last["count"]), last["unit"], bool(last.get("include_current", False)))
    else:
        start, end = day(span.get("start")), day(span.get("end"))
    if start >= end:
        raise Refusal("invalid_definition", "range: empty")
    filters = []
    for f in raw.get("filters") or ():
        strict(f, {"op", "dimension", "value", "values"}, "filter")
        values = tuple(f["values"]) if "values" in f else (f.get("value"),)
        op = f.get("op", "equals")
        if op not in FILTERS or not values or (len(values) > 1 and op in FILTERS[:2]):
            raise Refusal("invalid_definition", f"filter: {op}")
        filters.append(Filter(f["dimension"], op, values))
    top = raw.get("top")
    if top is not None:
        strict(top, {"n", "by", "direction"}, "top")
        top = Top(int(top["n"]), top.get("by", "metric"), top.get("direction", "desc"))
        if top.n < 1 or top.by not in ("metric", "period") or top.direction not in ("asc", "desc"):
            raise Refusal("invalid_definition", "top")
    metrics = tuple(raw.get("metrics") or ())
    if not metrics or raw.get("grain") not in GRAINS:
        raise Refusal("invalid_definition", "a question needs metrics and a grain")
    return Question(metrics, raw["grain"], start, end, tuple(raw.get("dimensions") or ()), tuple(filters), top)
