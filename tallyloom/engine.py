"""The engine: describe, ask, sql."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Row, SparkSession

from .catalog import digest
from .model import GRAINS, Catalog, Limits, Question, question
from .operators.probes import require_unique, size_in_bytes
from .plans import statement
from .plans.ask import Planner
from .plans.resolve import Resolved, resolve
from .refusal import ALARMS, Refusal
from .sources import Sources


@dataclass(frozen=True)
class Answer:
    """A lazy DataFrame of all rows with where it comes from; `rows` holds it to the limits."""

    df: DataFrame
    digest: str
    limits: Limits
    too_many: str = "result_too_large"

    def rows(self) -> list[Row]:
        """All rows, or a refusal: an answer is never cut short, and no job of it outlives the deadline."""
        if self.limits.scan_bytes and size_in_bytes(self.df) > self.limits.scan_bytes:
            raise Refusal("budget_exhausted", "the plan reads more than the budget")
        context, tag, late = self.df.sparkSession.sparkContext, f"answer-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(self.limits.seconds, stop)
        timer.daemon = True
        context.addJobTag(tag)
        timer.start()
        try:
            found = self.df.limit(self.limits.rows + 1).collect()
        except Exception as e:
            if late.is_set():
                raise Refusal("deadline_exceeded", f"{self.limits.seconds} seconds") from e
            told = told_by(e)
            if told is None:
                raise
            raise told from e
        finally:
            timer.cancel()
            context.removeJobTag(tag)
        if len(found) > self.limits.rows:
            raise Refusal(self.too_many, f"{self.limits.rows} rows at most")
        if sum(len(str(cell)) for row in found for cell in row) > self.limits.answer_bytes:
            raise Refusal("result_too_large", f"{self.limits.answer_bytes} bytes at most")
        return found


def told_by(error: Exception) -> Refusal | None:
    """The refusal that a failed job stands for: an alarm of a plan, or memory that did not suffice."""
    text = str(error)
    if found := re.search(rf"\b({'|'.join(ALARMS)}): ([^\n]*?)(?= SQLSTATE|\n|$)", text):
        return Refusal(found[1], found[2])
    if re.search(r"OutOfMemory|MAX_RESULT_SIZE|maxResultSize", text):
        return Refusal("resources_exhausted", "the answer needs more memory than there is")
    return None


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog, places: dict, limits: Limits | None = None, audience: str = "open", federated_statements: bool = True):
        self.spark, self.catalog, self.limits, self.audience = spark, catalog, limits or Limits(), audience
        self.federated_statements = federated_statements
        self.sources = Sources(spark, places)
        self.planner = Planner(spark, catalog, self.sources, self.limits)
        self.digest = digest(catalog)

    def resolved(self, asked: Question | dict, today: date | None = None) -> Resolved:
        q = asked if isinstance(asked, Question) else question(asked, today)
        return resolve(self.catalog, q, self.limits, self.audience)

    def ask(self, asked: Question | dict, today: date | None = None) -> Answer:
        """The question's answer as a plan; nothing runs yet but the inference of schemas. Links are held to one row each inside
        the plan, so no probe has to run before."""
        return Answer(self.planner.answer(self.resolved(asked, today)), self.digest, self.limits)

    def sql(self, text: str, models: list[str] | None = None) -> Answer:
        """A read-only statement over the tables of the admitted models (all, unless named)."""
        admitted = {m.table.lower(): m for m in (self.catalog.models[x] for x in (models or self.catalog.models)) if m.audience in ("open", self.audience)}
        used = statement.checked(self.spark, text, set(admitted))
        if not self.federated_statements and len({admitted[t].source for t in used}) > 1:
            raise Refusal("too_many_sources", "a statement reads one source here")
        tables = {admitted[t].table: statement.view(self.sources.frame(admitted[t]), admitted[t]) for t in used}
        return Answer(statement.run(self.spark, text, tables, used), self.digest, self.limits, "too_many_rows")

    def describe(self) -> list[dict]:
        """What may be asked: metrics with their grains, dimensions, values and notes."""
        return [
            {
                "metric": m.name, "grains": list(m.grains), "description": m.description,
                "dimensions": {d.name: list(d.values) if d.values is not None else None for d in m.dimensions.values()},
                "notes": [n.text for n in self.catalog.notes if m.name in n.about],
            }
            for m in self.catalog.metrics.values() if m.audience in ("open", self.audience)
        ]

    def describe_tables(self) -> dict[str, dict[str, str]]:
        """Physical tables and their columns' types, as the sources give them."""
        return {m.table: dict(self.sources.frame(m).dtypes) for m in self.catalog.models.values() if m.audience in ("open", self.audience)}

    def check(self) -> None:
        """What may be held before serving: tables and columns are there, keys are unique, certified numbers come out."""
        self.check_tables()
        self.check_keys()
        self.check_anchors()

    def check_keys(self) -> None:
        """Probes the primary keys that models promise and the keys that relationships aim at; one aggregate each."""
        promised = {(m.name, m.primary_key) for m in self.catalog.models.values() if m.primary_key}
        promised |= {(r.target, tuple(k.target for k in r.keys)) for r in self.catalog.relationships.values()}
        for name, keys in sorted(promised):
            require_unique(self.sources.frame(self.catalog.models[name]), list(keys), name)

    def check_tables(self) -> None:
        for m in self.catalog.models.values():
            self.sources.frame(m)

    def check_anchors(self) -> None:
        """Runs each certified number again, at its metric's coarsest grain, and compares the rendered text."""
        for m in self.catalog.metrics.values():
            if m.anchor:
                start, end, value = m.anchor
                q = Question((m.name,), max(m.grains, key=GRAINS.index), start, end)
                got = [rendered(r[m.name]) for r in self.ask(q).rows()]
                if got != [value]:
                    raise Refusal("anchor_mismatch", m.name)


def rendered(cell: object) -> str | None:
    """A cell as text: booleans as 0 and 1, whole decimals as integers."""
    from decimal import Decimal

    if cell is None:
        return None
    if isinstance(cell, bool):
        return str(int(cell))
    if isinstance(cell, Decimal):
        return str(int(cell)) if cell == cell.to_integral_value() else str(cell)
    return str(cell)
