"""The plan of a question: one grouped statement, a stack of them, a merge of several facts, or legs of several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates
from ..functions.calendar import bucket, within
from ..functions.expression import measure as authored
from ..model import Catalog, Dimension, Filter, Limits, Metric, Required
from ..operators.joins import Chain, compared, kind, unique_lookup
from ..operators.merge import full_merge, stacked
from ..operators.order import ordered, topped
from ..refusal import Refusal
from ..sources import Sources
from .resolve import Resolved


def _matches(column: Column, f: Filter) -> Column:
    """Null fails every one of them."""
    values = [F.lit(v) for v in f.values]
    return {"equals": lambda: column == values[0], "not_equals": lambda: column != values[0], "in": lambda: column.isin(*values), "not_in": lambda: ~column.isin(*values)}[f.op]()


def _requires(column: Column, r: Required) -> Column:
    return {"equals": lambda: column == F.lit(r.value), "not_equals": lambda: column != F.lit(r.value), "is_true": lambda: column.eqNullSafe(F.lit(True)), "is_not_null": lambda: column.isNotNull()}[r.op]()


class Planner:
    def __init__(self, spark: SparkSession, catalog: Catalog, sources: Sources, limits: Limits):
        self.spark, self.catalog, self.sources, self.limits = spark, catalog, sources, limits

    def frame(self, model: str) -> DataFrame:
        return self.sources.frame(self.catalog.models[model])

    def source(self, model: str) -> str:
        return self.catalog.models[model].source

    def crossing(self, via: tuple[str, ...], model: str) -> int | None:
        """How many hops stay in the fact's source; None if all do."""
        for i, name in enumerate(via):
            if self.source(self.catalog.relationships[name].target) != self.source(model):
                return i
        return None

    def asked(self, r: Resolved, i: int) -> list[Dimension]:
        return [*r.dimensions[i], *(d for d, _ in r.filters[i])]

    def plan(self, r: Resolved) -> DataFrame:
        """Keys, period and measures, unordered."""
        crosses = [any(self.crossing(d.via, m.model) is not None for d in self.asked(r, i)) for i, m in enumerate(r.metrics)]
        used = {self.source(m.model) for m in r.metrics} | {self.source(self.catalog.relationships[v].target) for i in range(len(r.metrics)) for d in self.asked(r, i) for v in d.via}
        if len(used) > self.limits.sources:
            raise Refusal("plan_spans_too_many_sources", f"{self.limits.sources} at most")
        first = r.metrics[0]
        paths = [tuple((d.name, d.via, d.column) for d in self.asked(r, i)) for i in range(len(r.metrics))]
        together = not any(crosses) and all(m.second_model is None and (m.model, m.time_column) == (first.model, first.time_column) for m in r.metrics) and len(set(paths)) == 1
        if together:
            return self.mono(r, range(len(r.metrics)))
        arms = [self.one(r, i, crosses[i]) for i in range(len(r.metrics))]
        if len(arms) == 1:
            return arms[0]
        if len(arms) > self.limits.legs:
            raise Refusal("question_needs_too_many_legs", f"{self.limits.legs} at most")
        if not any(crosses) and len(used) == 1 and all(m.second_model is None for m in r.metrics):
            return stacked(arms, r.keys)
        return full_merge(arms, r.keys)

    def one(self, r: Resolved, i: int, crosses: bool) -> DataFrame:
        if r.metrics[i].second_model:
            return self.two_facts(r, i)
        return self.federated(r, i) if crosses else self.mono(r, [i])

    def _fact(self, r: Resolved, i: int, vias: list[tuple[str, ...]], model: str | None = None, ambiguous: str = "ambiguous_link") -> Chain:
        m = r.metrics[i]
        tables = [self.catalog.relationships[v].target for via in {v[:k] for v in vias for k in range(1, len(v) + 1)} for v in via[-1:]]
        named = [self.catalog.models[t].table.lower() for t in tables]
        if len(set(named)) < len(named) or self.catalog.models[model or m.model].table.lower() in named:
            raise Refusal("plan_tables_share_an_identifier")
        chain = Chain(self.catalog, self.frame, model or m.model, ambiguous)
        for via in sorted(vias):
            chain.join(via)
        return chain

    def mono(self, r: Resolved, which) -> DataFrame:
        """One pass and one exchange: joins, filters, one grouping. With several metrics, required filters that differ
        move inside the aggregates."""
        i = which[0]
        q, m = r.question, r.metrics[i]
        chain = self._fact(r, i, [d.via for d in self.asked(r, i)])
        column = chain.column
        time = column((), m.time_column)
        df = chain.df.filter(within(time, q.start, q.end))
        for d, f in r.filters[i]:
            df = df.filter(_matches(column(d.via, d.column), f))
        metrics = [r.metrics[k] for k in which]
        shared = len({x.required for x in metrics}) == 1
        if shared:
            for need in m.required:
                df = df.filter(_requires(column((), need.column), need))
        measures = []
        for x in metrics:
            guard = None if shared or not x.required else reduce(lambda a, b: a & b, (_requires(column((), n.column), n) for n in x.required))
            measures.append(self.measure(x, chain, guard).alias(x.name))
        keys = [column(d.via, d.column).alias(d.name) for d in r.dimensions[i]]
        return df.groupBy(*keys, bucket(time, q.grain).alias("period")).agg(*measures)

    def measure(self, m: Metric, chain: Chain, guard: Column | None) -> Column:
        if m.expression is not None:
            if guard is not None:
                raise Refusal("expression_refused", "an authored measure beside metrics with other filters")
            return authored(self.spark, m.expression, set(self.catalog.models[m.model].columns))
        terms = [aggregates.term(t, chain.column((), t.column), chain.type((), t.column), guard) for t in m.measure.terms]
        return terms[0] if len(terms) == 1 else aggregates.divided(m.measure, *terms)

    def federated(self, r: Resolved, i: int) -> DataFrame:
        """The fact is summed by its links and keys in its own source, each lookup is cut to one row for a link, and the
        parts are joined and summed again; counts of distinct values carry the values as keys, ratios are divided last.
        A lookup that carries a filter joins inner, any other left."""
        q, m = r.question, r.metrics[i]
        if m.expression is not None:
            raise Refusal("federation_not_executable", m.name)
        local = [d for d in self.asked(r, i) if self.crossing(d.via, m.model) is None]
        far = [d for d in self.asked(r, i) if self.crossing(d.via, m.model) is not None]
        cuts = {d.name: self.crossing(d.via, m.model) for d in far}
        roots = sorted({d.via[: cuts[d.name] + 1] for d in far})
        if len(roots) > self.limits.lookups:
            raise Refusal("plan_needs_too_many_lookup_legs", f"{self.limits.lookups} at most")
        chain = self._fact(r, i, [d.via for d in local] + [x[:-1] for x in roots])
        time = chain.column((), m.time_column)
        df = chain.df.filter(within(time, q.start, q.end))
        for need in m.required:
            df = df.filter(_requires(chain.column((), need.column), need))
        for d, f in r.filters[i]:
            if d in local:
                df = df.filter(_matches(chain.column(d.via, d.column), f))
        keys = {d.name: chain.column(d.via, d.column) for d in r.dimensions[i] if d in local} | {"period": bucket(time, q.grain)}
        lookups, links = [], {}
        for n, root in enumerate(roots):
            relation = self.catalog.relationships[root[-1]]
            mine = [d for d in far if d.via[: len(root)] == root]
            target = self.frame(relation.target)
            own = []
            for j, k in enumerate(relation.keys):
                there = target.schema[k.target].dataType
                here, of = compared(chain.column(root[:-1], k.origin), chain.type(root[:-1], k.origin), there, relation.compare_as)
                if k.grain:
                    here, of = bucket(here, k.grain), "date"
                if of != kind(there):
                    raise Refusal("federation_link_type_mismatch" if of else "link_type_mismatch", relation.name)
                links[f"_k{n}_{j}"] = here
                own.append(f"_k{n}_{j}")
            beyond = Chain(self.catalog, self.frame, relation.target)
            for d in sorted(mine, key=lambda d: d.via):
                beyond.join(d.via[len(root) :])
            side = beyond.df
            narrowed = [(d, f) for d, f in r.filters[i] if d in mine]
            names = sorted({d.name for d in mine})
            by = {d.name: d for d in mine}
            cols = [beyond.column(by[x].via[len(root) :], by[x].column).alias(x) for x in names]
            at = [(beyond.column((), k.target).cast("date") if k.grain else beyond.column((), k.target)).alias(c) for c, k in zip(own, relation.keys, strict=True)]
            side = unique_lookup(side.select(*at, *cols), own, names)
            for d, f in narrowed:
                side = side.filter(_matches(F.col(d.name), f))
            lookups.append((own, side, "inner" if narrowed else "left"))
        parts = [aggregates.Parts(t, f"_t{j}") for j, t in enumerate(m.measure.terms)]
        below, extra = {}, {}
        for p in parts:
            column, of = chain.column((), p.t.column), chain.type((), p.t.column)
            below |= p.below(column, of)
            extra |= p.key(column, of)
        grouped = df.groupBy(*(c.alias(n) for n, c in (keys | links | extra).items()))
        leg = grouped.agg(*(c.alias(n) for n, c in below.items())) if below else grouped.agg(F.count("*").alias("_rows"))
        for own, side, how in lookups:
            leg = leg.join(side, own, how)
        above = [p.above() for p in parts]
        value = above[0] if len(above) == 1 else aggregates.divided(m.measure, *above)
        return leg.groupBy(*(d.name for d in r.dimensions[i]), "period").agg(value.alias(m.name))

    def two_facts(self, r: Resolved, i: int) -> DataFrame:
        """A ratio over two models: each fact is summed by the keys and the calendar that both share, then they merge; a
        side without rows counts as 0. Sums and counts only."""
        q, m = r.question, r.metrics[i]
        second = m.second_model
        if not {m.model, second} <= set(m.calendars):
            raise Refusal("cross_model_ratio_without_shared_calendar", m.name)
        calendars = {x: self.catalog.relationships[m.calendars[x]] for x in (m.model, second)}
        if len({c.target for c in calendars.values()}) > 1:
            raise Refusal("cross_model_ratio_without_shared_calendar", m.name)
        if any(not d.via or not d.second for d in self.asked(r, i)):
            raise Refusal("cross_model_ratio_without_shared_dimension", m.name)
        legs = []
        for n, t in enumerate(m.measure.terms):
            model = t.model or m.model
            if t.aggregate not in ("sum", "count", "count_if"):
                raise Refusal("federation_not_executable", f"{m.name}: {t.aggregate}")
            path = (lambda d: d.via) if model == m.model else (lambda d: d.second)
            calendar = (m.calendars[model],)
            chain = self._fact(r, i, [*(path(d) for d in self.asked(r, i)), calendar], model, "cross_model_ratio_link_ambiguous")
            time = chain.column(calendar, m.time_column)
            df = chain.df.filter(within(time, q.start, q.end))
            for need in m.required if model == m.model else ():
                df = df.filter(_requires(chain.column((), need.column), need))
            for d, f in r.filters[i]:
                df = df.filter(_matches(chain.column(path(d), d.column), f))
            keys = [chain.column(path(d), d.column).alias(d.name) for d in r.dimensions[i]]
            legs.append(df.groupBy(*keys, bucket(time, q.grain).alias("period")).agg(aggregates.term(t, chain.column((), t.column), chain.type((), t.column)).alias(f"_t{n}")))
        merged = full_merge(legs, r.keys, absent={"_t0": 0, "_t1": 0})
        return merged.select(*r.keys, aggregates.divided(m.measure, F.col("_t0"), F.col("_t1")).alias(m.name))

    def answer(self, r: Resolved) -> DataFrame:
        """Labels in order: dimensions, period, metrics; ordered by the keys, or the top."""
        df = self.plan(r)
        for m in r.metrics:
            df = df.withColumn(m.name, aggregates.finite(F.col(m.name), df.schema[m.name].dataType))
        df = df.select(*r.keys, *(m.name for m in r.metrics))
        if r.question.top:
            return topped(df, r.keys, "period", r.metrics[-1].name, r.question.top)
        return ordered(df, r.keys)
