"""What a question means against a catalog, or the refusal of it."""

from __future__ import annotations

from dataclasses import dataclass

from ..model import Catalog, Dimension, Filter, Limits, Metric, Question
from ..refusal import Refusal


@dataclass(frozen=True)
class Resolved:
    """The question's metrics, and for each of them its own dimensions and filters by name."""

    question: Question
    metrics: tuple[Metric, ...]
    dimensions: tuple[tuple[Dimension, ...], ...]
    filters: tuple[tuple[tuple[Dimension, Filter], ...], ...]

    @property
    def keys(self) -> list[str]:
        return [*self.question.dimensions, "period"]


def _end(catalog: Catalog, metric: Metric, d: Dimension) -> tuple[str, str]:
    return (catalog.relationships[d.via[-1]].target if d.via else metric.model), d.column


def resolve(catalog: Catalog, q: Question, limits: Limits, audience: str = "open") -> Resolved:
    """A metric outside the caller's audience is unknown. Values that are not declared are refused without being named."""
    if len(q.metrics) > limits.metrics:
        raise Refusal("too_many_metrics", f"{limits.metrics} at most")
    if len(set(q.metrics)) < len(q.metrics):
        raise Refusal("duplicate_metric_name")
    if len(q.dimensions) > limits.dimensions:
        raise Refusal("too_many_dimensions", f"{limits.dimensions} at most")
    if len(set(q.dimensions)) < len(q.dimensions):
        raise Refusal("duplicate_dimension")
    if len(q.filters) > limits.filters or any(len(f.values) > limits.values for f in q.filters):
        raise Refusal("too_many_filters")
    if (q.end - q.start).days > limits.days:
        raise Refusal("time_range_too_long", f"{limits.days} days at most")
    if q.top and q.top.n > limits.rows:
        raise Refusal("result_too_large", f"top of {limits.rows} at most")
    metrics, dims, filters = [], [], []
    for name in q.metrics:
        metric = catalog.metrics.get(name)
        if metric is None or metric.audience not in ("open", audience):
            raise Refusal("metric_unknown", name)
        if q.grain not in metric.grains:
            raise Refusal("grain_not_supported", f"{name}: {q.grain}")
        for asked in (*q.dimensions, *(f.dimension for f in q.filters)):
            if asked not in metric.dimensions:
                raise Refusal("dimension_not_permitted", f"{name}: {asked}")
        for f in q.filters:
            declared = metric.dimensions[f.dimension].values
            if declared is None:
                raise Refusal("dimension_not_filterable", f"{name}: {f.dimension}")
            if not set(f.values) <= set(declared):
                raise Refusal("dimension_value_not_allowed", f"{name}: {f.dimension}")
        metrics.append(metric)
        dims.append(tuple(metric.dimensions[d] for d in q.dimensions))
        filters.append(tuple((metric.dimensions[f.dimension], f) for f in q.filters))
    for i, asked in enumerate((*q.dimensions, *(f.dimension for f in q.filters))):
        ends = {_end(catalog, m, m.dimensions[asked]) for m in metrics}
        if len(ends) > 1:
            raise Refusal("dimension_not_conformed", asked)
    return Resolved(q, tuple(metrics), tuple(dims), tuple(filters))
