"""What must hold between the definitions of a catalog before any question is answered from it."""

from __future__ import annotations

from ..model import CARDINALITIES, GRAINS, Catalog, Limits, Metric
from ..refusal import Refusal


def _chain(c: Catalog, m: Metric, start: str, via: tuple[str, ...], what: str) -> str:
    """The model at the end of a chain that begins at `start`."""
    at = start
    for name in via:
        r = c.relationships.get(name)
        if r is None:
            raise Refusal("unknown_reference", f"{m.name}: relationship {name}")
        if r.origin != at:
            raise Refusal("invalid_definition", f"{m.name}: broken chain at {name} of {what}")
        at = r.target
    return at


def consistent(c: Catalog) -> Catalog:
    def need(ok: object, code: str, detail: str) -> None:
        if not ok:
            raise Refusal(code, detail)

    for m in c.models.values():
        need(m.columns, "invalid_definition", f"{m.name}: no columns")
        need(len({x.lower() for x in m.columns}) == len(m.columns), "name_collision", f"{m.name}: columns")
        need(set(m.primary_key) <= set(m.columns), "unknown_reference", f"{m.name}: primary key")
    for r in c.relationships.values():
        need(r.join_type in CARDINALITIES, "invalid_definition", f"{r.name}: join type")
        need(r.join_type != "one_to_many", "invalid_definition", f"{r.name}: a join that repeats facts")
        need(r.keys, "invalid_definition", f"{r.name}: no keys")
        need(r.compare_as in (None, "exact_integer", "exact_decimal"), "invalid_definition", f"{r.name}: compare_as")
        for side, pick in ((r.origin, lambda k: k.origin), (r.target, lambda k: k.target)):
            need(side in c.models, "unknown_reference", f"{r.name}: model {side}")
            for k in r.keys:
                need(pick(k) in c.models[side].columns, "unknown_reference", f"{r.name}: {side}.{pick(k)}")
                need(not c.models[side].columns[pick(k)].policy, "invalid_definition", f"{r.name}: protected key {pick(k)}")
                need(k.grain is None or k.grain in GRAINS, "invalid_definition", f"{r.name}: grain {k.grain}")
    for m in c.metrics.values():
        need(m.model in c.models, "unknown_reference", f"{m.name}: model {m.model}")
        need(m.grains and set(m.grains) <= set(GRAINS), "invalid_definition", f"{m.name}: grains")
        columns = c.models[m.model].columns
        clock = columns
        if m.calendars:
            for model, name in m.calendars.items():
                need(model in c.models, "unknown_reference", f"{m.name}: calendar of {model}")
                clock = c.models[_chain(c, m, model, (name,), "calendar")].columns
            need(len({c.relationships[n].target for n in m.calendars.values()}) == 1, "invalid_definition", f"{m.name}: calendars differ")
        need(m.time_column in clock, "unknown_reference", f"{m.name}: time column")
        for t in m.measure.terms if m.measure else ():
            need((t.model or m.model) in c.models, "unknown_reference", f"{m.name}: model {t.model}")
            own = c.models[t.model or m.model].columns
            need(t.column in own, "unknown_reference", f"{m.name}: column {t.column}")
            need(not own[t.column].policy, "invalid_definition", f"{m.name}: a measure of a protected column")
        for f in m.required:
            need(f.column in columns, "unknown_reference", f"{m.name}: column {f.column}")
        labels = [x.lower() for x in (*m.dimensions, "period", m.name)]
        need(len(set(labels)) == len(labels), "name_collision", f"{m.name}: labels")
        for d in m.dimensions.values():
            end = c.models[_chain(c, m, m.model, d.via, d.name)]
            need(d.column in end.columns, "unknown_reference", f"{m.name}: {end.name}.{d.column}")
            need(not end.columns[d.column].policy, "invalid_definition", f"{m.name}: a dimension of a protected column")
            need(d.values is None or 0 < len(d.values) <= Limits.values, "invalid_definition", f"{m.name}: values of {d.name}")
            if d.second:
                need(m.second_model, "invalid_definition", f"{m.name}: {d.name} has a second chain")
                need(_chain(c, m, m.second_model, d.second, d.name) == end.name, "invalid_definition", f"{m.name}: {d.name} ends on two models")
        if m.anchor:
            need(m.anchor[0] < m.anchor[1], "invalid_definition", f"{m.name}: anchor")
    for n in c.notes:
        for about in n.about:
            need(about in c.metrics or about in c.models or about in c.relationships, "unknown_reference", f"{n.name}: {about}")
    return c
