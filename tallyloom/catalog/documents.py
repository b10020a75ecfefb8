"""Catalog documents: YAML front matter and prose, one definition each (a cube: several metrics)."""

from __future__ import annotations

from datetime import date
from pathlib import Path

import yaml

from ..functions.text import checked
from ..model import AGGREGATES, Catalog, Column, Dimension, Key, Measure, Metric, Model, Note, Relationship, Required, Term, TextPolicy, identifier
from ..refusal import Refusal
from .consistency import consistent

NOTES = ("glossary", "caveat", "not_defined", "example")


def _only(raw: dict, allowed: str, what: str) -> None:
    if unknown := set(raw) - set(allowed.split()):
        raise Refusal("invalid_definition", f"{what}: unknown fields {sorted(unknown)}")


def _names(x: object) -> tuple[str, ...]:
    return () if x is None else (x,) if isinstance(x, str) else tuple(x)


def _model(raw: dict) -> Model:
    _only(raw, "kind name source table columns primary_key audience description", raw["name"])
    columns = {}
    for c in raw["columns"]:
        _only(c, "name type description nullable collation text_policy", f"{raw['name']}.{c.get('name')}")
        policy = c.get("text_policy")
        if policy is not None:
            policy = checked(TextPolicy(tuple((r["pattern"], r["replacement"]) for r in policy.get("redactions", ())), policy.get("clip_bytes")))
        columns[identifier(c["name"])] = Column(c["name"], c.get("type", "VARCHAR"), c.get("description", ""), c.get("nullable", True), policy)
    return Model(identifier(raw["name"]), raw["source"], raw["table"], columns, _names(raw.get("primary_key")), raw.get("audience", "open"))


def _relationship(raw: dict) -> Relationship:
    """One pair of columns inside origin and target, or a list of keys; both or neither is refused."""
    _only(raw, "kind name origin target keys join_type compare_as description", raw["name"])
    origin, target = raw["origin"], raw["target"]
    pair = "column" in origin or "column" in target
    if pair == ("keys" in raw):
        raise Refusal("invalid_definition", f"{raw['name']}: columns or keys")
    keys = (Key(origin["column"], target["column"]),) if pair else tuple(Key(k["origin"], k["target"], k.get("grain")) for k in raw["keys"])
    return Relationship(identifier(raw["name"]), origin["model"], target["model"], keys, raw.get("join_type", "many_to_one"), raw.get("compare_as"))


def _term(raw: dict) -> Term:
    _only(raw, "aggregate column count_if model", "term")
    t = Term("count_if", raw["count_if"], raw.get("model")) if "count_if" in raw else Term(raw["aggregate"], raw["column"], raw.get("model"))
    if t.aggregate not in AGGREGATES:
        raise Refusal("invalid_definition", f"aggregate {t.aggregate}")
    return t


def _measure(raw: dict) -> Measure:
    _only(raw, "simple ratio", "measure")
    if "simple" in raw:
        return Measure(_term(raw["simple"]))
    ratio = raw["ratio"]
    _only(ratio, "numerator denominator zero_denominator", "ratio")
    if ratio.get("zero_denominator") not in ("yields_null", "fails"):
        raise Refusal("invalid_definition", "zero_denominator: yields_null or fails")
    return Measure(_term(ratio["numerator"]), _term(ratio["denominator"]), ratio["zero_denominator"])


def _dimensions(raw: list) -> dict[str, Dimension]:
    out = {}
    for d in raw or ():
        _only(d, "name column via values description second_via", f"dimension {d.get('name')}")
        values = d.get("values")
        if d["name"] in out or (values is not None and not values):
            raise Refusal("invalid_definition", f"dimension {d['name']}")
        out[identifier(d["name"])] = Dimension(d["name"], d["column"], _names(d.get("via")), None if values is None else tuple(map(str, values)), d.get("description", ""), _names(d.get("second_via")))
    return out


def _required(raw: list) -> tuple[Required, ...]:
    out = []
    for entry in raw or ():
        (op, body), = entry.items()
        if op not in ("equals", "not_equals", "is_true", "is_not_null"):
            raise Refusal("invalid_definition", f"required filter {op}")
        body = {"column": body} if isinstance(body, str) else body
        out.append(Required(op, body["column"], body.get("value")))
    return tuple(out)


def _metric(raw: dict, prose: str) -> Metric:
    _only(raw, "kind name model measure expression required_filters time_column grains dimensions anchor audience calendars description", raw["name"])
    if ("measure" in raw) == ("expression" in raw):
        raise Refusal("invalid_definition", f"{raw['name']}: measure or expression")
    day = lambda x: x if isinstance(x, date) else date.fromisoformat(str(x))
    anchor = raw.get("anchor")
    return Metric(
        identifier(raw["name"]), raw["model"], raw["time_column"], tuple(raw["grains"]), _measure(raw["measure"]) if "measure" in raw else None,
        raw.get("expression"), _required(raw.get("required_filters")), _dimensions(raw.get("dimensions")),
        (day(anchor["range"]["start"]), day(anchor["range"]["end"]), str(anchor["value"])) if anchor else None,
        raw.get("audience", "open"), raw.get("calendars") or {}, prose,
    )


def _cube(raw: dict, prose: str) -> list[Metric]:
    """One metric for each measure; all share model, time column, grains, dimensions and filters."""
    shared = {k: v for k, v in raw.items() if k not in ("kind", "name", "measures")}
    return [_metric(shared | {"kind": "metric"} | m, prose) for m in raw["measures"]]


def parsed(text: str) -> tuple[dict, str]:
    if not text.startswith("---\n") or "\n---" not in text[4:]:
        raise Refusal("invalid_definition", "no front matter")
    head, _, prose = text[4:].partition("\n---")
    try:
        raw = yaml.safe_load(head)
    except yaml.YAMLError as e:
        raise Refusal("invalid_definition", str(e)) from e
    if not isinstance(raw, dict) or "kind" not in raw:
        raise Refusal("invalid_definition", "no kind")
    return raw, prose.strip()


def catalog(texts: list[str]) -> Catalog:
    """All documents' definitions, checked together, so that they may refer to each other in any order."""
    models, relationships, metrics, notes = {}, {}, {}, []

    def add(to: dict, x) -> None:
        if x.name.lower() in {n.lower() for n in to}:
            raise Refusal("name_collision", x.name)
        to[x.name] = x

    for text in texts:
        raw, prose = parsed(text)
        kind = raw["kind"]
        try:
            if kind == "model":
                add(models, _model(raw))
            elif kind == "relationship":
                add(relationships, _relationship(raw))
            elif kind == "metric":
                add(metrics, _metric(raw, prose))
            elif kind == "cube":
                for m in _cube(raw, prose):
                    add(metrics, m)
            elif kind in NOTES:
                about = tuple(a.get("metric") or a.get("model") or "" for a in raw.get("about") or ()) + _names(raw.get("relationships"))
                notes.append(Note(kind, raw["name"], about, prose))
            elif kind != "declaration":
                raise Refusal("invalid_definition", f"kind {kind!r}")
        except (KeyError, TypeError, ValueError) as e:
            raise Refusal("invalid_definition", f"{kind} {raw.get('name')}: {e}") from e
    return consistent(Catalog(models, relationships, metrics, tuple(notes)))


def folder(path: str) -> Catalog:
    return catalog([p.read_text() for p in sorted(Path(path).rglob("*.md"))])
