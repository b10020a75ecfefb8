"""Catalogs from other descriptions of tables: a database's dictionary, data contracts, semantic-layer manifests.

Each gives the same definitions as the documents; what has no counterpart is left out, never guessed.
"""

from __future__ import annotations

import re

import yaml
from pyspark.sql import DataFrame

from ..model import GRAINS, Catalog, Column, Dimension, Key, Measure, Metric, Model, Relationship, Term, identifier
from ..refusal import Refusal
from .consistency import consistent


def _wanted(name: str, include: tuple[str, ...], exclude: tuple[str, ...]) -> bool:
    """`*` and `?` patterns, all else as it is written, case kept."""
    fits = lambda p: re.fullmatch(re.escape(p).replace(r"\*", ".*").replace(r"\?", "."), name, re.S)
    return any(map(fits, include)) and not any(map(fits, exclude))


def from_dictionary(columns: DataFrame, foreign_keys: DataFrame | None, source: str, include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = ()) -> Catalog:
    """From a database's own dictionary, read as DataFrames: columns (table_name, column_name, data_type, is_nullable,
    ordinal_position) and foreign keys (constraint_name, table_name, column_name, target_table, target_column,
    ordinal_position). Patterns pick tables; a foreign key counts only if all its columns and both tables are there."""
    models: dict[str, Model] = {}
    for r in columns.orderBy("table_name", "ordinal_position").toLocalIterator():
        if _wanted(r["table_name"], include, exclude):
            m = models.setdefault(r["table_name"], Model(identifier(r["table_name"]), source, r["table_name"], {}))
            m.columns[identifier(r["column_name"])] = Column(r["column_name"], r["data_type"].upper(), nullable=str(r["is_nullable"]).upper() in ("YES", "TRUE"))
    links: dict[str, list] = {}
    for r in foreign_keys.orderBy("constraint_name", "ordinal_position").toLocalIterator() if foreign_keys is not None else ():
        links.setdefault(r["constraint_name"], []).append(r)
    relationships = {}
    for name, rows in links.items():
        origin, target = models.get(rows[0]["table_name"]), models.get(rows[0]["target_table"])
        if origin and target and all(r["column_name"] in origin.columns and r["target_column"] in target.columns for r in rows):
            relationships[name] = Relationship(identifier(name), origin.name, target.name, tuple(Key(r["column_name"], r["target_column"]) for r in rows))
    return consistent(Catalog(models, relationships, {}))


def from_data_contract(text: str, source: str) -> Catalog:
    """From a data contract in YAML: each schema object is a model, its properties are the columns."""
    raw = yaml.safe_load(text)
    models = {}
    for entry in raw.get("schema") or ():
        name = entry.get("name")
        columns = {p["name"]: Column(identifier(p["name"]), str(p.get("physicalType") or p.get("logicalType") or "VARCHAR").upper(), p.get("description", ""), not p.get("required", False)) for p in entry.get("properties") or ()}
        key = tuple(p["name"] for p in entry.get("properties") or () if p.get("primaryKey"))
        models[name] = Model(identifier(name), source, entry.get("physicalName") or name, columns, key)
    if not models:
        raise Refusal("invalid_definition", "a contract without schema")
    return consistent(Catalog(models, {}, {}))


_CARDINALITY = {"ONE_TO_ONE": "one_to_one", "MANY_TO_ONE": "many_to_one", "ONE_TO_MANY": "one_to_many"}


def from_manifest(raw: dict, source: str) -> Catalog:
    """From a semantic-layer manifest: models with columns and primaryKey; relationships with two models, joinType and a
    condition of equalities; cubes with measures `aggregate(column)`, dimensions and a time dimension. One-to-many
    relationships are read from their other end; expressions beyond that form are refused."""
    models = {}
    for m in raw.get("models") or ():
        columns = {c["name"]: Column(identifier(c["name"]), str(c.get("type", "VARCHAR")).upper()) for c in m["columns"] if not c.get("relationship")}
        key = (m["primaryKey"],) if m.get("primaryKey") in columns else ()
        models[m["name"]] = Model(identifier(m["name"]), source, (m.get("tableReference") or {}).get("table") or m["name"], columns, key)
    relationships = {}
    for r in raw.get("relationships") or ():
        origin, target = r["models"]
        kind = _CARDINALITY.get(r["joinType"].upper())
        pairs = re.findall(r'"?(\w+)"?\."?(\w+)"?\s*=\s*"?(\w+)"?\."?(\w+)"?', r["condition"])
        if kind is None or not pairs or re.sub(r'"?\w+"?\."?\w+"?\s*=\s*"?\w+"?\."?\w+"?|\bAND\b|\s', "", r["condition"], flags=re.I):
            raise Refusal("invalid_definition", f"relationship {r['name']}")
        if kind == "one_to_many":
            origin, target, kind = target, origin, "many_to_one"
        keys = tuple(Key(b, d) if a == origin else Key(d, b) for a, b, c, d in pairs)
        relationships[r["name"]] = Relationship(identifier(r["name"]), origin, target, keys, kind)
    metrics = {}
    for cube in raw.get("cubes") or ():
        time = (cube.get("timeDimensions") or [{}])[0].get("expression")
        dims = {d["name"]: Dimension(identifier(d["name"]), d["expression"]) for d in cube.get("dimensions") or ()}
        for m in cube["measures"]:
            found = re.fullmatch(r"\s*(sum|count|avg|min|max)\s*\(\s*(distinct\s+)?(\w+)\s*\)\s*", m["expression"], re.I)
            if not found or (found[2] and found[1].lower() != "count") or not time:
                raise Refusal("invalid_definition", f"measure {m['name']}")
            t = Term("count_distinct" if found[2] else found[1].lower(), found[3])
            metrics[m["name"]] = Metric(identifier(m["name"]), cube["baseObject"], time, GRAINS, Measure(t), dimensions=dims)
    return consistent(Catalog(models, relationships, metrics))


def capabilities(c: Catalog) -> set[str]:
    """Which kinds of definition a catalog provides."""
    have = {
        "structure": c.models, "relationships": c.relationships, "metrics": c.metrics, "knowledge": c.notes,
        "column_descriptions": [x for m in c.models.values() for x in m.columns.values() if x.description],
        "primary_keys": [m for m in c.models.values() if m.primary_key], "text_policies": [x for m in c.models.values() for x in m.columns.values() if x.policy],
        "anchors": [m for m in c.metrics.values() if m.anchor], "allowlists": [d for m in c.metrics.values() for d in m.dimensions.values() if d.values],
    }
    return {k for k, v in have.items() if v}
