"""Authored SQL aggregates: checked against a list of allowed calls before Spark sees them in a plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..refusal import Refusal

#: The functions that an authored measure may call.
SCALARS = ("ABS", "CAST", "COALESCE", "GREATEST", "LEAST", "NULLIF", "ROUND", "TRY_CAST")
AGGREGATES = (
    "ARRAY_AGG", "AVG", "COUNT", "COUNTIF", "COUNT_IF", "GROUP_CONCAT", "LIST", "MAX", "MEDIAN", "MIN", "PERCENTILE_CONT",
    "PERCENTILE_DISC", "STDDEV", "STDDEV_POP", "STDDEV_SAMP", "STRING_AGG", "SUM", "SUMIF", "SUM_IF", "UNIQEXACT", "VARIANCE",
    "VAR_POP", "VAR_SAMP",
)
#: What Spark calls those that it names otherwise; SUMIF(x, c) and UNIQEXACT(x) are rewritten below.
SPARK_NAMES = {"COUNTIF": "count_if", "LIST": "collect_list", "ARRAY_AGG": "collect_list", "GROUP_CONCAT": "string_agg"}
DEPTH = 32
#: Spark's nodes for operators and literals that an expression may hold.
_NODES = {"UnresolvedAttribute", "Literal", "Add", "Subtract", "Multiply", "Divide", "Remainder", "UnaryMinus", "UnaryPositive", "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "And", "Or", "Not", "In", "IsNull", "IsNotNull", "CaseWhen", "Cast", "Between", "Like", "UnresolvedFunction", "SortOrder"}


def _children(node) -> list:
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def checked(spark: SparkSession, text: str, columns: set[str]) -> str:
    """The expression in Spark's names, or a refusal that says which construct is not allowed."""

    def refuse(what: str) -> None:
        raise Refusal("expression_refused", what)

    if not text.isascii():
        refuse("only ASCII")
    if re.search(r"--|/\*", text):
        refuse("comment")
    if re.search(r"\bIS\s+(NOT\s+)?(TRUE|FALSE)\b", text, re.I):
        refuse("is true")
    if re.search(r"\bDIV\b|//", text, re.I):
        refuse("integer division")
    if re.search(r"\b(SELECT|FROM|OVER|FILTER|INSERT|DROP|CREATE)\b", text, re.I):
        refuse("subquery, window, filter or statement")
    if re.search(r"\(\s*\*|,\s*\*", text):
        refuse("star")
    if re.search(r"\?|:[A-Za-z]", text):
        refuse("bind parameter")
    rewritten = re.sub(r"\bUNIQEXACT\s*\(", "count(DISTINCT ", text, flags=re.I)
    rewritten = re.sub(r"\bSUM_?IF\s*\(([^(),]+),([^(),]+)\)", r"sum(CASE WHEN \2 THEN \1 END)", rewritten, flags=re.I)
    rewritten = re.sub(r"\b(\w+)(?=\s*\()", lambda m: SPARK_NAMES.get(m[1].upper(), m[1]), rewritten)
    try:
        root = spark._jsparkSession.sessionState().sqlParser().parseExpression(rewritten)
    except Exception:
        refuse("it does not parse as one expression")
    allowed = {x.lower() for x in SCALARS + AGGREGATES} | {x.lower() for x in SPARK_NAMES.values()}
    aggregates = {x.lower() for x in AGGREGATES} | {x.lower() for x in SPARK_NAMES.values()}

    def walk(node, depth: int, inside: bool, guarded: bool) -> bool:
        """Whether an aggregate stands in it; a column outside of one is refused."""
        if depth > DEPTH:
            refuse("too deep")
        kind = node.getClass().getSimpleName()
        name = ""
        if kind == "UnresolvedFunction":
            if node.nameParts().size() > 1:
                refuse("qualified function")
            name = node.nameParts().apply(0).lower()
            if name not in allowed:
                refuse(f"function {name}")
        elif kind == "UnresolvedStar":
            refuse("star")
        elif kind not in _NODES:
            refuse(f"construct {kind}")
        if kind == "UnresolvedAttribute":
            parts = node.nameParts()
            if parts.size() > 1:
                refuse("qualified column")
            if parts.apply(0) not in columns:
                refuse(f"unknown column {parts.apply(0)}")
            if not inside:
                refuse("a column that is not aggregated")
        if kind == "Divide":
            below = _children(node)[1]
            own = below.nameParts().apply(0).lower() if below.getClass().getSimpleName() == "UnresolvedFunction" else ""
            if own != "nullif" and below.getClass().getSimpleName() != "Literal":
                refuse("unguarded division")
        if name in aggregates and inside:
            refuse("nested aggregate")
        found = [walk(c, depth + 1, inside or name in aggregates, guarded) for c in _children(node)]
        return name in aggregates or any(found)

    if not walk(root, 1, False, False):
        refuse("not aggregated")
    return rewritten


def measure(spark: SparkSession, text: str, columns: set[str]) -> Column:
    return F.expr(checked(spark, text, columns))
