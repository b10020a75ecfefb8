"""Read-only SQL over admitted tables, which Spark parses and plans; protected columns are masked beneath every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import masked
from ..model import Model
from ..refusal import Refusal

BYTES, OPERATORS = 64 * 1024, 1000


#: Spark's plan nodes that write or change something, and those that make rows out of nothing or of functions.
WRITES = ("Insert", "Create", "Drop", "Alter", "SetCatalog", "SetNamespace", "Show", "Describe", "Update", "Delete", "Merge", "Truncate", "Cache", "Uncache", "Refresh", "Use", "Explain", "Replace", "Analyze", "Add", "Repair", "Load", "CompoundBody")
TABLE_FUNCTIONS = ("UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "Generate", "LateralJoin", "RelationTimeTravel", "ScriptTransformation", "Pivot", "Unpivot", "Sample")
#: What a statement may hold, as Spark's parser names it; all else is refused.
RELATIONS = {
    "UnresolvedRelation", "UnresolvedWith", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "Project", "Filter", "Aggregate", "UnresolvedHaving", "Join",
    "Union", "Intersect", "Except", "Distinct", "Sort", "GlobalLimit", "LocalLimit", "Offset", "WithWindowDefinition", "OneRowRelation",
}
EXPRESSIONS = {
    "UnresolvedAttribute", "UnresolvedOrdinal", "UnresolvedStar", "UnresolvedAlias", "Alias", "Literal", "UnresolvedFunction", "Add", "Subtract", "Multiply", "Divide", "Remainder",
    "IntegralDivide", "UnaryMinus", "UnaryPositive", "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "And", "Or", "Not",
    "In", "InSubquery", "ListQuery", "Exists", "ScalarSubquery", "IsNull", "IsNotNull", "IsUnknown", "IsNotUnknown", "IsTrue", "IsNotTrue", "CaseWhen", "Cast", "Between",
    "UnresolvedBetween", "Like", "ILike", "SortOrder", "WindowExpression", "UnresolvedWindowExpression", "WindowSpecDefinition", "WindowSpecReference", "SpecifiedWindowFrame",
    "UnspecifiedFrame", "CurrentRow", "UnboundedPreceding", "UnboundedFollowing", "Rollup", "Cube", "GroupingSets", "Concat", "Substring", "StringTrim", "StringTrimLeft",
    "StringTrimRight", "StringLocate", "CurrentDate",
}
#: Functions whose results are no larger than what they read, over the rows' own values alone.
FUNCTIONS = {
    "count", "sum", "avg", "mean", "min", "max", "count_if", "bool_and", "bool_or", "every", "some", "any", "any_value", "first", "last", "median", "mode", "percentile", "percentile_cont",
    "percentile_disc", "stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp", "corr", "covar_pop", "covar_samp", "min_by", "max_by", "grouping", "grouping_id",
    "row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "first_value", "last_value", "nth_value",
    "abs", "ceil", "ceiling", "floor", "round", "bround", "sign", "signum", "sqrt", "exp", "ln", "log", "log10", "log2", "power", "pow", "mod", "greatest", "least", "coalesce", "nullif",
    "ifnull", "nvl", "nvl2", "if", "isnull", "isnotnull", "isnan", "try_divide", "try_add", "try_cast",
    "lower", "upper", "lcase", "ucase", "initcap", "length", "len", "char_length", "character_length", "octet_length", "substring", "substr", "left", "right", "trim", "ltrim", "rtrim", "btrim",
    "position", "locate", "instr", "startswith", "endswith", "contains", "concat", "reverse", "split_part", "ascii", "like", "ilike",
    "year", "quarter", "month", "week", "weekofyear", "day", "dayofmonth", "dayofweek", "dayofyear", "hour", "minute", "second", "extract", "date_part", "date_trunc", "trunc", "date_add",
    "date_sub", "datediff", "date_diff", "add_months", "months_between", "last_day", "to_date", "to_timestamp", "make_date", "date",
}


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _named(spark: SparkSession, text: str):
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise Refusal("construct_not_allowed", "it does not parse as one query") from e


def checked(spark: SparkSession, text: str, admitted: set[str]) -> set[str]:
    """The tables that the statement reads; refused unless it is one query over admitted tables and nothing else."""
    text = text.strip()
    if len(text.encode()) > BYTES:
        raise Refusal("statement_too_long")
    tables: set[str] = set()
    count = [0]
    known = {t.lower() for t in admitted}

    def relation(node, kind: str, local: frozenset) -> None:
        if "execution" in node.getClass().getName() or "Command" in kind or kind.startswith(WRITES):
            raise Refusal("not_read_only", kind)
        if kind in TABLE_FUNCTIONS:
            raise Refusal("table_function", kind)
        if kind not in RELATIONS:
            raise Refusal("construct_not_allowed", kind)
        if kind == "UnresolvedWith":
            if node.allowRecursion():
                raise Refusal("recursive_cte")
            for pair in _list(node.cteRelations()):
                walk(pair._2(), local, False)
                local |= {pair._1().lower()}
            walk(node.child(), local, False)
            return
        if kind == "UnresolvedRelation":
            parts = [p.lower() for p in _list(node.multipartIdentifier())]
            if len(parts) == 1 and parts[0] in local:
                return
            if len(parts) != 1 or parts[0] not in known:
                raise Refusal("unknown_table", ".".join(parts))
            tables.add(parts[0])
        for e in _list(node.expressions()):
            walk(e, local, True, kind == "Project")
        for c in _list(node.children()):
            walk(c, local, False)

    def walk(node, local: frozenset, expression: bool, projecting: bool = False) -> None:
        kind = node.getClass().getSimpleName().rstrip("$")
        count[0] += 1
        if count[0] > 4 * OPERATORS:
            raise Refusal("expression_too_large")
        if not expression:
            relation(node, kind, local)
            return
        if kind == "Exists" and projecting:
            raise Refusal("exists_in_projection")
        if kind not in EXPRESSIONS:
            raise Refusal("construct_not_allowed", kind)
        if kind == "UnresolvedFunction" and (node.nameParts().size() > 1 or node.nameParts().apply(0).lower() not in FUNCTIONS):
            raise Refusal("construct_not_allowed", ".".join(_list(node.nameParts())))
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            walk(node.plan(), local, False)
        for c in _list(node.children()):
            walk(c, local, True, projecting)

    if text.count("(") > OPERATORS or sum(text.count(x) for x in "+-*/|") > OPERATORS:
        raise Refusal("expression_too_large")
    walk(_named(spark, text), frozenset(), False)
    if not tables:
        raise Refusal("select_without_table")
    return tables


def view(df: DataFrame, model: Model) -> DataFrame:
    """The model's columns, protected ones masked."""
    return df.select(*(masked(F.col(c.name), c.policy).alias(c.name) if c.policy else F.col(c.name) for c in model.columns.values()))


def run(spark: SparkSession, text: str, tables: dict[str, DataFrame], used: set[str] | None = None) -> DataFrame:
    """The statement's answer over `tables` alone, in a session of its own; all rows. `used`: what `checked` has said of it."""
    used = checked(spark, text, set(tables)) if used is None else used
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.ansi.enabled", "spark.sql.caseSensitive"):
        own.conf.set(k, spark.conf.get(k))
    for name, df in tables.items():
        if name.lower() in used:
            _adopt(own, df, name)
    return own.sql(text.strip())


def _adopt(own: SparkSession, df: DataFrame, name: str) -> None:
    """The same logical plan, under a name in another session, so that push-down still reaches its files."""
    plan = df._jdf.queryExecution().analyzed()
    DataFrame(own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, plan), own).createOrReplaceTempView(name)
