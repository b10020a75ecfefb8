"""One query for each operator, with its twin in SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import masked
from ..engine import Engine
from ..model import Column, Model, TextPolicy
from ..operators.probes import key_probe
from ..plans import statement
from .definitions import EACH, catalog, engine, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LINES = "lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey LEFT JOIN customer c ON o_custkey = c_custkey LEFT JOIN nation n ON c_nationkey = n_nationkey LEFT JOIN region r ON n_regionkey = r_regionkey LEFT JOIN part p ON l_partkey = p_partkey LEFT JOIN supplier s ON l_suppkey = s_suppkey"
_ORDERS = "orders o LEFT JOIN customer c ON o_custkey = c_custkey LEFT JOIN nation n ON c_nationkey = n_nationkey"
_SQL = {
    "line_items": "count(l_orderkey)", "gross_revenue": "sum(l_extendedprice::DECIMAL(18,2))::DOUBLE", "quantity_shipped": "sum(l_quantity::DECIMAL(18,2))::DOUBLE",
    "returned_revenue": "(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_returnflag = 'R'))::DOUBLE", "average_quantity": "avg(l_quantity)",
    "kept_lines": "count(l_orderkey) FILTER (l_returnflag <> 'R' AND l_partkey IS NOT NULL)", "flagged_lines": "count(l_orderkey) FILTER (l_returnflag = 'R')",
    "orders_shipped": "count(DISTINCT l_orderkey)", "smallest_line": "min(l_extendedprice::DECIMAL(18,2))::DOUBLE", "largest_line": "max(l_extendedprice::DECIMAL(18,2))::DOUBLE",
    "returned_lines": "count(*) FILTER (l_returnflag = 'R')", "return_rate": "(count(*) FILTER (l_returnflag = 'R'))::DOUBLE / nullif(count(l_orderkey), 0)",
    "lines_per_return": "count(l_orderkey)::DOUBLE / (count(*) FILTER (l_returnflag = 'R'))", "revenue_per_order": "sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / nullif(count(DISTINCT l_orderkey), 0)",
    "revenue_per_return": "sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / nullif(count(*) FILTER (l_returnflag = 'R'), 0)",
    "order_count": "count(o_orderkey)", "order_value": "sum(o_totalprice::DECIMAL(18,2))::DOUBLE", "customers_ordering": "count(DISTINCT o_custkey)",
    "event_count": "count(event_id)", "users_seen": "count(DISTINCT user_id)",
    "median_price": "percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity)", "quantity_spread": "(max(l_quantity) - min(l_quantity))::DOUBLE",
    "net_share": "sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0)",
}
_COLUMNS = {
    "return_flag": "l_returnflag", "line_status": "l_linestatus", "order_priority": "o_orderpriority", "market_segment": "c_mktsegment",
    "customer_nation": "n_name", "customer_region": "r_name", "part_type": "p_type", "brand": "p_brand", "supplier_name": "s_name",
    "order_status": "o_orderstatus", "event_type": "event_type",
}


def plain(df: DataFrame) -> DataFrame:
    """Decimals without places as long, others as double."""
    shape = lambda f: F.col(f.name).cast("long" if f.dataType.scale == 0 else "double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
    return df.select(*map(shape, df.schema.fields))


def _when(start: str, end: str, time: str) -> str:
    return f"{time} >= TIMESTAMP '{start}' AND {time} < TIMESTAMP '{end}'"


def _ask(name: str, metrics: list[str], dims: tuple = (), grain: str = "month", start: str = "1996-01-01", end: str = "1997-01-01", filters: tuple = (), top: dict | None = None, split: bool = False, sql: str | None = None, where: str = "", base: str = _LINES, time: str = "l_shipdate") -> None:
    asked = {"metrics": metrics, "grain": grain, "range": {"start": start, "end": end}, "dimensions": list(dims), "filters": list(filters), "top": top}
    QUERIES[name] = lambda spark, sf_dir: plain(engine(spark, sf_dir, split).ask(asked).df)
    if sql is None:
        keys = "".join(f"{_COLUMNS[d]} AS {d}, " for d in dims)
        measures = ", ".join(f"{_SQL[m]} AS {m}" for m in metrics)
        sql = f"SELECT {keys}date_trunc('{grain}', {time})::DATE AS period, {measures} FROM {base} WHERE {_when(start, end, time)}{where} GROUP BY ALL"
        if top:
            lead = metrics[-1] if top.get("by", "metric") == "metric" else "period"
            sql = f"SELECT * FROM ({sql}) ORDER BY {lead} {top.get('direction', 'desc')} NULLS LAST, {', '.join((*dims, 'period'))} LIMIT {top['n']}"
    ORACLES[name] = sql


_ask("revenue_per_order", ["revenue_per_order"], ("market_segment",))
for _metric, _name in {"gross_revenue": "agg_sum", "line_items": "agg_count", "orders_shipped": "agg_count_distinct", "average_quantity": "agg_avg", "smallest_line": "agg_min", "largest_line": "agg_max", "returned_lines": "count_if", "return_rate": "ratio_null", "lines_per_return": "ratio_fail_ok"}.items():
    _ask(_name, [_metric], ("return_flag",) if _name not in ("ratio_fail_ok",) else (), grain="quarter" if _name == "ratio_fail_ok" else "month")
_ask("required_filter", ["returned_revenue"], ("line_status",), where=" AND l_returnflag = 'R'")
_ask("required_not_equals_not_null", ["kept_lines"], ("line_status",), where=" AND l_returnflag <> 'R'")
_ask("required_is_true", ["flagged_lines"], ("line_status",), where=" AND l_returnflag = 'R'")
_F = {"equals": ("value", "R", "= 'R'"), "not_equals": ("value", "R", "<> 'R'"), "in": ("values", ["A", "R"], "IN ('A', 'R')"), "not_in": ("values", ["A", "R"], "NOT IN ('A', 'R')")}
for _op, (_key, _value, _text) in _F.items():
    _ask(f"filter_{_op}", ["gross_revenue"], ("return_flag",), filters=({"dimension": "return_flag", "op": _op, _key: _value},), where=f" AND l_returnflag {_text}")
_ask("filter_on_joined", ["gross_revenue"], ("customer_nation",), grain="year", filters=({"dimension": "market_segment", "op": "in", "values": ["BUILDING", "MACHINERY"]},), where=" AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
for _grain in ("day", "week", "month", "quarter", "year"):
    _ask(f"grain_{_grain}", ["gross_revenue", "line_items"], (), grain=_grain)
_ask("join_one_hop", ["quantity_shipped"], ("part_type",), grain="year")
_ask("join_chain", ["gross_revenue"], ("customer_region", "customer_nation"), grain="year")
_ask("join_three_ways", ["gross_revenue"], ("customer_region", "brand", "supplier_name"), grain="year", start="1996-01-01", end="1996-03-01")
_ask("join_compound_truncated", ["event_count", "users_seen"], ("month_label",), start="2024-01-01", end="2024-02-01", sql=f"SELECT event_type || ' ' || strftime(ts, '%Y-%m') AS month_label, date_trunc('month', ts)::DATE AS period, count(event_id) AS event_count, count(DISTINCT user_id) AS users_seen FROM events WHERE {_when('2024-01-01', '2024-02-01', 'ts')} GROUP BY ALL")
_ask("top_metric", ["gross_revenue"], ("brand",), grain="year", top={"n": 5})
_ask("top_metric_ascending", ["gross_revenue"], ("supplier_name",), grain="year", top={"n": 7, "direction": "asc"})
_ask("top_period", ["line_items"], ("return_flag",), grain="week", top={"n": 10, "by": "period", "direction": "desc"})
_ask("multi_metric", ["gross_revenue", "orders_shipped", "average_quantity", "return_rate"], ("market_segment",), grain="quarter")
_ask("multi_metric_guarded", ["returned_revenue", "kept_lines", "line_items", "revenue_per_return"], ("line_status",))
_STACK = f"SELECT coalesce(a.market_segment, b.market_segment) AS market_segment, coalesce(a.period, b.period) AS period, gross_revenue, order_count FROM (SELECT c_mktsegment AS market_segment, date_trunc('month', l_shipdate)::DATE AS period, {_SQL['gross_revenue']} AS gross_revenue FROM {_LINES} WHERE {_when('1998-06-01', '1999-03-01', 'l_shipdate')} GROUP BY ALL) a FULL JOIN (SELECT c_mktsegment AS market_segment, date_trunc('month', o_orderdate)::DATE AS period, {_SQL['order_count']} AS order_count FROM {_ORDERS} WHERE {_when('1998-06-01', '1999-03-01', 'o_orderdate')} GROUP BY ALL) b ON a.market_segment IS NOT DISTINCT FROM b.market_segment AND a.period = b.period"
_ask("stacked_two_facts", ["gross_revenue", "order_count"], ("market_segment",), start="1998-06-01", end="1999-03-01", sql=_STACK)
_ask("drill_across_full", ["gross_revenue", "order_count"], ("market_segment",), start="1998-06-01", end="1999-03-01", split=True, sql=_STACK)
_ask("fed_sum", ["gross_revenue"], ("market_segment",), split=True)
_ask("fed_distinct_pullup", ["orders_shipped"], ("brand",), grain="year", split=True)
_ask("fed_avg_decomposed", ["average_quantity"], ("customer_region",), grain="quarter", split=True)
_ask("fed_ratio_above", ["revenue_per_return"], ("supplier_name",), grain="quarter", split=True)
_ask("fed_min_max_lookup_chain", ["largest_line"], ("customer_nation",), grain="year", split=True)
_ask("fed_remote_filter_inner", ["gross_revenue"], ("market_segment",), filters=({"dimension": "market_segment", "op": "equals", "value": "BUILDING"},), where=" AND c_mktsegment = 'BUILDING'", split=True)
_ask("fed_two_lookups", ["gross_revenue"], ("market_segment", "part_type"), grain="year", split=True)
_ask("orders_by_priority", ["order_count", "order_value", "customers_ordering"], ("order_priority", "order_status"), grain="year", base=_ORDERS, time="o_orderdate")
_ask("cube_document", ["event_count", "users_seen"], ("event_type",), grain="week", start="2024-01-01", end="2024-02-01", base="events", time="ts")
_CROSS = f"SELECT coalesce(a.s, b.s) AS market_segment, coalesce(a.p, b.p) AS period, coalesce(a.v, 0)::DOUBLE / nullif(coalesce(b.v, 0), 0) AS revenue_per_order_placed FROM (SELECT c_mktsegment AS s, date_trunc('month', l_shipdate)::DATE AS p, sum(l_extendedprice::DECIMAL(18,2)) AS v FROM {_LINES} WHERE {_when('1998-06-01', '1999-03-01', 'l_shipdate')} GROUP BY ALL) a FULL JOIN (SELECT c_mktsegment AS s, date_trunc('month', o_orderdate)::DATE AS p, count(o_orderkey) AS v FROM {_ORDERS} WHERE {_when('1998-06-01', '1999-03-01', 'o_orderdate')} GROUP BY ALL) b ON a.s IS NOT DISTINCT FROM b.s AND a.p = b.p"
_ask("cross_model_ratio", ["revenue_per_order_placed"], ("market_segment",), start="1998-06-01", end="1999-03-01", sql=_CROSS)
_ask("authored_percentile", ["median_price"], ("return_flag",))
_ask("authored_spread", ["quantity_spread"], ("market_segment",))
_ask("authored_guarded_division", ["net_share"], ("line_status",), grain="year")


_ask("fed_top", ["gross_revenue"], ("market_segment",), split=True, top={"n": 7})
_ask("stacked_top", ["gross_revenue", "order_count"], ("market_segment",), start="1998-06-01", end="1999-03-01", top={"n": 7}, sql=f"SELECT * FROM ({_STACK}) ORDER BY order_count DESC NULLS LAST, market_segment, period LIMIT 7")
_ask("drill_across_top", ["gross_revenue", "order_count"], ("market_segment",), start="1998-06-01", end="1999-03-01", split=True, top={"n": 9, "direction": "asc"}, sql=f"SELECT * FROM ({_STACK}) ORDER BY order_count NULLS LAST, market_segment, period LIMIT 9")
_DUCK = {
    "countif": "count(*) FILTER (l_quantity > 25)", "count_if": "count(*) FILTER (l_quantity > 25)", "percentile_disc": "percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity)",
    "sumif": "sum(l_quantity) FILTER (l_quantity > 10)", "sum_if": "sum(l_quantity) FILTER (l_quantity <= 10)", "uniqexact": "count(DISTINCT l_suppkey)", "coalesce": "coalesce(sum(l_linenumber), 0)::BIGINT",
}
_SQL |= {f"each_{_k}": _DUCK.get(_k, _v) for _k, _v in EACH.items()}
for _k in EACH:
    _ask(f"authored_{_k}", [f"each_{_k}"], ("return_flag",), grain="year")


def _from_files(form: str, **options: str) -> Callable[[SparkSession, str], DataFrame]:
    """A question over tables that were written as files of another form."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{spark.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.mkdtemp(prefix='tables')}/{form}"
        place = tables(spark, sf_dir)
        for name in ("customer", "nation", "orders"):
            writer = place(name).write.mode("overwrite").options(**options)
            writer.option("header", True).csv(f"{folder}/{name}.csv") if form == "csv" else writer.json(f"{folder}/{name}.ndjson")
        asked = {"metrics": ["order_count", "customers_ordering"], "grain": "year", "range": {"start": "1996-01-01", "end": "1997-01-01"}, "dimensions": ["market_segment", "customer_nation"]}
        if form == "ndjson":  # whose timestamps are texts

            def read(name: str) -> DataFrame:
                df = spark.read.json(f"{folder}/{name}.ndjson")
                return df.withColumn("o_orderdate", F.to_timestamp("o_orderdate")) if name == "orders" else df

            return plain(Engine(spark, catalog(), {"lake": read}).ask(asked).df)
        return plain(Engine(spark, catalog(), {"lake": folder}).ask(asked).df)

    return query


def stmt_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(engine(spark, sf_dir, True).sql(ORACLES["stmt_two_sources"]).df)


def relative_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = {"metrics": ["line_items"], "grain": "month", "range": {"last": {"count": 1, "unit": "quarter"}}}
    return plain(engine(spark, sf_dir).ask(asked, today=date(1996, 8, 15)).df)


def key_probe_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = tables(spark, sf_dir)
    one = key_probe(place("orders"), ["o_orderkey"]).withColumn("name", F.lit("orders"))
    return one.unionByName(key_probe(place("lineitem"), ["l_orderkey", "l_linenumber"]).withColumn("name", F.lit("lineitem")))


POLICY = TextPolicy((("(?i)idiot|clown", "***"), ("[[:digit:]]+", "#")), 256)


def text_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", masked(F.col("text"), TextPolicy(POLICY.redactions)).alias("text"))


def text_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", masked(F.col("text"), TextPolicy((), 256)).alias("text"))


def _statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        notes = Model("documents", "lake", "documents", {"doc_id": Column("doc_id"), "text": Column("text", policy=POLICY), "lang": Column("lang"), "source": Column("source")})
        frames = {"documents": statement.view(read("documents"), notes)} | {t: read(t) for t in ("orders", "customer", "nation", "region", "lineitem")}
        return statement.run(spark, text, frames)

    return query


_MASKED = "(SELECT doc_id, lang, source, CASE WHEN strlen(x) <= 256 THEN x ELSE substr(x, 1, 60) || '...[truncated]' END AS text FROM (SELECT *, regexp_replace(regexp_replace(text, '(?i)idiot|clown', '***', 'g'), '[0-9]+', '#', 'g') AS x FROM documents)) d"
_STATEMENTS = {
    "stmt_window": "SELECT c_custkey, c_mktsegment, place FROM (SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS place FROM customer) t WHERE place <= 3",
    "stmt_union": "SELECT n_name AS name FROM nation UNION SELECT r_name AS name FROM region",
    "stmt_except_intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1",
    "stmt_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
    "stmt_anti": "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)",
    "stmt_semi": "SELECT c_custkey FROM customer SEMI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) o ON c_custkey = o_custkey",
    "stmt_in": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)",
    "stmt_right": "SELECT n_name, c_custkey FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9500",
    "stmt_full": "SELECT n_name, r_name FROM (SELECT * FROM nation WHERE n_regionkey < 3) a FULL JOIN (SELECT * FROM region WHERE r_regionkey > 1) b ON n_regionkey = r_regionkey",
    "stmt_cross": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "stmt_using": "SELECT k, a, b FROM (SELECT n_regionkey AS k, count(*) AS a FROM nation GROUP BY n_regionkey) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)",
    "stmt_natural": "SELECT k, a, b FROM (SELECT n_regionkey AS k, count(*) AS a FROM nation GROUP BY n_regionkey) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y",
    "stmt_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "stmt_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "stmt_functions": "SELECT c_custkey, upper(c_mktsegment) AS a, length(c_name) AS b, substring(c_name, 1, 4) AS c, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS d, CASE WHEN c_acctbal < 0 THEN 'low' ELSE 'high' END AS e FROM customer WHERE c_name LIKE '%1%'",
    "stmt_cte_join": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_mktsegment, max(n) AS most, count(*) AS buyers FROM customer JOIN big ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "stmt_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
}


def _register() -> None:
    for f in (relative_quarter, key_probe_orders, text_redact, text_clip, stmt_two_sources):
        QUERIES[f.__name__] = f
    ORACLES["stmt_two_sources"] = "SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderstatus"
    for name, query in {"scan_csv": _from_files("csv"), "scan_csv_gzip": _from_files("csv", compression="gzip"), "scan_ndjson": _from_files("ndjson", compression="bzip2")}.items():
        QUERIES[name] = query
        ORACLES[name] = f"SELECT c_mktsegment AS market_segment, n_name AS customer_nation, date_trunc('year', o_orderdate)::DATE AS period, count(o_orderkey) AS order_count, count(DISTINCT o_custkey) AS customers_ordering FROM {_ORDERS} WHERE {_when('1996-01-01', '1997-01-01', 'o_orderdate')} GROUP BY ALL"
    ORACLES["relative_quarter"] = f"SELECT date_trunc('month', l_shipdate)::DATE AS period, count(l_orderkey) AS line_items FROM lineitem WHERE {_when('1996-04-01', '1996-07-01', 'l_shipdate')} GROUP BY ALL"
    ORACLES["key_probe_orders"] = "SELECT 'orders' AS name, count(o_orderkey) AS n_keys, count(DISTINCT o_orderkey) AS n_distinct FROM orders UNION ALL SELECT 'lineitem', count(*), count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem"
    ORACLES["text_redact"] = "SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)idiot|clown', '***', 'g'), '[0-9]+', '#', 'g') AS text FROM documents"
    ORACLES["text_clip"] = "SELECT doc_id, CASE WHEN strlen(text) <= 256 THEN text ELSE substr(text, 1, 60) || '...[truncated]' END AS text FROM documents"
    for name, text in _STATEMENTS.items():
        QUERIES[name], ORACLES[name] = _statement(text), text
    masked_text = "SELECT lang, count(*) AS n, min(text) AS least FROM documents d WHERE text LIKE '%***%' GROUP BY lang"
    QUERIES["stmt_masked_search"], ORACLES["stmt_masked_search"] = _statement(masked_text), masked_text.replace("documents d", _MASKED)


_register()
