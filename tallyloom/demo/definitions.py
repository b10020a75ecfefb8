"""The catalog's documents and the tables beneath it. With `split`, dimensions live in a source of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import documents
from ..engine import Engine
from ..model import Catalog

_LINE_DIMENSIONS = """
dimensions:
  - {name: return_flag, column: l_returnflag, values: [A, N, R]}
  - {name: line_status, column: l_linestatus, values: [F, O]}
  - {name: order_priority, column: o_orderpriority, via: lineitem_order}
  - {name: market_segment, column: c_mktsegment, via: [lineitem_order, order_customer], values: [AUTOMOBILE, BUILDING, FURNITURE, HOUSEHOLD, MACHINERY]}
  - {name: customer_nation, column: n_name, via: [lineitem_order, order_customer, customer_nation]}
  - {name: customer_region, column: r_name, via: [lineitem_order, order_customer, customer_nation, nation_region]}
  - {name: part_type, column: p_type, via: lineitem_part}
  - {name: brand, column: p_brand, via: lineitem_part}
  - {name: supplier_name, column: s_name, via: lineitem_supplier}
"""
_ORDER_DIMENSIONS = """
dimensions:
  - {name: order_priority, column: o_orderpriority}
  - {name: order_status, column: o_orderstatus, values: [F, O, P]}
  - {name: market_segment, column: c_mktsegment, via: order_customer, values: [AUTOMOBILE, BUILDING, FURNITURE, HOUSEHOLD, MACHINERY]}
  - {name: customer_nation, column: n_name, via: [order_customer, customer_nation]}
"""
_MODELS = {
    "lineitem": ("lake", "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DECIMAL, l_extendedprice DECIMAL, l_discount DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP, returned BOOLEAN"),
    "orders": ("lake", "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DECIMAL, o_orderdate TIMESTAMP, o_orderpriority VARCHAR"),
    "events": ("lake", "event_id BIGINT, user_id BIGINT, ts TIMESTAMP, event_type VARCHAR, value DOUBLE"),
    "monthly": ("lake", "m_month DATE, m_type VARCHAR, m_label VARCHAR"),
    "customer": ("crm", "c_custkey BIGINT, c_nationkey INTEGER, c_mktsegment VARCHAR"),
    "part": ("crm", "p_partkey BIGINT, p_brand VARCHAR, p_type VARCHAR"),
    "supplier": ("crm", "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER"),
    "nation": ("crm", "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER"),
    "region": ("crm", "r_regionkey INTEGER, r_name VARCHAR"),
    "calendar": ("lake", "day DATE"),
}
_LINKS = {
    "lineitem_order": "lineitem.l_orderkey orders.o_orderkey", "lineitem_part": "lineitem.l_partkey part.p_partkey",
    "lineitem_supplier": "lineitem.l_suppkey supplier.s_suppkey", "order_customer": "orders.o_custkey customer.c_custkey",
    "customer_nation": "customer.c_nationkey nation.n_nationkey", "nation_region": "nation.n_regionkey region.r_regionkey",
}
#: name: (model, measure, required filters, time column)
_LINE = {
    "line_items": ("simple: {aggregate: count, column: l_orderkey}", ""),
    "gross_revenue": ("simple: {aggregate: sum, column: l_extendedprice}", ""),
    "quantity_shipped": ("simple: {aggregate: sum, column: l_quantity}", ""),
    "returned_revenue": ("simple: {aggregate: sum, column: l_extendedprice}", "required_filters: [{equals: {column: l_returnflag, value: R}}]"),
    "kept_lines": ("simple: {aggregate: count, column: l_orderkey}", "required_filters: [{not_equals: {column: l_returnflag, value: R}}, {is_not_null: l_partkey}]"),
    "flagged_lines": ("simple: {aggregate: count, column: l_orderkey}", "required_filters: [{is_true: returned}]"),
    "average_quantity": ("simple: {aggregate: avg, column: l_quantity}", ""),
    "orders_shipped": ("simple: {aggregate: count_distinct, column: l_orderkey}", ""),
    "smallest_line": ("simple: {aggregate: min, column: l_extendedprice}", ""),
    "largest_line": ("simple: {aggregate: max, column: l_extendedprice}", ""),
    "returned_lines": ("simple: {count_if: returned}", ""),
    "return_rate": ("ratio: {numerator: {count_if: returned}, denominator: {aggregate: count, column: l_orderkey}, zero_denominator: yields_null}", ""),
    "lines_per_return": ("ratio: {numerator: {aggregate: count, column: l_orderkey}, denominator: {count_if: returned}, zero_denominator: fails}", ""),
    "revenue_per_order": ("ratio: {numerator: {aggregate: sum, column: l_extendedprice}, denominator: {aggregate: count_distinct, column: l_orderkey}, zero_denominator: yields_null}", ""),
    "revenue_per_return": ("ratio: {numerator: {aggregate: sum, column: l_extendedprice}, denominator: {count_if: returned}, zero_denominator: yields_null}", ""),
}
_ORDER = {
    "order_count": ("simple: {aggregate: count, column: o_orderkey}", ""),
    "order_value": ("simple: {aggregate: sum, column: o_totalprice}", ""),
    "customers_ordering": ("simple: {aggregate: count_distinct, column: o_custkey}", ""),
}
_AUTHORED = {
    "median_price": "PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY l_quantity)",
    "quantity_spread": "MAX(l_quantity) - MIN(l_quantity)",
    "net_share": "CAST(SUM(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS DOUBLE) / NULLIF(SUM(l_quantity), 0)",
}
#: One authored measure for each function that they may call.
EACH = {
    "avg": "ROUND(AVG(CAST(l_quantity AS DOUBLE)), 4)", "count": "COUNT(l_orderkey)", "countif": "COUNTIF(l_quantity > 25)", "count_if": "COUNT_IF(l_quantity > 25)",
    "max": "CAST(MAX(l_quantity) AS DOUBLE)", "min": "CAST(MIN(l_quantity) AS DOUBLE)", "median": "MEDIAN(CAST(l_quantity AS DOUBLE))", "sum": "CAST(SUM(l_quantity) AS DOUBLE)",
    "percentile_disc": "PERCENTILE_DISC(0.25) WITHIN GROUP (ORDER BY CAST(l_quantity AS DOUBLE))", "sumif": "CAST(SUMIF(l_quantity, l_quantity > 10) AS DOUBLE)",
    "sum_if": "CAST(SUM_IF(l_quantity, l_quantity <= 10) AS DOUBLE)", "uniqexact": "UNIQEXACT(l_suppkey)", "stddev": "ROUND(STDDEV(CAST(l_quantity AS DOUBLE)), 6)",
    "stddev_pop": "ROUND(STDDEV_POP(CAST(l_quantity AS DOUBLE)), 6)", "stddev_samp": "ROUND(STDDEV_SAMP(CAST(l_quantity AS DOUBLE)), 6)", "variance": "ROUND(VARIANCE(CAST(l_quantity AS DOUBLE)), 6)",
    "var_pop": "ROUND(VAR_POP(CAST(l_quantity AS DOUBLE)), 6)", "var_samp": "ROUND(VAR_SAMP(CAST(l_quantity AS DOUBLE)), 6)", "abs": "ABS(COUNT(l_orderkey) - 5000)",
    "coalesce": "COALESCE(SUM(l_linenumber), 0)", "greatest": "GREATEST(COUNT(l_orderkey), 100)", "least": "LEAST(COUNT(l_orderkey), 100)", "nullif": "NULLIF(COUNT(l_orderkey), 0)",
    "try_cast": "TRY_CAST(COUNT(l_orderkey) AS DOUBLE)",
}
_OTHER = """
---
kind: relationship
name: lineitem_calendar
origin: {model: lineitem}
target: {model: calendar}
keys: [{origin: l_shipdate, grain: day, target: day}]
---
===
---
kind: relationship
name: orders_calendar
origin: {model: orders}
target: {model: calendar}
keys: [{origin: o_orderdate, grain: day, target: day}]
---
===
---
kind: relationship
name: event_month
origin: {model: events}
target: {model: monthly}
keys: [{origin: ts, grain: month, target: m_month}, {origin: event_type, target: m_type}]
---
===
---
kind: metric
name: revenue_per_order_placed
model: lineitem
measure:
  ratio:
    numerator: {aggregate: sum, column: l_extendedprice}
    denominator: {aggregate: count, column: o_orderkey, model: orders}
    zero_denominator: yields_null
calendars: {lineitem: lineitem_calendar, orders: orders_calendar}
time_column: day
grains: [day, week, month, quarter, year]
dimensions:
  - {name: market_segment, column: c_mktsegment, via: [lineitem_order, order_customer], second_via: [order_customer]}
---
===
---
kind: cube
name: traffic
model: events
time_column: ts
grains: [day, week, month]
dimensions:
  - {name: event_type, column: event_type, values: [click, view, purchase, signup]}
  - {name: month_label, column: m_label, via: event_month}
measures:
  - {name: event_count, measure: {simple: {aggregate: count, column: event_id}}}
  - {name: users_seen, measure: {simple: {aggregate: count_distinct, column: user_id}}}
---
===
---
kind: caveat
name: revenue_is_gross
about: [{metric: gross_revenue}]
---
Before discounts.
"""


def texts(split: bool = False) -> list[str]:
    out = []
    for name, (source, columns) in _MODELS.items():
        own = "".join(f"\n  - {{name: {c.split()[0]}, type: {c.split()[1]}}}" for c in columns.split(", "))
        out.append(f"---\nkind: model\nname: {name}\nsource: {source if split else 'lake'}\ntable: {name}\ncolumns:{own}\n---\n")
    for name, ends in _LINKS.items():
        (a, x), (b, y) = (e.split(".") for e in ends.split())
        out.append(f"---\nkind: relationship\nname: {name}\norigin: {{model: {a}, column: {x}}}\ntarget: {{model: {b}, column: {y}}}\n---\n")
    for model, time, dims, group in (("lineitem", "l_shipdate", _LINE_DIMENSIONS, _LINE), ("orders", "o_orderdate", _ORDER_DIMENSIONS, _ORDER)):
        for name, (measure, required) in group.items():
            out.append(f"---\nkind: metric\nname: {name}\nmodel: {model}\nmeasure: {{{measure}}}\n{required}\ntime_column: {time}\ngrains: [day, week, month, quarter, year]{dims}---\n")
    for name, text in (_AUTHORED | {f"each_{k}": v for k, v in EACH.items()}).items():
        out.append(f"---\nkind: metric\nname: {name}\nmodel: lineitem\nexpression: \"{text}\"\ntime_column: l_shipdate\ngrains: [month, year]{_LINE_DIMENSIONS}---\n")
    return out + [x.strip() + "\n" for x in _OTHER.split("===")]


def catalog(split: bool = False) -> Catalog:
    return documents.catalog(texts(split))


def tables(spark: SparkSession, sf_dir: str):
    """Money is decimal, so that sums are exact."""
    money = {"lineitem": ("l_quantity", "l_extendedprice"), "orders": ("o_totalprice",)}

    def table(name: str) -> DataFrame:
        if name == "calendar":
            return spark.range(0, 366 * 12).select(F.date_add(F.lit("1992-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
        if name == "monthly":
            ts = spark.read.parquet(f"{sf_dir}/events.parquet")
            return ts.select(F.date_trunc("month", "ts").cast("date").alias("m_month"), F.col("event_type").alias("m_type")).distinct().withColumn("m_label", F.concat_ws(" ", "m_type", F.date_format("m_month", "yyyy-MM")))
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        df = df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in money.get(name, ())})
        return df.withColumn("returned", F.col("l_returnflag") == "R") if name == "lineitem" else df

    return table


def engine(spark: SparkSession, sf_dir: str, split: bool = False) -> Engine:
    place = tables(spark, sf_dir)
    return Engine(spark, catalog(split), {"lake": place, "crm": place})
