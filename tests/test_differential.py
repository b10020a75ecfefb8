"""Random questions, asked of one source and of the same tables split over two: the answers must agree."""

import random
from pathlib import Path

import pytest

from tallyloom.demo.definitions import engine

DATA = "/root/testdata/sf0.001"
METRICS = ["gross_revenue", "line_items", "orders_shipped", "average_quantity", "smallest_line", "largest_line", "returned_lines", "return_rate", "revenue_per_order", "returned_revenue"]
DIMENSIONS = ["return_flag", "line_status", "order_priority", "market_segment", "customer_nation", "customer_region", "part_type", "supplier_name"]


def asked(seed):
    rng = random.Random(seed)
    year = rng.randrange(1995, 2000)
    q = {"metrics": rng.sample(METRICS, rng.choice([1, 1, 2])), "grain": rng.choice(["week", "month", "quarter", "year"]), "range": {"start": f"{year}-0{rng.randrange(1, 7)}-15", "end": f"{year + 1}-02-01"}}
    q["dimensions"] = rng.sample(DIMENSIONS, rng.randrange(0, 3))
    if rng.random() < 0.6:
        name, values = rng.choice([("return_flag", ["A", "N", "R"]), ("market_segment", ["AUTOMOBILE", "BUILDING", "FURNITURE"])])
        op = rng.choice(["equals", "not_equals", "in", "not_in"])
        q["filters"] = [{"dimension": name, "op": op, "values": rng.sample(values, 1 if "equals" in op else 2)}]
    if rng.random() < 0.4:
        q["top"] = {"n": rng.randrange(1, 8), "by": rng.choice(["metric", "period"]), "direction": rng.choice(["asc", "desc"])}
    return q


def cells(rows):
    return [tuple(f"{float(v):.12e}" if isinstance(v, float) else v for v in r) for r in rows]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("seed", range(14))
def test_whole_and_split_agree(spark, seed):
    q = asked(seed)
    assert cells(engine(spark, DATA, False).ask(q).rows()) == cells(engine(spark, DATA, True).ask(q).rows())
