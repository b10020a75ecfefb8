"""Every query of the metrics engine against its SQL twin in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tallyloom.demo import queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if pd.isna(v):
        return None
    if hasattr(v, "year"):
        return str(v)[:10]
    return f"{float(v):.12e}" if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "-") in "if" else v


def rows(df):
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_twin(spark, duck, name):
    got, want = queries.QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries.QUERIES["filter_equals"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "l_shipdate" in plan.split("PushedFilters")[1].split("]")[0]
    assert "l_tax" not in plan and "l_discount" not in plan


def test_no_python_in_the_plans(spark):
    for name in ("revenue_per_order", "stacked_two_facts", "fed_distinct_pullup", "stmt_masked_search"):
        plan = queries.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
