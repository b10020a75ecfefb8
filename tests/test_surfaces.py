"""Statements, authored expressions, text policies, files, partitioned reads and streams."""

import bz2
import gzip
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import expression
from tallyloom.functions.text import checked, masked
from tallyloom.model import Measure, Term, TextPolicy
from tallyloom.plans import statement
from tallyloom.refusal import Refusal
from tallyloom.sources import files, jdbc
from tallyloom.streaming import rolled_up


@pytest.fixture(scope="module")
def frames(spark):
    a = spark.createDataFrame([(1, "east"), (2, "west"), (3, None)], "id long, region string")
    b = spark.createDataFrame([("east", "sales"), ("west", "care")], "region string, area string")
    return {"dim_customer": a, "dim_region": b}


def test_statements_run(spark, frames):
    run = lambda text: sorted(map(tuple, statement.run(spark, text, frames).collect()), key=str)
    assert run("SELECT c.id, r.area FROM dim_customer c JOIN dim_region r ON c.region = r.region") == [(1, "sales"), (2, "care")]
    assert run("WITH x AS (SELECT id FROM dim_customer) SELECT max(id) FROM x") == [(3,)]
    assert run("SELECT id FROM dim_customer d WHERE EXISTS (SELECT 1 FROM dim_region r WHERE r.region = d.region)") == [(1,), (2,)]
    assert run("SELECT region FROM dim_customer INTERSECT SELECT region FROM dim_region") == [("east",), ("west",)]


@pytest.mark.parametrize(
    ("code", "text"),
    [
        ("not_read_only", "DROP TABLE dim_customer"), ("not_read_only", "INSERT INTO dim_customer VALUES (1, 'x')"), ("not_read_only", "CREATE VIEW v AS SELECT 1"),
        ("not_read_only", "SET x = 1"), ("unknown_table", "SELECT * FROM secrets"), ("unknown_table", "SELECT * FROM other.dim_customer"), ("select_without_table", "SELECT 1"),
        ("table_function", "SELECT * FROM range(10)"), ("table_function", "SELECT x FROM dim_customer LATERAL VIEW explode(array(1)) t AS x"),
        ("recursive_cte", "WITH RECURSIVE t(n) AS (SELECT id FROM dim_customer UNION ALL SELECT n + 1 FROM t WHERE n < 3) SELECT n FROM t"),
        ("construct_not_allowed", "SELECT repeat(region, 1000) FROM dim_customer"), ("construct_not_allowed", "SELECT id FROM dim_customer; SELECT 1"),
        ("unknown_table", "SELECT (SELECT max(x) FROM secrets) FROM dim_customer"), ("unknown_table", "SELECT id FROM dim_customer WHERE id IN (SELECT id FROM secrets)"),
        ("unknown_table", "SELECT * FROM parquet.`/etc`"), ("exists_in_projection", "SELECT EXISTS (SELECT 1 FROM dim_region) FROM dim_customer"),
        ("construct_not_allowed", "SELECT s.id FROM dim_customer, IDENTIFIER('parquet.`/etc`') s"), ("construct_not_allowed", "SELECT s.id FROM dim_customer, IDENTIFIER('secret_t') s"),
        ("construct_not_allowed", "SELECT IDENTIFIER('i' || 'd') FROM dim_customer"), ("construct_not_allowed", "SELECT array_join(array_repeat(region, 1000000), '') FROM dim_customer"),
        ("construct_not_allowed", "SELECT d.id FROM dim_customer d JOIN (VALUES (1)) v(x) ON d.id = v.x"), ("construct_not_allowed", "SELECT java_method('java.lang.System', 'exit') FROM dim_customer"),
        ("construct_not_allowed", "SELECT transform(array(id), x -> x) FROM dim_customer"), ("construct_not_allowed", "SELECT _metadata.file_path.x[1] FROM dim_customer"),
        ("statement_too_long", "SELECT id FROM dim_customer -- " + "x" * 70_000), ("expression_too_large", "SELECT id" + " + 1" * 1100 + " FROM dim_customer"),
    ],
)
def test_statements_refused(spark, frames, code, text):
    with pytest.raises(Refusal) as e:
        statement.run(spark, text, frames)
    assert e.value.code == code


def test_a_view_of_the_caller_is_not_seen(spark, frames):
    spark.range(1).createOrReplaceTempView("hidden")
    with pytest.raises(Refusal, match="unknown_table"):
        statement.run(spark, "SELECT * FROM hidden", frames)


def test_masks(spark):
    df = spark.createDataFrame([("a secretzzpace1 b",), ("é" * 100,), (None,)], "t string")
    got = [r[0] for r in df.select(masked(F.col("t"), TextPolicy((("secret[^[:space:]]*", "***"),), 64))).collect()]
    assert got == ["a *** b", "é" * 12 + "...[truncated]", None]
    for bad in (TextPolicy((("(?=x)", "y"),)), TextPolicy((("x", "$1"),)), TextPolicy(((r"(a)\1", "x"),)), TextPolicy((), 8), TextPolicy((("[[:nope:]]", "x"),)), TextPolicy((("a", "b"),) * 9)):
        with pytest.raises(Refusal, match="text_policy_refused"):
            checked(bad)


@pytest.mark.parametrize("text", ["SUM(a) / NULLIF(SUM(b), 0)", "MEDIAN(a)", "UNIQEXACT(a)", "SUM_IF(a, b > 1)", "COUNTIF(b > 1)", "ROUND(AVG(a), 2)", "PERCENTILE_DISC(0.5) WITHIN GROUP (ORDER BY a)", "MAX(a) - MIN(a)", "SUM(CASE WHEN b > 1 THEN a ELSE 0 END)", "STDDEV_POP(a)", "COALESCE(SUM(a), 0)", "LIST(a)"])
def test_authored_allowed(spark, text):
    df = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    assert df.agg(expression.measure(spark, text, {"a", "b"})).count() == 1


@pytest.mark.parametrize("text", ["a", "SUM(c)", "SUM(a) / SUM(b)", "(SELECT 1)", "COUNT(*)", "getenv('X')", "SUM(a) -- x", "SUM(t.a)", "SUM(a) OVER ()", "DATE_TRUNC('day', MAX(a))", "SUM(a) FILTER (WHERE b > 1)", "SUM(é)", "NOW()", "SUM(SUM(a))", "SUM(a) DIV 2", "SUM(a IS TRUE)", "a + SUM(b)", "SUM(a) x y", "SUM(?)", "1"])
def test_authored_refused(spark, text):
    with pytest.raises(Refusal, match="expression_refused"):
        expression.measure(spark, text, {"a", "b"})


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,b\n")
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"x,y\n2,c\n"))
    (tmp_path / "c.ndjson.bz2").write_bytes(bz2.compress(b'{"x": 3}\n'))
    (tmp_path / "d.csv.xz").write_bytes(b"")
    spark.range(4).toDF("x").write.parquet(str(tmp_path / "a.parquet"))
    assert files.attached(spark, str(tmp_path), "a").count() == 4
    assert files.attached(spark, str(tmp_path), "b").first()["x"] == 2
    assert files.attached(spark, str(tmp_path), "c").first()["x"] == 3
    for table, code in (("d", "unsupported_codec"), ("e", "missing_table"), ("s.a", "missing_table")):
        with pytest.raises(Refusal, match=code):
            files.attached(spark, str(tmp_path), table)


def test_partitioned_reads():
    assert jdbc.parts_of(2_000_001) == 3 and jdbc.parts_of(0) == 1
    assert jdbc.hash_buckets(["a"], 2)[1].endswith("= 1") and "COALESCE" in jdbc.hash_buckets(["a"], 2)[0]
    ranges = jdbc.page_ranges(10, 3)
    assert len(ranges) == 3 and "<" not in ranges[-1].replace("'", "")


def test_stream_rolls_up_weeks(spark, tmp_path):
    rows = [(datetime(2026, 1, d), d % 2, d) for d in range(1, 20)]
    spark.createDataFrame(rows, "ts timestamp, k int, v int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k int, v int").parquet(str(tmp_path / "in"))
    out = rolled_up(stream, "ts", "week", {"total": Measure(Term("sum", "v"))}, ("k",))
    q = out.writeStream.format("memory").queryName("rolled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["k"], r["period"]): int(r["total"]) for r in spark.table("rolled").collect()}
    assert got[1, date(2025, 12, 29)] == 1 + 3 and got[0, date(2026, 1, 5)] == 6 + 8 + 10
    with pytest.raises(Refusal):
        rolled_up(stream, "ts", "week", {"n": Measure(Term("count_distinct", "v"))})


def test_importers(spark):
    from tallyloom.catalog import importers

    columns = [("orders", "id", "bigint", "NO", 1), ("orders", "cust", "bigint", "YES", 2), ("cust", "id", "bigint", "NO", 1), ("tmp_x", "id", "bigint", "NO", 1)]
    keys = [("fk1", "orders", "cust", "cust", "id", 1), ("fk2", "orders", "id", "tmp_x", "id", 1)]
    c = importers.from_dictionary(
        spark.createDataFrame(columns, "table_name string, column_name string, data_type string, is_nullable string, ordinal_position int"),
        spark.createDataFrame(keys, "constraint_name string, table_name string, column_name string, target_table string, target_column string, ordinal_position int"), "db", exclude=("tmp_*", "[c]ust"),
    )
    assert set(c.models) == {"orders", "cust"} and set(c.relationships) == {"fk1"} and not c.models["orders"].columns["id"].nullable
    c = importers.from_data_contract("schema:\n  - name: t\n    properties:\n      - {name: a, logicalType: integer, primaryKey: true, description: key}\n", "db")
    assert c.models["t"].primary_key == ("a",) and importers.capabilities(c) == {"structure", "primary_keys", "column_descriptions"}
    manifest = {
        "models": [{"name": "o", "primaryKey": "id", "columns": [{"name": "id"}, {"name": "c"}, {"name": "v"}, {"name": "d"}]}, {"name": "c", "columns": [{"name": "id"}]}],
        "relationships": [{"name": "r", "models": ["c", "o"], "joinType": "one_to_many", "condition": "c.id = o.c"}],
        "cubes": [{"name": "x", "baseObject": "o", "timeDimensions": [{"name": "d", "expression": "d"}], "dimensions": [{"name": "who", "expression": "c"}], "measures": [{"name": "total", "expression": "SUM(v)"}, {"name": "ids", "expression": "count(distinct id)"}]}],
    }
    c = importers.from_manifest(manifest, "db")
    assert c.relationships["r"].origin == "o" and c.relationships["r"].keys[0].origin == "c" and c.metrics["ids"].measure.numerator.aggregate == "count_distinct"
    manifest["relationships"][0]["condition"] = "c.id = o.c OR 1"
    with pytest.raises(Refusal, match="invalid_definition"):
        importers.from_manifest(manifest, "db")


def test_deadline_and_budgets(spark):
    from tallyloom.engine import Answer, told_by
    from tallyloom.model import Limits

    slow = spark.range(10**12).selectExpr("sum((id % 7) * (id % 11)) AS s")
    with pytest.raises(Refusal, match="deadline_exceeded"):
        Answer(slow, "", Limits(seconds=1.5)).rows()
    with pytest.raises(Refusal, match="budget_exhausted"):
        Answer(spark.range(10**6), "", Limits(scan_bytes=1000)).rows()
    with pytest.raises(Refusal, match="too_many_rows"):
        Answer(spark.range(1000), "", Limits(rows=10), "too_many_rows").rows()
    with pytest.raises(Refusal, match="resources_exhausted"):
        raise told_by(RuntimeError("java.lang.OutOfMemoryError: Java heap space"))
    assert told_by(RuntimeError("else")) is None
    with pytest.raises(Refusal, match="result_too_large"):
        Answer(spark.range(1000), "", Limits(answer_bytes=1000)).rows()
    assert len(Answer(spark.range(3), "", Limits()).rows()) == 3


def test_declared_schemas_and_csv(spark, tmp_path):
    from tallyloom.model import Column

    (tmp_path / "x.csv").write_text("a,b\n1,2.50\nz,1\n")
    schema = files.declared({"a": Column("a", "BIGINT"), "b": Column("b", "NUMERIC(10,2)"), "c": Column("c", "TEXT")})
    assert [f.dataType.simpleString() for f in schema] == ["bigint", "decimal(10,2)", "string"]
    with pytest.raises(Refusal, match="invalid_definition"):
        files.declared({"c": Column("c", "GEOMETRY")})
    with pytest.raises(Exception, match="MALFORMED"):
        files.csv(spark, str(tmp_path / "x.csv"), files.T.StructType(schema.fields[:2])).collect()
