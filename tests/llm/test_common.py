import pyarrow as pa

from tallyloom.llm import common


def test_tables_are_written_to_the_shared_folder_and_read_back(spark):
    df = spark.range(10).selectExpr("id", "cast(null as string) AS t")
    again = common.materialize(df)
    assert again.dtypes == df.dtypes and again.count() == 10
    assert all(f.startswith(common.shared_dir(spark)) or common.shared_dir(spark).removeprefix("file://") in f for f in again.inputFiles())
    common.forget(again)
    assert common.materialize(df.limit(0)).count() == 0


def test_names_that_clash_with_nothing(spark):
    df = spark.createDataFrame([(1, 2)], "Score int, score_ int")
    assert common.unused(df, "score") == "score__" and common.unused(df, "x") == "x"


def test_a_process_remembers_for_one_operator_at_a_time():
    first = common.memory("a", dict)
    assert common.memory("a", dict) is first and common.memory("b", list) == [] and common.memory("a", dict) is not first


def test_batches_are_bounded(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows = common.mapped(spark.range(1, 2001, 1, 2), sizes, "n long").collect()
    assert max(r["n"] for r in rows) == common.BATCH_ROWS and sum(r["n"] for r in rows) == 2000
