"""Small helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import secrets
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Only a local session, whose executor is the driver,
    may go without it; its tables end with the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    return folder or _own_dir()


@cache
def _own_dir() -> str:
    folder = tempfile.mkdtemp(prefix="checkpoint")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


def secret(spark: SparkSession, name: str = "spark.tallyloom.pii.secret") -> str:
    """The key of the pseudonyms from the session's settings; unless set, one is drawn that lasts as long as the session, so that
    nobody can undo them and values stay linked within the run."""
    key = spark.conf.get(name, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(name, key)
    return key


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes `df` as a table in the shared folder and reads it again, so that lost executors lose nothing. The
    tables of an operator that returns a plan stay for it, until the folder is emptied or `forget` is called."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `materialize` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """`name`, or with underscores as many as keep it apart from the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_memory: dict = {}


def memory(name: object, make):
    """What a Python process remembers between batches and tasks, such as hashed words: of one operator at a time, so that
    a worker that serves one stage after another does not gather all of theirs."""
    if name not in _memory:
        _memory.clear()
        _memory[name] = make()
    return _memory[name]


#: Rows that a Python worker gets at a time; texts are long, and Spark's own 10,000 would be bounded by nothing else.
BATCH_ROWS = 500


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow in batches of at most BATCH_ROWS rows; for that it lowers the session's setting, if that is higher."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)
