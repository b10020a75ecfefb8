"""Tables in files, looked up by name and suffix through Spark's own file systems."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..refusal import Refusal

#: Codecs that Spark's text readers open by suffix; `.xz` it would read as text.
CODECS = ("", ".gz", ".bz2", ".zst")
#: Suffixes that are refused by name.
REFUSED = (".xz", ".lz4", ".zip", ".7z", ".br", ".lzma", ".snappy", ".Z")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def attached(spark: SparkSession, folder: str, table: str, columns: dict | None = None) -> DataFrame:
    """`T.parquet`, then `T.csv` and `T.ndjson`, each plain or with a codec's suffix; the first that exists. With the model's
    `columns` a CSV file whose header names just those is read in one pass with their declared types, else types are inferred."""
    if "." in table or "/" in table:
        raise Refusal("missing_table", f"a file's table takes no qualifier: {table}")
    base = f"{folder.rstrip('/')}/{table}"
    if _exists(spark, f"{base}.parquet"):
        return spark.read.parquet(f"{base}.parquet")
    for suffix in (".csv", ".ndjson"):
        for codec in CODECS:
            if _exists(spark, path := f"{base}{suffix}{codec}"):
                if suffix == ".ndjson":
                    return spark.read.json(path)
                header = spark.read.option("header", True).csv(path).columns if columns else []
                return csv(spark, path, declared({c: columns[c] for c in header}) if columns and set(header) == set(columns) else None)
        for codec in REFUSED:
            if _exists(spark, f"{base}{suffix}{codec}"):
                raise Refusal("unsupported_codec", f"{table}{suffix}{codec}")
    for codec in (*CODECS[1:], *REFUSED):
        if _exists(spark, f"{base}.parquet{codec}"):
            raise Refusal("unsupported_codec", f"{table}.parquet{codec}")
    raise Refusal("missing_table", table)


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """With a header; types are inferred unless declared, and then a value that does not fit fails the read."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).option("mode", "FAILFAST").csv(path) if schema else reader.option("inferSchema", True).csv(path)


def declared(model_columns: dict) -> T.StructType:
    """The Spark schema of declared column types; an unknown type is refused."""
    simple = {
        "BIGINT": T.LongType(), "INTEGER": T.IntegerType(), "INT": T.IntegerType(), "SMALLINT": T.ShortType(), "DOUBLE": T.DoubleType(),
        "FLOAT": T.FloatType(), "REAL": T.FloatType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(),
        "BINARY": T.BinaryType(), "VARCHAR": T.StringType(), "TEXT": T.StringType(), "STRING": T.StringType(), "NUMERIC": T.DecimalType(38, 0), "DECIMAL": T.DecimalType(38, 0), "CHAR": T.StringType(), "UUID": T.StringType(), "TIMESTAMPTZ": T.TimestampType(),
    }

    def of(text: str) -> T.DataType:
        if m := re.fullmatch(r"(?:DECIMAL|NUMERIC)\((\d+),\s*(\d+)\)", text.upper()):
            return T.DecimalType(min(38, int(m[1])), int(m[2]))
        plain = re.sub(r"\(.*", "", text.upper()).strip()
        if plain not in simple:
            raise Refusal("invalid_definition", f"column type {text}")
        return simple[plain]

    return T.StructType([T.StructField(c.name, of(c.type), c.nullable) for c in model_columns.values()])
