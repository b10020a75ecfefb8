"""The corpus pipeline: toxic documents, near-duplicates and benchmark leaks go, personal data get pseudonyms, the rest is packed.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. Models and indexes come from the
tables in sf_dir. All but the last stage return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontam, neardup, packing, pii, toxicity
from tallyloom.llm.common import materialize, secret, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the labels of the given documents outside the held-out fold; those it rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, predicted = unused(docs, "score"), unused(docs, "predicted")
    return toxicity.scored(docs, model, score, predicted).filter(F.col(predicted) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class one row stays, of the smallest id (null last); equal texts without words are a class. Rows are told
    apart by an id of their own, so ids may repeat or be null. Rows with null text stay."""
    row = unused(docs, "row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    found = neardup.classes(rows.select(F.col(row).alias("doc_id"), "text"), wordless=True).select(F.col("doc_id").alias(row), "class_id")
    ids = rows.select(row, F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row")).alias("place"))
    first = found.join(ids, row).groupBy("class_id").agg(F.min("place").alias("place")).select(F.col("place")["row"].alias(row))
    return rows.join(first, row, "left_semi").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = unused(docs, "leaks")
    return decontam.marked(docs, table(spark, sf_dir, "benchmark"), leaks).filter(F.size(leaks) == 0).select(*docs.columns)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the new text."""
    return pii.pseudonymized(docs, secret(spark), unused(docs, "n_pseudonyms")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digested(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pseudonyms", pseudonymize),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
