"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The bounds of a task: components of its group of queries and of its shard (8 bytes each), and scores held at once.
QUERY_CELLS, SHARD_CELLS, SCORE_CELLS = 8_000_000, 8_000_000, 4_000_000
#: Shards at least, so that small tables are spread too.
LEAST_SHARDS = 64


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """id, v array<double>: floor(scale * x) of each component. Null ids, null vectors and vectors with null or
    non-finite components are left out."""
    v = F.transform(F.col("embedding"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    whole = F.forall(F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    v = table.column("v").combine_chunks()
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products: in float64 where that is exact, else in Python's integers, held to the range of a long."""
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(c).max(initial=0) < 2.0**53:
        return (q @ c.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(q) @ exact(c).T, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of a row's k best: by score, ties to the smaller id; each id once, the query's own never."""
    spare = k + 1
    while True:
        if spare < len(scores):
            places = np.flatnonzero(scores >= np.partition(scores, len(scores) - spare)[len(scores) - spare])
        else:
            places = np.arange(len(scores))
        places = places[np.lexsort((ids[places], -scores[places]))]
        _, first = np.unique(ids[places], return_index=True)
        places = places[np.sort(first)]
        places = places[ids[places] != own][:k]
        if len(places) == k or spare >= len(scores):
            return places
        spare *= 4


def _ranked(tops: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each value of the keys, each vec_id once; the rows are dealt by the keys already."""
    own = tops.groupBy(*keys, "vec_id").agg(F.max("score").alias("score"))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest inner product for every query; both sides (id, v).

    The grid: queries fall into groups by hashed id and candidates into shards, each of a bounded number of components
    however long the vectors are, and one task multiplies one group by one shard in tiles and selects each tile's best.
    Rows of a candidate's id are dealt over shards by the scan's partition too, so that an id that repeats fills no shard.
    A query gets k rows from each shard; those merge in two levels, first among neighbouring shards, so that no merge sees
    more than a root of them. Ties go to the smaller vec_id, fewer than k candidates give fewer rows, an id that repeats
    counts once with its best score (as query: the best of its rows), scores are held to the range of a long, vectors are
    compared with those of their own length only; empty tables give no rows.
    """
    sizes = [x.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first() for x in (queries, candidates)]
    groups, shards = (ceil(x["n"] * (x["dims"] or 0) / cells) for x, cells in zip(sizes, (QUERY_CELLS, SHARD_CELLS), strict=True))
    groups, shards = max(1, groups), max(LEAST_SHARDS, shards)
    span = max(1, round(shards**0.5))
    left = queries.select("id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    spread = F.pmod(F.xxhash64("id", F.spark_partition_id()), F.lit(shards)).cast("int")
    dealt = candidates.select(F.col("id").alias("id"), F.col("v").alias("v"), spread.alias("shard"))  # names of their own: both sides are often one table
    right = dealt.select("id", "v", F.size("v").alias("dims"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), "shard")

    def multiply(q: pa.Table, c: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "shard": [], "vec_id": [], "score": []}
        if len(q) and len(c):
            (q_ids, q_rows), (c_ids, c_rows) = _matrix(q), _matrix(c)
            shard, step = c.column("shard")[0].as_py(), max(1, SCORE_CELLS // len(c_ids))
            for at in range(0, len(q_ids), step):
                scores = _products(q_rows[at : at + step], c_rows)
                for own, row in zip(q_ids[at : at + step], scores, strict=True):
                    places = _best(row, c_ids, own, k)
                    found["query_id"].append(np.full(len(places), own))
                    found["shard"].append(np.full(len(places), shard))
                    found["vec_id"].append(c_ids[places])
                    found["score"].append(row[places])
        kinds = {"query_id": pa.int64(), "shard": pa.int32(), "vec_id": pa.int64(), "score": pa.int64()}
        return pa.table({n: pa.array(np.concatenate(found[n]) if found[n] else [], t) for n, t in kinds.items()})

    keys = ["dims", "group", "shard"]
    tops = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiply, "query_id long, shard int, vec_id long, score long")
    best = tops.withColumn("near", F.floor(F.col("shard") / span)).repartition("query_id", "near")
    best = _ranked(best, ["query_id", "near"], k).drop("rank").repartition("query_id")
    return _ranked(best, ["query_id"], k).select("query_id", "rank", "vec_id", "score")
