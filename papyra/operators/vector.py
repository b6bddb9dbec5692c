"""Exact top-k over vector tables for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: queries held by a task at a time
BLOCK = 2048


def _partial(shared, k: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, q2 = shared.value
        best_s = np.full((len(qids), 0), -np.inf)
        best_i = np.empty((len(qids), 0), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            s = q @ x.T
            if metric == "l2":
                s = -(q2[:, None] + (x * x).sum(1)[None] - 2 * s)
            elif metric == "cosine":
                s = s / np.maximum(np.sqrt(q2)[:, None] * np.linalg.norm(x, axis=1)[None], 1e-12)
            best_s = np.concatenate([best_s, s], axis=1)
            best_i = np.concatenate([best_i, np.broadcast_to(ids, s.shape)], axis=1)
            if best_s.shape[1] > k:
                # ties go to the smaller id, as rounded scores decide in the end
                order = np.lexsort((best_i, -np.round(best_s, 6)), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
        n = best_s.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(best_i.ravel()), pa.array(best_s.ravel())], ["qid", "id", "score"])

    return run


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", keep_self: bool = False) -> DataFrame:
    """``(qid, id, score, rank)``: the k best vectors for each query, by cosine, inner product (dot) or negated squared
    distance (l2), scores rounded to 6 digits, ties by id.

    ``vectors``: id long, v array of equal length, nulls left out; filters on it apply before ranking. ``queries``: qid, v.
    Queries are taken a block at a time, each block against the whole table; a task keeps k rows a query, and only these
    are shuffled.
    """
    spark = vectors.sparkSession
    rows = vectors.select("id", F.col("v").cast("array<float>").alias("v")).where("id is not null and v is not null")
    out, block = None, []

    def flush(block: list) -> DataFrame:
        q = np.array([r.v for r in block], np.float64)
        shared = spark.sparkContext.broadcast((np.array([r.qid for r in block], np.int64), q, (q * q).sum(1)))
        return rows.mapInArrow(_partial(shared, k + (0 if keep_self else 1), metric), "qid long, id long, score double")

    for r in queries.select("qid", F.col("v").cast("array<float>").alias("v")).where("v is not null").toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            part, block = flush(block), []
            out = part if out is None else out.unionByName(part)
    if block:
        part = flush(block)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "qid long, id long, score double, rank int")
    if not keep_self:
        out = out.where("qid <> id")
    out = out.withColumn("score", F.round("score", 6) + F.lit(0.0))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a, b):
    """Inner product of two array columns, for single rows; batches are faster through ``vector_topk``."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v, least: float = 1e-12):
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(least)))
