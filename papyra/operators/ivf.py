"""Approximate nearest vectors for batches of queries: an inverted file of coarse cells, exact scores within the cells asked."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.lexical import top_per_query
from papyra.storage import small_side, stage


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit vectors."""
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[lo : lo + 4096] @ c.T).argmax(1) for lo in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c.astype(np.float32)


def _unit(column) -> np.ndarray:
    x = np.array(column.to_pylist(), np.float32).reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = (_unit(b.column(1)) @ shared.value.T).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0), b.column(1)], ["cell", "id", "v"])

    return run


def _ask(shared, candidates: int):
    """Each query to its nearest cells, as many as hold ``candidates`` vectors together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, size = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            order = np.argsort(-(_unit(b.column(1)) @ centroids.T), axis=1, kind="stable")
            asked = (np.cumsum(size[order], axis=1) - size[order]) < candidates
            row, at = np.nonzero(asked)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(order[row, at].astype(np.int32)), b.column(0).take(rows), b.column(1).take(rows)], ["cell", "qid", "q"])

    return run


def _score(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        qid, ids = left.column("qid").to_numpy(), right.column("id").to_numpy()
        if not len(qid) or not len(ids):
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x = _unit(right.column("v")).astype(np.float64)
        out: list[tuple] = []
        for lo in range(0, len(qid), 512):
            s = np.round(_unit(left.column("q").slice(lo, 512)).astype(np.float64) @ x.T, 6)
            # of equal scores the smaller ids
            best = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
            out.append((np.repeat(qid[lo : lo + 512], best.shape[1]), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel()))
        q, i, s = (np.concatenate(x) for x in zip(*out))
        return pa.table({"qid": pa.array(q), "id": pa.array(i), "score": pa.array(s + 0.0)})

    return run


def _candidates_for(x: np.ndarray, centroids: np.ndarray, k: int, recall: float, asked: int = 500) -> float:
    """The share of all vectors that a query must look at to meet this share of its k nearest, by brute force in the sample."""
    k = min(k, len(x) - 1)
    if k < 1:
        return 1.0
    home = np.concatenate([(x[lo : lo + 4096] @ centroids.T).argmax(1) for lo in range(0, len(x), 4096)])
    size = np.bincount(home, minlength=len(centroids))
    pick = np.random.default_rng(11).permutation(len(x))[:asked]
    order = np.argsort(-(x[pick] @ centroids.T), axis=1, kind="stable")
    ahead = np.empty(order.shape)
    np.put_along_axis(ahead, order, np.cumsum(size[order], axis=1) - size[order], 1)
    s = x[pick] @ x.T
    s[np.arange(len(pick)), pick] = -2
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(ahead, home[near], 1).ravel())
    return (needed[math.ceil(recall * len(needed)) - 1] + 1) / len(x)


def approximate_topk(vectors: DataFrame, queries: DataFrame, k: int, candidates: int | None = None, recall: float = 0.93, sample_rows: int = 40_000, block_rows: int = 20_000) -> DataFrame:
    """``(qid, id, score, rank)``: the k best of each query by cosine among about ``candidates`` vectors of the cells
    nearest to it: by default max(2 k, 100), or as many as meet the share ``recall`` of the nearest, measured in the sample.

    ``vectors``: id long, v array of equal length, nulls left out; ``queries``: qid long, v. There are about twice the root of
    the number of vectors of cells, fitted on ``sample_rows`` vectors, or ten a cell if these are more, drawn by hash; every
    vector is indexed. Cells of more than ``block_rows`` vectors are searched in blocks. Vectors move once, to their cell."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v")).where("id is not null and v is not null")
    spark = rows.sparkSession
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "qid long, id long, score double, rank int")
    cells = max(1, int(2 * math.sqrt(n)))
    wanted = max(sample_rows, 10 * cells)
    drawn = rows.withColumn("o", F.xxhash64("id")).where(F.pmod("o", F.lit(1_000_000)) < int(min(1.0, 1.1 * wanted / n + 1e-4) * 1_000_000))
    sample = np.array([r.v for r in drawn.orderBy("o", "id").limit(wanted).select("v").collect()], np.float32)
    sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    centroids = spherical_kmeans(sample, cells)
    candidates = candidates or max(2 * k, 100, math.ceil(n * _candidates_for(sample, centroids, k, recall)))
    stored = stage(rows.mapInArrow(_assign(spark.sparkContext.broadcast(centroids)), "cell int, id long, v array<float>"), "ivf-cells")
    # one row a cell
    held = stored.groupBy("cell").count().collect()
    size = np.zeros(len(centroids), np.int64)
    for r in held:
        size[r["cell"]] = r["count"]
    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("v").cast("array<float>").alias("v")).where("qid is not null and v is not null")
    asked = asked.mapInArrow(_ask(spark.sparkContext.broadcast((centroids, size)), candidates), "cell int, qid long, q array<float>")
    blocks = small_side(spark.createDataFrame([(c, int(-(-m // block_rows))) for c, m in enumerate(size.tolist()) if m], "cell int, nb int"))
    a = asked.join(blocks, "cell").select("cell", "qid", "q", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"))
    b = stored.join(blocks, "cell").select("cell", "id", "v", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("block"))
    found = a.groupBy("cell", "block").cogroup(b.groupBy("cell", "block")).applyInArrow(_score(k), "qid long, id long, score double")
    return top_per_query(found, k)
