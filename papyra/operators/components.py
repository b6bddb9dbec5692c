"""Connected components of an edge list, without collecting edges or components anywhere."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from papyra.storage import stage, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation. Minima are aggregated map-side and joined back, so that a hub vertex is never one group."""
    if large:
        sym = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sym = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = sym.join(low, "u")
    if large:
        out = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def observed(seen: Observation) -> tuple | None:
    """What was observed, or nothing of a table that the optimizer knows to be empty."""
    try:
        return tuple(sorted(seen.get.items()))
    except Py4JJavaError:
        return None


def connected_components(edges: DataFrame, src: str, dst: str, label: str = "cc", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Alternating large-star and small-star steps; every round is written to the shared folder and compared by size and
    hash with the one before. Null endpoints and loops are ignored (a loop's node does come out, alone).
    No edges: no rows. Type of ``node`` is that of ``src``, which must equal that of ``dst``.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = e.where("u = v").select(F.col("u").alias("node")).distinct()
    cur = stage(e.where("u <> v").distinct(), label)
    before: tuple | None = ()
    for _ in range(max_rounds):
        seen = Observation()  # size and hash of a round are taken while it is written
        told = _star(_star(cur, True), False).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h"))
        last, cur = cur, stage(told, label)
        unstage(last)
        now = observed(seen)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    parts = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = parts.select(F.col("component").alias("node"), "component").distinct()
    found = parts.unionByName(roots)
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
