"""One ranking from several differently scaled scores: reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators.latest import latest_rows


def fuse_ranks(scores: DataFrame, by: str, item: str, constant: float = 60.0) -> DataFrame:
    """``(by, item, fused_score, rank)`` from long rows ``(by, item, list, score)``.

    Each list ranks its items separately, higher scores first and equal scores sharing the better rank; an item's total is
    the sum of 1 / (constant + rank) over its lists, so a list it lacks adds nothing and puts it below all that have it.
    Rows with a null or NaN score count as absent, yet their item is ranked (with total 0 if it is in no list). Several
    rows of one item in one list count once, with the best score. Equal totals are ordered by item. Rows without ``by`` or
    ``item`` are left out. Input of no rows gives no rows.

    All windows are partitioned by (by, list) or by ``by``: one query's candidates, which a retrieval depth bounds.
    """
    rows = scores.select(F.col(by).alias("b"), F.col(item).alias("i"), F.col("list").alias("l"), F.col("score").cast("double").alias("s")).where("b is not null and i is not null")
    rows = rows.withColumn("s", F.when(F.isnan("s") | F.col("l").isNull(), None).otherwise(F.col("s"))).groupBy("b", "i", "l").agg(F.max("s").alias("s"))
    rank = F.rank().over(Window.partitionBy("b", "l").orderBy(F.col("s").desc_nulls_last()))
    part = F.when(F.col("s").isNotNull(), 1.0 / (F.lit(constant) + F.col("r"))).otherwise(0.0)
    # the parts are summed in one fixed order, so that equal ranks give equal totals
    total = rows.withColumn("r", rank).groupBy("b", "i").agg(F.aggregate(F.sort_array(F.collect_list(part)), F.lit(0.0), lambda a, x: a + x).alias("fused_score"))
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("fused_score"), "i"))
    return total.withColumn("rank", place).select(F.col("b").alias(by), F.col("i").alias(item), "fused_score", "rank")


def candidate_scores(candidates: DataFrame) -> DataFrame:
    """Long rows ``(query_id, chunk_id, list, score)`` of candidates logged last; the semantic score is one list more.

    A candidate with an empty or null map and no semantic score gives one row with a null list."""
    c = latest_rows(candidates.select("query_id", "chunk_id", "lexical_scores", "semantic_score", "logged_at"), ["query_id", "chunk_id"], "logged_at")
    entries = F.concat(
        F.transform(F.coalesce(F.map_entries("lexical_scores"), F.array()), lambda e: F.struct(F.concat(F.lit("lexical:"), e["key"]).alias("list"), e["value"].alias("score"))),
        F.array(F.struct(F.lit("semantic").alias("list"), F.col("semantic_score").alias("score"))),
    )
    return c.select("query_id", "chunk_id", F.explode(entries).alias("e")).select("query_id", "chunk_id", "e.list", "e.score")
