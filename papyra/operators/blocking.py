"""Comparing all rows that share a key, however many they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, key: str, item: str, block_rows: int) -> DataFrame:
    """``rows`` with columns ``blk, bi, bj``: grouped by (key, bi, bj), all pairs of rows of one key meet in some group.

    A key of at most ``block_rows`` rows is one group. A larger one is cut into blocks by hash of ``item``, and each pair of
    blocks is a group; pairs within a block (blk equal) belong to the group bi = bj only."""
    size = rows.groupBy(key).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("nb")).where("nb > 1")
    cut = rows.join(size, key, "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("blk", F.pmod(F.xxhash64(item), F.col("nb")).cast("int"))
    out = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return out.withColumn("bi", F.least("blk", "o")).withColumn("bj", F.greatest("blk", "o")).drop("o", "nb")
