"""Keep one delivery of each record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.storage import small_side, stage


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a null key."""
    for k in keys:
        df = df.where(F.col(f"`{k}`").isNotNull())
    return df


def latest_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest ``order`` for each key, ties settled by a hash of the row; rows with a null key are left out.

    Column names may hold dots or clash in case with others only as far as Spark allows it in ``df``."""
    cols = [c for c, kind in df.dtypes if not kind.startswith("map")]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in cols])
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(F.col(f"`{order}`").desc_nulls_last(), tie)
    return _named(df, keys).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def without_superseded(rows: DataFrame, deliveries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Those of ``rows`` that no row of ``deliveries`` with the same keys follows by ``order``.

    For operators that keep few of many rows: ``rows`` may be filtered by content, while ``deliveries`` (the unfiltered
    table) is read for keys and order alone, so that a newer delivery counts also where the filter drops it. Only the keys
    delivered more than once are joined. A null order comes before any other; of equal ones all remain."""
    names = [f"__k{i}" for i in range(len(keys))]
    d = _named(deliveries, keys).select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.col(f"`{order}`").alias("__o"))
    again = d.groupBy(*names).agg(F.max("__o").alias("__last"), F.count("*").alias("__n")).where("__n > 1 and __last is not null")
    again = stage(again.drop("__n"), "delivered-again")
    on = [F.col(f"`{k}`") == F.col(n) for k, n in zip(keys, names)]
    joined = _named(rows, keys).join(small_side(again), on, "left")
    return joined.where(F.col("__last").isNull() | (F.col(f"`{order}`") == F.col("__last"))).drop(*names, "__last")
