"""Order within groups of any size: neighbours, numbers and the last mark before a point, without a window over whole groups.

A group is cut into ranges of its order; windows run within ranges, and each range's edge is carried over by a table of one row
per range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: width of a range in units of the order
WIDTH = 4096


def _ranged(rows: DataFrame, order: str, width: int) -> DataFrame:
    return rows.withColumn("__range", F.floor(F.coalesce(F.col(order), F.lit(-1)) / width))


def linked(rows: DataFrame, group: str, order: str, item: str, width: int = WIDTH) -> DataFrame:
    """``(item, before, after)``: the items next to each one in its group, by ``order`` (a whole number, nulls first) and item;
    null at the ends. Items must be unique."""
    r = _ranged(rows.select(group, order, item), order, width)
    place = F.struct(F.coalesce(order, F.lit(-1)).alias("o"), F.col(item).alias("i"))
    w = Window.partitionBy(group, "__range").orderBy(place)
    near = r.select(group, "__range", item, F.lag(item).over(w).alias("before"), F.lead(item).over(w).alias("after"))
    edges = r.groupBy(group, "__range").agg(F.min(place)["i"].alias("first"), F.max(place)["i"].alias("last"))
    along = Window.partitionBy(group).orderBy("__range")  # one row a range
    carried = edges.select(group, "__range", F.lag("last").over(along).alias("from"), F.lead("first").over(along).alias("to"))
    j = near.alias("n").join(carried.alias("c"), F.col(f"n.{group}").eqNullSafe(F.col(f"c.{group}")) & (F.col("n.__range") == F.col("c.__range")))
    return j.select(F.col(f"n.{item}"), F.coalesce("before", "from").alias("before"), F.coalesce("after", "to").alias("after"))


def numbered(rows: DataFrame, groups: list[str], order: str, item: str, name: str, width: int = WIDTH) -> DataFrame:
    """``(item, name)``: each item's place in its group from 1, by ``order`` and item."""
    r = _ranged(rows.select(*groups, order, item), order, width)
    w = Window.partitionBy(*groups, "__range").orderBy(order, item)
    near = r.select(*groups, "__range", item, F.row_number().over(w).alias("n"))
    along = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ahead = r.groupBy(*groups, "__range").agg(F.count("*").alias("m")).select(*groups, "__range", F.coalesce(F.sum("m").over(along), F.lit(0)).alias("ahead"))
    same: Column = F.col("n.__range") == F.col("a.__range")
    for g in groups:
        same = same & F.col(f"n.{g}").eqNullSafe(F.col(f"a.{g}"))
    return near.alias("n").join(ahead.alias("a"), same).select(F.col(f"n.{item}"), (F.col("n.n") + F.col("ahead")).cast("int").alias(name))


def last_before(points: DataFrame, marks: DataFrame, group: str, at: str, width: int = 1 << 20) -> DataFrame:
    """The points with ``mark``: of their group's marks ``(group, at, mark)`` the last at or before ``at`` (of several at one place
    the greatest); null before all. Null groups and places have none."""
    kind = points.columns
    p = points.select(*kind, F.lit(1).alias("__kind"), F.lit(None).cast(marks.schema["mark"].dataType).alias("__mark"))
    m = marks.select(*[F.col(c) if c in (group, at) else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in kind], F.lit(0).alias("__kind"), F.col("mark").alias("__mark"))
    r = _ranged(m.unionByName(p).where(F.col(group).isNotNull() & F.col(at).isNotNull()), at, width)
    seen = F.when(F.col("__kind") == 0, F.struct(F.col(at).alias("a"), F.col("__mark").alias("m")))
    w = Window.partitionBy(group, "__range").orderBy(at, "__kind", "__mark").rowsBetween(Window.unboundedPreceding, 0)
    near = r.withColumn("__last", F.last(seen, ignorenulls=True).over(w)).where("__kind = 1")
    along = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ends = r.groupBy(group, "__range").agg(F.max(seen).alias("e")).select(group, "__range", F.last("e", ignorenulls=True).over(along).alias("__from"))
    j = near.join(ends, [group, "__range"]).withColumn("__l", F.coalesce("__last", "__from"))
    return j.select(*kind, F.col("__l.a").alias("mark_at"), F.col("__l.m").alias("mark"))
