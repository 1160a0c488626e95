"""Global ranks without a global task.

Implements: T3, A22 (ranks), R13 (numbering of trees).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.sources.scratch import written

#: monotonically_increasing_id() holds the row's place in its partition in this many low bits.
_LOW_BITS = 33


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 on in the given order, which has to be total.

    A range sort puts the partitions in order, places inside them are counted where they
    lie, and only one number a partition is added up.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_at", _LOW_BITS)), "ranked")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.col("_at").bitwiseAND((1 << _LOW_BITS) - 1)
    return placed.join(before, "_part").withColumn(name, F.col("_before") + inside + 1).drop("_part", "_at", "_before")


def ranked_within(rows: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place from 0 on inside their group, in the given order, which has to be total within it.

    Groups are ranked one after the other in a single range sort, so a large one lies
    in many tasks; each then takes off the place of its first row.
    """
    placed = ranked(rows, [*(F.col(g).asc_nulls_first() for g in group), *order], "_place")
    placed = placed.withColumn("_group", F.struct(*group))
    first = placed.groupBy("_group").agg(F.min("_place").alias("_first"))
    return placed.join(first, placed["_group"].eqNullSafe(first["_group"])).withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_first", "_group")


def running(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before them in the given order, which has to be total.

    As in ``ranked``, sums are made inside ranges, and one number a range is added up.
    """
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = written(dealt.withColumn(name, F.sum(value).over(inside) - F.col(value)), "running")
    sizes = placed.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(before, "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
