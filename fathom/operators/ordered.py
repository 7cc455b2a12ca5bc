"""Sums and neighbours in a total order over groups of any size: rows are laid out in ranges, and only the ranges' ends meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathom.sources.store import written


def laid(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows as a table laid out by ranges of some columns, with the number of the range as _range."""
    return written(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))


def running(rows: DataFrame, group: str, order: str, sums: dict[str, Column]) -> DataFrame:
    """Adds running sums over each group in an order without ties; no task sees more than a range of a group."""
    ranged = laid(rows, [group, order])
    ends = ranged.groupBy(group, "_range").agg(*(F.sum(x).alias(f"_{name}") for name, x in sums.items()))
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = ends.select(group, "_range", *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums))
    within = W.partitionBy(group, "_range").orderBy(order)
    summed = ranged.join(starts, [group, "_range"])
    return summed.select(*rows.columns, *((F.sum(x).over(within) + F.col(f"_{name}")).alias(name) for name, x in sums.items()))


def first_from(points: DataFrame, group: str, value: str, mark: str) -> DataFrame:
    """Adds first: of the points of a group with the same or a larger value, the least mark that is not null.

    Points without a mark come before those with one at the same value.
    """
    ranged = laid(points, [group, value])
    least = ranged.groupBy(group, "_range").agg(F.min(mark).alias("_least"))
    later = W.partitionBy(group).orderBy("_range").rowsBetween(1, W.unboundedFollowing)
    beyond = least.select(group, "_range", F.min("_least").over(later).alias("_beyond"))
    within = W.partitionBy(group, "_range").orderBy(F.col(value), F.col(mark).isNotNull()).rowsBetween(0, W.unboundedFollowing)
    return ranged.join(beyond, [group, "_range"]).select(*points.columns, F.least(F.min(mark).over(within), F.col("_beyond")).alias("first"))
