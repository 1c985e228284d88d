"""Sums over what stands before, of groups that may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.sources.scratch import written


def running(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """The rows with ``before``: the sum of ``value`` over the rows of their group that stand before them.

    Rows are dealt to ranges of group and order, summed within each, and only a row for each group and range is ordered
    in one place, so a large group is no task's alone. Rows that are equal in group and order stand in either order.
    """
    keys = [*group, *order]
    dealt = written(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).select(*(F.col(c).alias(f"_{c}_") for c in group), F.col("_range").alias("_at"), "_start")
    same = dealt["_range"] == starts["_at"]
    for c in group:
        same = same & dealt[c].eqNullSafe(starts[f"_{c}_"])
    out = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, same)
    return out.select(*(F.col(c) for c in rows.columns), (F.col("_start") + F.col("_inside")).cast("long").alias("before"))
