"""Points and the intervals that hold them, by equal keys instead of comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.sources.scratch import written


def blocks(spans: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """The rows of ``spans`` with level and block, once for each of the few whole blocks that make up the interval.

    A block of level k has 2^k numbers.
    At a level, the blocks inside the interval that no larger block inside it covers are the first one, if its number is
    odd, and the last one, if its number is even.
    """
    far = F.expr(f"{high} - {low} + 1")
    top = F.greatest(F.lit(0), F.length(F.bin(far)) - 1)
    rows = spans.where(F.col(low) <= F.col(high)).withColumn("level", F.explode(F.sequence(F.lit(0), top.cast("int"))))
    first = F.expr(f"shiftright({low} + shiftleft(1L, level) - 1, level)")
    last = F.expr(f"shiftright({high} + 1, level) - 1")
    odd, even = F.when(F.col("_first") % 2 != 0, F.col("_first")), F.when(F.col("_last") % 2 == 0, F.col("_last"))
    rows = rows.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    return rows.withColumn("block", F.explode(F.array_compact(F.array(odd, even)))).drop("_first", "_last")


def stabbed(points: DataFrame, spans: DataFrame, point: str = "n") -> DataFrame:
    """The points (whole numbers from 0) that some interval holds between its ends, with the least ``value`` of such intervals.

    ``spans`` has low, high and value. A block keeps its least value only, and a point looks at the block of each level
    that it lies in, so neither many intervals over one point nor many points in one interval make pairs.
    """
    inner = spans.select((F.col("low") + 1).cast("long").alias("low"), (F.col("high") - 1).cast("long").alias("high"), "value")
    least = written(blocks(inner).groupBy("level", "block").agg(F.min("value").alias("value")))
    top = least.agg(F.max("level")).first()[0] or 0  # one number
    at = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("block", F.expr(f"shiftright(cast({point} as long), level)"))
    met = at.join(least, ["level", "block"]).drop("level", "block")
    return met.groupBy(*points.columns).agg(F.min("value").alias("value"))
