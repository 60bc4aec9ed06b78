"""Positions in a global order without a window over one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values that are looked at for the bounds of ranges, and ranges.
SAMPLE, RANGES = 4096, 64


def with_position(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with the column ``name``: 0, 1, ... by ``order`` (nulls first). Equal values are numbered in any order.

    Bounds from a sample cut the order into ranges; each is numbered by itself, from the count of all rows before it.
    The result is exact whatever the sample holds.
    """
    sample = rows.select(order).where(F.col(order).isNotNull()).distinct().orderBy(F.xxhash64(order)).limit(SAMPLE)
    values = sample.agg(F.sort_array(F.collect_list(order)).alias("v")).first()[0]
    cuts = values[:: max(1, len(values) // RANGES)]
    range_of: Column = F.lit(0)
    if cuts:
        bounds = F.array(*[F.lit(c).cast(rows.schema[order].dataType) for c in cuts])
        range_of = F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col(order))), F.lit(0))
    ranged = rows.withColumn("_range", F.when(F.col(order).isNull(), -1).otherwise(range_of))
    # one row for each range: bounded, whatever the table's size
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_inside", inside - 1).join(F.broadcast(starts), "_range").withColumn(name, F.col("_inside") + F.col("_start")).drop("_range", "_inside", "_start")
