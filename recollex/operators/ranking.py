"""Ranks over a whole table without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recollex.sources.shared import Scratch, shuffle_width


def global_rank(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """Rows with their rank from 1 by a total order.

    The table is sorted by range over all tasks and kept; a row's rank is its place in its
    partition plus the rows of the partitions before, one number per partition.  It is
    kept because ranges come from a sample: two readings of a plan may cut differently.
    """
    parts = shuffle_width(rows.sparkSession)
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    placed = Scratch(rows.sparkSession).keep(placed)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_before", "_at")
