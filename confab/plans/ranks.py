"""Global row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.plans.lineage import cut_lineage

_SHIFT = 33  # monotonically_increasing_id keeps the partition above this bit


def global_rank(df: DataFrame, order: list[str | Column], name: str = "rank", partitions: int | None = None, ranges: list[str | Column] | None = None) -> DataFrame:
    """``df`` with its 0-based position in the total order of ``order``.

    One range shuffle sorts the rows; each partition numbers its own and is moved up
    by the sizes of those before it, a table of one row a partition, which is small
    by construction and therefore broadcast. ``ranges``, a coarser form of ``order``, is
    what the shuffle samples at the driver where the values of ``order`` are long.
    """
    n = [partitions] if partitions else []
    ordered = df.repartitionByRange(*n, *(ranges or order)).sortWithinPartitions(*order)
    numbered = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()), "rank")
    part = F.shiftright("_at", _SHIFT)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = sizes.select("_part", before.alias("_before"))
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(moved), "_part")
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << _SHIFT) - 1))
        .drop("_part", "_before", "_at")
    )


def running_total(df: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """``df`` with the sum of ``weight`` over all rows before it in the order of ``order``.

    As :func:`global_rank`: one range shuffle, then sums within partitions, moved up by
    the totals of the partitions before.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()), "total")
    part = F.shiftright("_at", _SHIFT)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.sum(weight).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = sizes.select("_part", before.alias("_before"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(moved), "_part")
        .withColumn(name, F.col("_before") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop("_part", "_before", "_at")
    )
