"""Range joins on bins and gaps-and-islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Length shared by two intervals, 0 where they only touch."""
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def binned_overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, how: str = "inner") -> DataFrame:
    """Pairs of intervals of the same keys that overlap by more than a point.

    ``left`` has start_a, end_a and ``right`` start_b, end_b; other columns must differ.
    Both sides are exploded into bins of ``width``, so the join is an equi join on keys
    and bin and never a nested loop; a pair is kept in the bin where it begins only. Long
    intervals cost rows in proportion to their length over ``width``.
    """
    bins = lambda a, b: F.sequence(F.floor(a / width), F.floor((b - 1) / width))
    a = left.where("end_a > start_a").withColumn("_bin", F.explode(bins(F.col("start_a"), F.col("end_a"))))
    b = right.where("end_b > start_b").withColumn("_bin", F.explode(bins(F.col("start_b"), F.col("end_b"))))
    pairs = a.join(b, [*keys, "_bin"]).where("start_a < end_b and start_b < end_a")
    pairs = pairs.where(F.col("_bin") == F.floor(F.greatest("start_a", "start_b") / width)).drop("_bin")
    if how == "inner":
        return pairs
    return left.join(pairs, left.columns, "left")


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int, closed: bool = True, name: str = "island") -> DataFrame:
    """Numbers the runs of intervals whose gaps to the greatest end before are small.

    A new run begins where start minus that end exceeds ``gap`` (``closed``), or reaches
    it (not ``closed``).
    """
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) - before
    new = F.when(before.isNull() | ((apart > gap) if closed else (apart >= gap)), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, closed: bool = True) -> DataFrame:
    """(keys, start, end, n): the runs as intervals."""
    numbered = islands(df, keys, start, end, gap, closed)
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("island")
