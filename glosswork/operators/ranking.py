"""Row numbers inside a partition that may hold most of the table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.session import written


def fifo_number(df: DataFrame, part: Sequence[str], order: Sequence[str], name: str = "rn",
                keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """``row_number() over (partition by part order by order)`` without sorting a
    whole partition in one task.

    The sorting columns alone are range-partitioned by sampled splitters, so a
    partition that holds everything is cut like any other, and written with the
    number of their range. A row's number is its place within its range plus the rows
    of its partition in the ranges before; the largest sort is one range, or the list
    of a partition's ranges. Columns may be of any type that sorts. ``order`` has to be
    unique within a partition; no column of either may be NULL. ``keep`` writes a table
    and reads it back.
    """
    part, order = list(part), list(order)
    keys = [*part, *order]
    ranges = keep(
        df.select(*keys).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "fifo-ranges")
    earlier = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy(*part, "_range").agg(F.count("*").alias("_n")).select(
        *part, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    in_range = Window.partitionBy(*part, "_range").orderBy(*order)
    numbered = ranges.join(before, [*part, "_range"]).select(
        *keys, (F.col("_before") + F.row_number().over(in_range)).alias(name))
    if set(df.columns) == set(keys):
        return numbered.select(*df.columns, name)
    same = reduce(lambda a, b: a & b, [F.col(f"_d.{k}") == F.col(f"_n.{k}") for k in keys])
    return df.alias("_d").join(numbered.alias("_n"), same).select("_d.*", f"_n.{name}")
