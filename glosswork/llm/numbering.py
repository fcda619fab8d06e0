"""Places of rows in an order, however many rows share a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.llm.common import small_side
from glosswork.session import written


def same(keys: Sequence[str], left: str, right: str) -> Column:
    """Null-safe equality of ``keys`` of two aliased frames."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys], F.lit(True))


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, within its group, nulls first) and ``of`` (the
    rows of its group). Nulls are a group of their own; rows equal in ``order`` get
    their places in any order, once. The columns ``place``, ``of`` and ``_at`` must be free.

    The rows are range-partitioned by sampled splitters, sorted in their range and
    written with their running number, so a group that holds most of the table is cut
    like any other. What is joined back has one row for each range and group: the
    number where the group starts in the range, and its rows in earlier ranges. Keys
    are sampled to the driver, so they should be short.
    """
    keys = [f"`{k}`" for k in (*group, *order)]
    sorted_rows = written(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()),
        "numbered")
    # The upper bits of the running number are the number of the range.
    part = [F.col(f"`{g}`") for g in group]
    starts = sorted_rows.groupBy(*part, F.shiftright("_at", 33).alias("_range")).agg(
        F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*part)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(starts.select(
        *part, "_range", (F.col("_start") - F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_base"),
        F.sum("_n").over(whole).alias("_of")), "range-starts")
    in_range = F.shiftright("_r._at", 33) == F.col("_s._range")
    return sorted_rows.alias("_r").join(
        small_side(starts).alias("_s"), same(group, "_r", "_s") & in_range,
    ).select("_r.*", (F.col("_r._at") - F.col("_s._base")).alias("place"), F.col("_s._of").alias("of")).drop("_at")
