"""Frame helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters read instead of recomputing.

    Spark pushes a filter below a projection by copying the projected expression
    into it, so a filter on a parsed document parses the document again. A
    one-element ``inline`` keeps the value: still narrow, still one row per row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
