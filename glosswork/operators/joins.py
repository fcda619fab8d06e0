"""Join of a large table to one-row-per-key answers when some keys are hot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot if it has at least this many rows and at least one in MAX_HOT_KEYS
# of all rows. So there are never more than MAX_HOT_KEYS hot keys, whatever the
# size of the table, and their list can be broadcast.
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000
ROWS_PER_SALT = 1_000_000


def is_hot(counts: DataFrame, rows_col: str, min_rows: int) -> Column:
    """Condition on a row of ``counts`` (one row per key)."""
    total = counts.agg(F.sum(rows_col).alias("total")).scalar()
    return (F.col(rows_col) >= min_rows) & (F.col(rows_col) >= F.ceil(total / F.lit(MAX_HOT_KEYS)))


def skew_join(
    fact: DataFrame,
    answers: DataFrame,
    keys: Sequence[str],
    *,
    how: str = "left",
    rows_col: str = "n_rows",
    hot_rows: int = HOT_ROWS,
    rows_per_salt: int = ROWS_PER_SALT,
    spread_by: Sequence[str] | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Join ``fact`` to ``answers`` (unique on ``keys``) null-safely.

    ``answers[rows_col]`` says how many fact rows each key has. Fact rows of hot
    keys are spread over ``ceil(rows / rows_per_salt)`` salts and the answer of
    such a key is repeated once per salt; all other keys join as usual. No row
    is dropped or capped. ``rows_col`` is not part of the result. ``sizes`` has the
    keys and their rows where ``answers`` is dear to compute: hot keys are found there.
    """
    sizes = answers if sizes is None else sizes
    n_salts = F.ceil(F.col(rows_col) / F.lit(rows_per_salt)).cast("int")
    hot_here = is_hot(sizes, rows_col, hot_rows)
    hot = sizes.where(hot_here).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys], n_salts.alias("_salts")
    )
    on_hot = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    # The salt must not depend on evaluation order, or a retried task would send
    # rows elsewhere: it is a hash of the row's own columns.
    spread = list(spread_by or [c for c in fact.columns if c not in keys] or fact.columns)
    salted = fact.join(F.broadcast(hot), on_hot, "left").withColumn(
        "_salt",
        F.when(F.col("_salts") > 1, F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int")).otherwise(0),
    ).drop("_salts", *[f"_h_{k}" for k in keys])

    payload = [c for c in answers.columns if c not in keys and c != rows_col]
    copies = F.when(hot_here, F.sequence(F.lit(0), n_salts - 1)).otherwise(
        F.array(F.lit(0))
    )
    repeated = answers.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *payload, F.explode(copies).alias("_r_salt")
    )
    on = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col("_salt") == F.col("_r_salt")],
    )
    return salted.join(repeated, on, how).drop("_salt", "_r_salt", *[f"_r_{k}" for k in keys])
