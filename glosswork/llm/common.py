"""What the operators of this subpackage share."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The largest side that is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_side(frame: DataFrame) -> DataFrame:
    """A written table as a join side: broadcast up to BROADCAST_ROWS rows that hold
    BROADCAST_BYTES at most, shuffled beyond."""
    width = lambda f: F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(1)) if isinstance(
        f.dataType, (T.StringType, T.BinaryType)) else F.lit(8)
    n, size = frame.agg(F.count(F.lit(1)), F.sum(reduce(add, map(width, frame.schema)))).first()
    return F.broadcast(frame) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else frame


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Sums run over blocks of so many entries: appending to an array copies it.
_BLOCK = 256


def starts_of(lengths: Column) -> Column:
    """Where each of a row of neighbours starts, given their lengths. Sums run inside blocks
    and over blocks, so the time grows with the number of entries, not with its square."""
    def running(sums: Column) -> Column:
        return F.aggregate(sums, F.array(F.lit(0)), lambda done, x: F.array_append(done, F.element_at(done, -1) + x))

    def within(whole: Column) -> Column:
        count = F.ceil(F.size(whole) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), count), lambda b: running(F.slice(whole, (b - 1) * _BLOCK + 1, F.lit(_BLOCK))))
        return let(blocks, lambda sums: F.flatten(F.zip_with(
            sums, running(F.transform(F.slice(sums, F.lit(1), count - 1), lambda w: F.element_at(w, -1))),
            lambda w, offset: F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x: x + offset))))

    return let(lengths, lambda whole: F.when(F.size(whole) == 0, F.array().cast("array<int>")).otherwise(within(whole)))
