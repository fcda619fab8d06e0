"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.session import written


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id of its component) of every id in the
    links ``a``, ``b``. Links to itself and repeated ones do no harm.

    Alternating large-star and small-star: each round re-links larger neighbours, then
    smaller ones, to the smallest, until every id points at its component's smallest.
    The number of rounds grows with the logarithm of the longest path. A round takes
    minima, which are combined in the tasks, and is written to shared storage.
    """
    current = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while before != (now := _fingerprint(current)):
        before = now
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lowest")
        large = written(
            both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct(),
            "large-star")
        lowest = written(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        current = written(
            large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(),
            "small-star")
    tops = current.select(F.col("b").alias("id")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        tops.select("id", F.col("id").alias("component")))


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
