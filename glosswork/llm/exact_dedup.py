"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, Spark's external sort puts
equal ones side by side, and the window compares each row's whole text with that of
the row before. No Python runs.

Splitters are the first HEAD characters and, among texts that begin alike, a hash of
the whole: the driver samples short keys, however long the texts are, and a beginning
that a third of all texts share is split as well. Equal texts have equal keys.

A text that holds at least one row in HOT_SHARE would fill one range. Such texts are
found first, from a count by 64-bit hash that is combined before the shuffle; there
are at most HOT_SHARE of them at any size, so their list is safe to broadcast. Their
rows get a salt as second sort key, and the few (text, salt) representatives are
merged afterwards. The list only spreads work: equality is always decided on texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswork.llm.common import text_of
from glosswork.session import written

HEAD = 64
HOT_SHARE = 1000
SALTS = 256
# Fixed values of the contract: the ASCII white space that equality ignores.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    for space in ASCII_SPACE:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def _marked(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """``row`` (the columns ``keep``), ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    The normalised text travels with the row, so it is made once before the shuffle and
    not again for each comparison.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{id_col}`").alias("id"),
        F.length(text).alias("points"), normalised(text).alias("norm"),
    )
    total = docs.count()
    hot = written(
        rows.groupBy(F.xxhash64("norm").alias("hot")).count()
        .where(F.col("count") * HOT_SHARE >= total)
        .select("hot"),
        "hot-texts",
    )
    hashed = rows.withColumn("hash", F.xxhash64("norm"))
    salt = 1 + F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    salted = hashed.join(F.broadcast(hot), F.col("hash") == F.col("hot"), "left").select(
        "row", "id", "points", "norm", "hash", F.substring("norm", 1, HEAD).alias("head"),
        F.when(F.col("hot").isNull(), 0).otherwise(salt).alias("salt"))
    sha = F.sha2(F.col("norm").cast("binary"), 256)
    same = W.partitionBy("head", "hash", "norm", "salt")
    best_first = same.orderBy(F.desc("points"), F.asc_nulls_last("id"))
    placed = salted.repartitionByRange("head", "hash", "salt").select(
        "row", "salt", sha.alias("text_sha256"),
        F.row_number().over(best_first).alias("rank"),
        F.first("id").over(best_first).alias("best"),
        F.count(F.lit(1)).over(same).alias("size"),
    )
    # At most HOT_SHARE texts times SALTS rows reach this merge.
    order = F.struct(-F.col("points"), F.col("id").isNull(), F.col("id"))
    hot_groups = (
        hashed.join(F.broadcast(hot), F.col("hash") == F.col("hot"))
        .select(salt.alias("salt"), sha.alias("sha"), "points", "id")
        .groupBy("sha", "salt").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
        .groupBy("sha").agg(F.min(F.struct("first", "salt")).alias("first"), F.sum("n").alias("hot_size"))
        .select("sha", F.col("first.first.id").alias("hot_best"), F.col("first.salt").alias("hot_salt"), "hot_size")
    )
    split = F.col("hot_size").isNotNull()
    return placed.join(F.broadcast(hot_groups), F.col("text_sha256") == F.col("sha"), "left").select(
        "row",
        F.when(split, F.col("hot_best")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("hot_size", "size").alias("group_size"),
        ((F.col("rank") == 1) & (~split | (F.col("salt") == F.col("hot_salt")))).alias("kept"),
        "text_sha256",
    )


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with ``keep_id``, ``group_size``, ``kept``
    and ``text_sha256`` (input columns of these names are left out).

    Texts are equal when they are the same after ASCII white space is deleted; null
    counts as empty, and all empty texts are one group. Of a group the row with the
    most code points stays, then the smallest id (null ids last), and of fully
    repeated rows exactly one. An empty table gives an empty table.
    """
    made = ["keep_id", "group_size", "kept", "text_sha256"]
    keep = [c for c in docs.columns if c not in (*made, text_col)]
    return _marked(docs, id_col, text_col, keep).select("row.*", *made)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs`` and no others."""
    return _marked(docs, id_col, text_col, docs.columns).where("kept").select("row.*")
