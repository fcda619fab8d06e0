"""Sharding by proportional stratified interleaving, in DataFrame functions only.

The rows of each source are ranked in a seeded shuffle. A row's fractional rank is its
place among the rows of its source, from 0 to 1, so rows in the order of their
fractional ranks are mixed like the whole table in every stretch. That order is cut
into stretches of equal counts: each shard holds each source in proportion, to within
one row a cut. Only keys, sizes and checksums are sorted, never texts, and both
rankings are range-partitioned, so a source with a third of all rows is cut as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import text_of
from glosswork.llm.numbering import numbered

LAW = "rows"
ROW_OVERHEAD = 8  # what a stored row takes beside its text


def shuffle_key(seed: str, id_col: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("-"))).cast("binary"))


def interleave(
    docs: DataFrame, shards: int, seed: str, id_col: str = "doc_id", text_col: str = "text",
    stratum_col: str = "source", keep: Sequence[str] = (),
) -> DataFrame:
    """One row for each row of ``docs``: its id, ``size``, ``text_crc32``, ``shard`` (0 to
    ``shards`` - 1), ``slot`` (place in the shard, from 0) and the columns ``keep`` as the
    struct ``kept``, which travels through both sorts.

    Counts of shards are at most one apart; fewer rows than shards leave shards empty.
    Null texts have no bytes and the checksum 0; null sources are a stratum; null ids
    shuffle alike and go by checksum and size, as rows that repeat an id do. Rows equal
    in all of these take neighbouring places in any order. An empty table gives an empty one.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = text_of(text_col)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{stratum_col}`").alias("stratum"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shuffle_key(seed, F.col(f"`{id_col}`")).alias("shuffled"),
        *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []),
    )
    by_rank = ["shuffled", "id", "text_crc32", "size"]
    ranked = numbered(rows, ["stratum"], by_rank)
    fraction = (F.col("place") + F.lit(0.5)) / F.col("of")
    mixed = numbered(
        ranked.withColumn("fraction", fraction).drop("place", "of"), [], ["fraction", "stratum", *by_rank])
    cut = mixed.withColumn("shard", F.expr(f"(place * {shards}L) div of"))
    return cut.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
        # The place less the first place of its shard.
        F.expr(f"place - (shard * of + {shards - 1}L) div {shards}L").alias("slot"),
        *(["kept"] if keep else []),
    )


def write_shards(docs: DataFrame, shards: int, seed: str, path: str, **columns) -> None:
    """Write whole rows as ``path/shard=N/…``, in the order of ``slot`` within and across a
    shard's files. Texts travel through the sorts here, as they have to move anyway."""
    placed = interleave(docs, shards, seed, keep=[c for c in docs.columns if c not in ("shard", "slot")], **columns)
    (
        placed.select("kept.*", "shard", "slot").repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    )
