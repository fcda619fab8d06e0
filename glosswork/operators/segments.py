"""Documents to translatable segments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.text import py_strip, text_key
from glosswork.options import MIN_TEXT_LENGTH

LINES_PER_PAGE = 10


def segment(documents: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """One row per line of a document; paragraph boundaries are kept.

    A line that contains ``' | '`` counts as table text. A document whose text is
    NULL is one segment with NULL text, which passes through. Narrow: no shuffle.
    """
    lines = documents.select(
        "doc_id", "lang", F.posexplode_outer(F.split("text", "\n")).alias("pos", "text")
    ).withColumn("pos", F.coalesce("pos", F.lit(0)))
    return lines.select(
        F.concat_ws(":", "doc_id", "pos").alias("seg_id"),
        "doc_id",
        (F.floor(F.col("pos") / lines_per_page) + 1).cast("int").alias("page_no"),
        "pos",
        "lang",
        F.when(F.col("text").contains(" | "), "table").otherwise("text").alias("kind"),
        "text",
    )


def parse_pages(expression: str | None) -> list[tuple[int, int]] | None:
    """Merged ranges of a page expression such as ``1,2,4-6``; None is all pages."""
    if expression is None:
        return None
    ranges = []
    for item in expression.split(","):
        found = re.fullmatch(r"\s*([1-9][0-9]*)(?:\s*-\s*([1-9][0-9]*))?\s*", item)
        if not found:
            raise ValueError(f"not a page or page range: {item!r}")
        low = int(found.group(1))
        high = int(found.group(2) or low)
        if high < low:
            raise ValueError(f"page range runs backwards: {item!r}")
        ranges.append((low, high))
    merged: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def on_pages(page: Column, expression: str | None) -> Column:
    """The page expression as a predicate, which Spark can push to a scan; no
    join is needed for ranges a person typed."""
    ranges = parse_pages(expression)
    if ranges is None:
        return F.lit(True)
    wanted = F.lit(False)
    for low, high in ranges:
        wanted = wanted | page.between(low, high)
    return wanted


def select_pages(segments: DataFrame, expression: str | None) -> DataFrame:
    return segments.where(on_pages(F.col("page_no"), expression))


_RANGE = r"^\s*([1-9][0-9]*)(\s*-\s*([1-9][0-9]*))?\s*$"


def page_lists(selections: DataFrame) -> DataFrame:
    """``doc_id``, ``ranges`` (low, high) and ``error`` of a table of page expressions
    (``doc_id, pages``); several rows of a document add up. A document with a null
    expression has all pages, as null ``ranges``; one with an invalid item has an
    ``error`` that names the first, and no ranges."""
    number = lambda item, group: F.regexp_extract(item, _RANGE, group).try_cast("bigint")
    # An item that is no range, or a number beyond 64 bits, has no low end.
    parsed = F.transform(F.split("pages", ","), lambda i: F.struct(
        i.alias("item"), number(i, 1).alias("low"),
        F.when(F.regexp_extract(i, _RANGE, 2) == "", number(i, 1)).otherwise(number(i, 3)).alias("high")))
    bad = F.filter("items", lambda i: F.coalesce(i["low"] > i["high"], F.lit(True)))
    return (
        selections.groupBy("doc_id").agg(
            F.flatten(F.collect_list(parsed)).alias("items"), F.count_if(F.col("pages").isNull()).alias("n_all"))
        .withColumn("bad", F.get(bad, F.lit(0)))
        .select(
            "doc_id",
            F.when(F.col("bad").isNull() & (F.col("n_all") == 0), F.transform("items", lambda i: F.struct(i["low"], i["high"]))).alias("ranges"),
            F.when(F.col("bad.low") > F.col("bad.high"), F.concat(F.lit("page range runs backwards: "), F.col("bad.item")))
            .when(F.col("bad").isNotNull(), F.concat(F.lit("not a page or page range: "), F.col("bad.item"))).alias("error"),
        )
    )


def select_listed_pages(segments: DataFrame, lists: DataFrame) -> DataFrame:
    """Segments on the pages that their document's ranges name, by ``page_lists``. Documents
    that are not listed keep all pages, those with an error none. One row a document
    meets its segments, however many ranges it has; a long document is a hot key that
    Spark splits."""
    picked = lists.select(F.col("doc_id").alias("_doc"), "ranges", F.col("error").isNotNull().alias("_bad"))
    inside = F.exists("ranges", lambda r: F.col("page_no").between(r["low"], r["high"]))
    return segments.join(picked, F.col("doc_id") == F.col("_doc"), "left").where(
        ~F.coalesce("_bad", F.lit(False)) & (F.col("ranges").isNull() | inside)).drop("_doc", "ranges", "_bad")


def gate(
    segments: DataFrame,
    lang_in: str = "en",
    min_text_length: int = MIN_TEXT_LENGTH,
    translate_table_text: bool = True,
) -> DataFrame:
    """Add ``translate``; a segment where it is false passes through unchanged."""
    length = F.char_length(py_strip(F.col("text")))
    wanted = F.col("lang").eqNullSafe(lang_in) & F.coalesce(length >= max(1, min_text_length), F.lit(False))
    if not translate_table_text:
        wanted = wanted & (F.col("kind") != "table")
    return segments.withColumn("translate", wanted)


def dedup_segments(segments: DataFrame) -> DataFrame:
    """One row per distinct text and model: the first place it occurs and how
    often. Only fixed-width columns and the hash are shuffled, after a partial
    aggregation in each task, so a text that fills a third of the table is
    cheap. The place is one decimal number, which a hash aggregation can update;
    a struct would have to be sorted."""
    width = F.lit(2**32).cast("decimal(11,0)")
    place = (F.col("doc_id").cast("decimal(20,0)") * width + F.col("pos")).cast("decimal(38,0)")
    firsts = segments.groupBy(text_key(F.col("text")).alias("key_hash"), "effective_model").agg(
        F.min(place).alias("_place"), F.count("*").alias("n_rows")
    )
    pos = F.pmod(F.col("_place"), width)
    doc_id = F.floor((F.col("_place") - pos).cast("decimal(38,0)") / width)
    return firsts.select(
        "key_hash", "effective_model",
        F.struct(doc_id.cast("bigint").alias("doc_id"), pos.cast("int").alias("pos")).alias("first"), "n_rows",
    )
