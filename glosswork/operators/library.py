"""Choosing which attachments of a document library to translate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.functions.text import first_filled

# Titles that mark an attachment as a translation made earlier.
TRANSLATED_PREFIXES = ("[双语]", "[中文]", "[Translated]")
DEFAULT_TITLE = "PDF"


def best_attachment(attachments: DataFrame, files: DataFrame) -> DataFrame:
    """One attachment per item: the flagged best one if it is a PDF on disk, else
    the first such child in order. Titles play no part here. ``min_by`` reduces
    inside each task, so an item with very many children is no hot spot."""
    usable = attachments.where(F.col("is_pdf") & F.col("item_id").isNotNull()).join(
        files.select("path"), "path", "left_semi"
    )
    rank = F.struct((~F.coalesce("is_best", F.lit(False))).alias("later"), "child_pos", "attachment_id")
    return usable.groupBy("item_id").agg(F.min_by("attachment_id", rank).alias("attachment_id"))


def collect_targets(
    selection: DataFrame,
    attachments: DataFrame,
    items: DataFrame,
    libraries: DataFrame,
    files: DataFrame,
    prefixes: Sequence[str] = TRANSLATED_PREFIXES,
) -> DataFrame:
    """Attachments to translate for the selected rows, in selection order.

    ``selection`` has ``sel_pos`` and either ``attachment_id`` or ``item_id``.
    An attachment picked twice counts once, at its first place. Already
    translated titles, absent files and libraries that are known to be read-only
    are left out.
    """
    direct = (
        selection.where(F.col("attachment_id").isNotNull())
        .join(attachments.where("is_pdf").select("attachment_id"), "attachment_id")
        .select("sel_pos", "attachment_id")
    )
    via_item = (
        selection.where(F.col("attachment_id").isNull())
        .select("sel_pos", "item_id")
        .join(best_attachment(attachments, files), "item_id")
        .select("sel_pos", "attachment_id")
    )
    picked = direct.unionByName(via_item).groupBy("attachment_id").agg(F.min("sel_pos").alias("target_pos"))

    title = F.coalesce(F.col("title"), F.lit(""))
    translated = F.lit(False)
    for prefix in prefixes:
        translated = translated | title.startswith(prefix)
    parents = items.select("item_id", F.col("title").alias("_parent_title"))
    return (
        picked.join(attachments, "attachment_id")
        .where(~translated)
        .join(files.select("path"), "path", "left_semi")
        .join(parents, "item_id", "left")
        .join(libraries, "library_id", "left")
        .where(F.coalesce("files_editable", F.lit(True)))
        .select(
            "target_pos",
            "attachment_id",
            "item_id",
            "library_id",
            "path",
            F.coalesce(
                first_filled(F.col("_parent_title"), F.col("title"), F.col("filename")), F.lit(DEFAULT_TITLE)
            ).alias("display_title"),
        )
    )
