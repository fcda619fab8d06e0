"""Input files: listing, gating, plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions.paths import has_pdf_suffix, relative_inside, resolve
from glosswork.functions.text import py_strip


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files below ``root``. The content column is never read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", "modificationTime")
    )


def read_inputs(spark: SparkSession, root: str) -> DataFrame:
    """PDF files below ``root``, suffix in any case."""
    return list_files(spark, root, "*.[pP][dD][fF]").where(has_pdf_suffix(F.col("path")))


def spread(table: DataFrame) -> DataFrame:
    """Repartition a table that is read from fewer files than there are cores, so
    that parsing and hashing do not run in a few tasks. Larger tables, and those that
    come from no files, are returned as they are. Only the plan is looked at."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if 0 < len(table.inputFiles()) < cores else table


def gate_inputs(candidates: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    """Mark each candidate path with why it cannot be translated.

    ``reason`` is ``outside_root`` if a ``root`` is given and the path leads out of
    it, ``missing`` if the path is not an existing file, ``not_pdf`` if its suffix is
    another one, NULL if the input is accepted.
    """
    outside = F.lit(False)
    if root is not None:
        outside = relative_inside(resolve(F.col("path"), F.lit(root)), F.lit(root)).isNull()
    existing = files.select("path").distinct().withColumn("_exists", F.lit(True))
    return candidates.join(existing, "path", "left").withColumn(
        "reason",
        F.when(outside, "outside_root").when(F.col("_exists").isNull(), "missing").when(~has_pdf_suffix(F.col("path")), "not_pdf"),
    ).drop("_exists")


def read_text(spark: SparkSession, root: str) -> DataFrame:
    """One text per file for direct translation; whitespace-only files are dropped."""
    return (
        spark.read.text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        .where(py_strip(F.col("text")) != "")
    )
