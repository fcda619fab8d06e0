"""Counters and reports over finished and open work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions.text import first_filled, js_strip, json_quote, py_strip, tail
from glosswork.options import DEFAULT_MODEL_LABEL

# How much of an error text is kept, by who reports it.
BACKEND_TAIL = 2000
REPORTER_TAILS = {"library": 2500, "notes": 3000}
DIAGNOSTIC_TAIL = 1200


def status_columns() -> list[Column]:
    answered, good = F.col("answered"), F.col("defect").isNull()
    n_jobs = F.size("job_ids").cast("bigint")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return [
        F.count_if(answered & good).alias("batches"),
        F.count_if(answered & ~good).alias("failed_batches"),
        total(F.when(answered & good, n_jobs)).alias("translated_items"),
        total(F.when(~answered, n_jobs)).alias("queued_items"),
    ]


def model_label() -> Column:
    return F.coalesce("effective_model", F.lit(DEFAULT_MODEL_LABEL)).alias("model")


def backend_status(audited: DataFrame) -> DataFrame:
    """Counters per model over audited batches."""
    return audited.groupBy(model_label()).agg(*status_columns())


def shard_status(audited: DataFrame) -> DataFrame:
    """The same counters per shard and model with subtotals per shard and a
    total; NULL marks a subtotal."""
    labelled = audited.select("shard", model_label(), "job_ids", "answered", "defect")
    return labelled.rollup("shard", "model").agg(*status_columns())


def run_summary(targets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per run: targets, attachments created, targets failed and percent done.

    ``targets`` has ``run_id, target_pos, attachment_id``; ``outcomes`` has
    ``attachment_id, n_created, error`` for the targets that are finished.
    """
    done = targets.join(outcomes, "attachment_id", "left")
    finished = F.col("n_created").isNotNull() | F.col("error").isNotNull()
    return done.groupBy("run_id").agg(
        F.count("*").alias("n_targets"),
        F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("n_created"))), F.lit(0)).cast("bigint").alias("n_created"),
        F.count("error").alias("n_failed"),
        F.floor(F.count_if(finished) * 100 / F.count("*") + 0.5).cast("bigint").alias("percent"),
    )


def first_failures(targets: DataFrame, outcomes: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` failures of each run in target order as ``title: reason``.

    Spark prunes each task to ``n`` rows per run before the shuffle, because the
    row number is only compared with a constant."""
    failed = targets.join(outcomes.where(F.col("error").isNotNull()), "attachment_id")
    order = Window.partitionBy("run_id").orderBy("target_pos")
    return (
        failed.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= n)
        .select("run_id", "place", F.concat("display_title", F.lit(": "), "error").alias("message"))
    )


def error_text(stderr: Column, stdout: Column, limit: int) -> Column:
    """Standard error, else standard output, stripped; its last characters."""
    return tail(py_strip(F.coalesce(first_filled(stderr, stdout), F.lit(""))), limit)


def reported_text(stderr: Column, stdout: Column, reporter: str, fallback: Column) -> Column:
    """Error text as a reporter shows it: the first stream that holds anything, trimmed
    as JavaScript does, its last characters. The library shows ``fallback`` where
    nothing is left; notes take it only where both streams are empty."""
    limit = REPORTER_TAILS[reporter]
    streams = (stderr, stdout) if reporter == "library" else (stderr, stdout, fallback)
    text = tail(js_strip(F.coalesce(first_filled(*streams), F.lit(""))), limit)
    return F.when(text == "", fallback).otherwise(text) if reporter == "library" else text


def diagnostic(label: str, value: Column) -> Column:
    """``label (n bytes): "…tail"`` for logs."""
    trimmed = js_strip(value)
    marked = F.when(
        F.char_length(trimmed) > DIAGNOSTIC_TAIL, F.concat(F.lit("…"), tail(trimmed, DIAGNOSTIC_TAIL))
    ).otherwise(trimmed)
    shown = F.when(trimmed == "", "<empty>").otherwise(json_quote(marked))
    return F.concat(F.lit(f"{label} ("), F.octet_length(value), F.lit(" bytes): "), shown)


def failure_report(logs: DataFrame, limit: int = BACKEND_TAIL) -> DataFrame:
    """Detail, the texts of the two other reporters and stream diagnostics per failed
    job. Where ``logs`` has ``exit_code``, it is named if there is no other text."""
    code = F.col("exit_code").cast("string") if "exit_code" in logs.columns else F.lit("unknown")
    fallback = F.concat(F.lit("exit code "), F.coalesce(code, F.lit("unknown")))
    out = F.coalesce("stdout", F.lit(""))
    err = F.coalesce("stderr", F.lit(""))
    return logs.select(
        "job_id",
        error_text(F.col("stderr"), F.col("stdout"), limit).alias("detail"),
        *[reported_text(F.col("stderr"), F.col("stdout"), r, fallback).alias(f"{r}_detail") for r in REPORTER_TAILS],
        diagnostic("stdout", out).alias("stdout_note"),
        diagnostic("stderr", err).alias("stderr_note"),
    )


def failure_counts(report: DataFrame) -> DataFrame:
    """How often each error text occurred."""
    return report.groupBy("detail").agg(F.count("*").alias("n_jobs"))
