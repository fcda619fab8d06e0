"""Progress and terminal events of translation jobs: ``job_id, seq, body``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.frames import compute_once
from glosswork.functions.paths import resolve
from glosswork.functions.json_values import (
    child, is_json_null, is_object, number, string_only, truthy_text, with_json,
)

DEFAULT_STAGE = "working"
DEFAULT_ERROR = "translation failed"
OUTPUTS = ("mono_pdf", "dual_pdf")


def parse_events(events: DataFrame) -> DataFrame:
    """Add the parsed body as ``event`` and its ``type``; bodies that are not
    JSON objects are skipped."""
    parsed = with_json(events, F.col("body"), "event").where(is_object(F.col("event")))
    return compute_once(parsed, {"type": string_only(child(F.col("event"), "$.type"))})


def percent_text(value: Column) -> Column:
    """Fractions of one become percent; rounded half to even, no decimals."""
    percent = F.when(value.between(0, 1), value * 100).otherwise(value)
    rounded = F.bround(percent, 0)
    return F.when((rounded == 0) & (percent < 0), "-0").otherwise(
        rounded.try_cast("decimal(38,0)").cast("string")
    )


def progress(events: DataFrame) -> DataFrame:
    """Progress events with ``stage`` and ``label`` (``stage: 12%``, or just the
    stage if the value is not numeric).

    The overall figure counts if its key exists, even as null; an object value
    is ``current / total`` if both are numbers and the total is not zero.
    """
    return _labelled(parse_events(events).where(F.col("type") == "progress")).select(
        "job_id", "seq", "stage", "label"
    )


def _labelled(parsed: DataFrame) -> DataFrame:
    # One step per level of use: a member is looked up once, however often the
    # next step refers to it.
    members = parsed.withColumns(
        {
            "stage": F.coalesce(
                *[truthy_text(child(F.col("event"), f"$.{k}")) for k in ("stage", "phase", "name")],
                F.lit(DEFAULT_STAGE),
            ),
            "_raw": F.coalesce(
                child(F.col("event"), "$.overall_progress"), child(F.col("event"), "$.progress")
            ),
        }
    )
    numbers = members.withColumns(
        {
            "_plain": number(F.col("_raw")),
            "_current": number(child(F.col("_raw"), "$.current")),
            "_total": number(child(F.col("_raw"), "$.total")),
        }
    )
    # Members of a value that is no object are absent, so at most one is set.
    value = F.coalesce("_plain", F.col("_current") / F.nullif(F.col("_total"), F.lit(0.0)))
    percent = numbers.withColumn("_value", value).withColumn("_pct", percent_text(F.col("_value")))
    return percent.withColumn(
        "label", F.coalesce(F.concat("stage", F.lit(": "), "_pct", F.lit("%")), F.col("stage"))
    ).drop("_raw", "_plain", "_current", "_total", "_value", "_pct")


def terminal_columns(parsed: DataFrame) -> DataFrame:
    """``outcome``, ``error`` and the two output paths an event would give its job if
    it came first."""
    result = child(F.col("event"), "$.translate_result")
    empty = result.isNull() | is_json_null(result)
    message = F.coalesce(truthy_text(child(F.col("event"), "$.error")), F.lit(DEFAULT_ERROR))
    return parsed.withColumns(
        {
            "outcome": F.when(F.col("type") == "error", "error")
            .when((F.col("type") == "finish") & empty, "empty_result")
            .when(F.col("type") == "finish", "finish"),
            "error": F.when(F.col("type") == "error", message),
            **{
                name: F.when(F.col("type") == "finish", truthy_text(child(result, f"$.{name}_path")))
                for name in OUTPUTS
            },
        }
    )


def label_events(events: DataFrame) -> DataFrame:
    """Progress and terminal events as ``job_id, seq, label, outcome, error`` and the
    output paths; ``outcome`` is NULL for progress."""
    known = parse_events(events).where(F.col("type").isin("progress", "error", "finish"))
    return _labelled(terminal_columns(known)).select("job_id", "seq", "label", "outcome", "error", *OUTPUTS)


# Width of a block of sequence numbers, and of a block of such blocks.
BLOCKS = (4096, 4096 * 4096)
_ENDING = ("outcome", "error", *OUTPUTS)


def job_outcome(events: DataFrame, blocks: Sequence[int] = BLOCKS) -> DataFrame:
    """One row per job: ``outcome``, ``error``, ``n_progress`` and ``last_label``.

    The first error or finish by ``seq`` decides; what comes later is ignored,
    progress included. A job without one ends as ``no_result``.

    Summaries of adjoining stretches of a job's events combine into the summary
    of both, so events are folded by blocks of sequence numbers, then blocks by
    larger blocks, then those by job. A block of 4096 numbers holds at most 4096
    events, so no task ever gathers a whole busy job, events are parsed once,
    and nothing is joined.
    """
    return _outcomes(events, blocks).select("job_id", "outcome", "error", "n_progress", "last_label")


def outcome_results(events: DataFrame, output_dir: str, blocks: Sequence[int] = BLOCKS) -> DataFrame:
    """``job_id, outcome, error, mono_pdf, dual_pdf`` of every job: the outputs that its
    terminal event names, as absolute paths (relative ones start at ``output_dir``).
    NULL where the event names none or the job did not finish. This is what
    ``output_manifest`` and ``result_records`` take."""
    ended = _outcomes(events, blocks)
    return ended.select("job_id", "outcome", "error", *[resolve(F.col(c), F.lit(output_dir)).alias(c) for c in OUTPUTS])


def _outcomes(events: DataFrame, blocks: Sequence[int]) -> DataFrame:
    labelled = label_events(events)
    ended = F.col("outcome").isNotNull()
    leaves = labelled.select(
        "job_id", F.col("seq").alias("at"), F.when(ended, 0).otherwise(1).cast("bigint").alias("n"),
        F.when(~ended, F.col("label")).alias("label"), *_ENDING,
    )
    for width, below in zip(blocks, (1, *blocks)):
        leaves = _fold(leaves, ["job_id", F.floor(F.col("at") / (width // below)).alias("at")])
    # Events that count for nothing still make their job known.
    silent = events.groupBy("job_id").agg(F.lit(0).cast("bigint").alias("n")).select(
        "job_id", F.lit(-1).cast("bigint").alias("at"), "n",
        *[F.lit(None).cast("string").alias(c) for c in ("label", *_ENDING)],
    )
    return _fold(leaves.unionByName(silent), ["job_id"]).select(
        "job_id", F.coalesce("outcome", F.lit("no_result")).alias("outcome"), "error",
        F.col("n").alias("n_progress"), F.col("label").alias("last_label"), *OUTPUTS,
    )


def _fold(parts: DataFrame, by: list) -> DataFrame:
    """Combine summaries in order of ``at`` up to the first that has an outcome."""
    listed = parts.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("at", "n", "label", *_ENDING))).alias("_p")
    )
    end = F.get(F.filter("_p", lambda p: p["outcome"].isNotNull()), F.lit(0))
    cut = listed.withColumn("_end", end).withColumn(
        "_p", F.when(F.col("_end").isNull(), F.col("_p")).otherwise(
            F.filter("_p", lambda p: p["at"] <= F.col("_end.at")))
    )
    keys = [c for c in listed.columns if c != "_p"]
    spoken = F.filter(F.transform("_p", lambda p: p["label"]), lambda label: label.isNotNull())
    return cut.select(
        *keys,
        F.aggregate("_p", F.lit(0).cast("bigint"), lambda total, p: total + p["n"]).alias("n"),
        F.try_element_at(spoken, F.lit(-1)).alias("label"),
        *[F.col(f"_end.{c}").alias(c) for c in _ENDING],
    )
