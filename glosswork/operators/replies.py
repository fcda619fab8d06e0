"""Validating replies and handing them back to their jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.frames import compute_once
from glosswork.functions.json_values import child, is_object, string_only, too_large, with_json
from glosswork.functions.text import py_strip
from glosswork.operators.batching import BATCH_KEY


def pair_replies(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """Batches with their replies, NULL where none has arrived. ``infer`` output
    is already paired."""
    on = reduce(lambda a, b: a & b, [F.col(f"b.{k}").eqNullSafe(F.col(f"r.{k}")) for k in BATCH_KEY])
    picked = [F.col(f"r.{c}") for c in replies.columns if c in ("raw", "error")]
    return batches.alias("b").join(replies.alias("r"), on, "left").select("b.*", *picked)


def audit_replies(paired: DataFrame) -> DataFrame:
    """Check each reply against the ids that were asked for.

    ``paired`` has the batch key, ``job_ids``, ``raw`` and optionally ``error``.
    Adds ``answered`` (a reply or an error is there), ``translations`` (the
    usable id/text pairs), ``defect`` and ``detail``; the first rule broken decides:
    ``backend``, ``too_large`` (over what can be parsed), ``json``, ``missing_translations``, ``duplicate``, ``omitted``, ``unexpected``,
    ``count``. One defect fails the whole batch. A batch and its reply are one
    row, so everything here is a projection: nothing is exploded or shuffled.
    """
    if "error" not in paired.columns:
        paired = paired.withColumn("error", F.lit(None).cast("string"))
    value = with_json(paired, py_strip(F.col("raw")), "_v")
    # One cast opens all rows; a row that is no object becomes NULL, a member that
    # is no string keeps its own type and is sorted out below.
    rows = value.withColumn(
        "_rows",
        F.try_variant_get(F.col("_v"), "$.translations", "array<struct<id: variant, text: variant>>"),
    )
    pairs = F.transform(
        "_rows",
        lambda r: F.struct(string_only(r["id"]).alias("id"), py_strip(string_only(r["text"])).alias("text")),
    )
    usable = F.filter(pairs, lambda p: p["id"].isNotNull() & (p["text"] != ""))
    checked = rows.withColumn("translations", usable).withColumn(
        "_ids", F.transform("translations", lambda p: p["id"])
    )
    repeated = F.get(
        F.filter(F.transform("_ids", lambda i, n: F.when(F.array_position("_ids", i) != n + 1, i)),
                 lambda i: i.isNotNull()),
        F.lit(0),
    )
    omitted = F.size(F.array_except("job_ids", "_ids"))
    unexpected = F.size(F.array_except("_ids", "job_ids"))
    audited = checked.withColumns({"_dup": repeated, "_omitted": omitted, "_unexpected": unexpected})
    defect = (
        F.when(F.col("error").isNotNull(), "backend")
        .when(F.col("raw").isNull(), F.lit(None).cast("string"))
        .when(F.col("_v").isNull() & too_large(F.col("raw")), "too_large")
        .when(F.col("_v").isNull(), "json")
        .when(F.col("_rows").isNull(), "missing_translations")
        .when(F.col("_dup").isNotNull(), "duplicate")
        .when(F.col("_omitted") > 0, "omitted")
        .when(F.col("_unexpected") > 0, "unexpected")
        .when(F.size("_ids") != F.size("job_ids"), "count")
    )
    audited = compute_once(audited, {"defect": defect})
    detail = (
        F.when(F.col("defect") == "backend", F.col("error"))
        .when(F.col("defect") == "too_large", "reply is too large to be read")
        .when(F.col("defect") == "json", "reply is not valid JSON")
        .when(F.col("defect") == "missing_translations", "reply has no translations array")
        .when(F.col("defect") == "duplicate", F.concat(F.lit("reply repeats id "), "_dup"))
        .when(F.col("defect") == "omitted", F.concat(F.lit("reply omits "), F.col("_omitted"), F.lit(" item(s)")))
        .when(F.col("defect") == "unexpected",
              F.concat(F.lit("reply has "), F.col("_unexpected"), F.lit(" unexpected item(s)")))
        .when(F.col("defect") == "count", "reply has another number of items than the batch")
    )
    return audited.withColumns({"detail": detail, "answered": _answered()}).drop("_v", "_rows", "_ids", "_dup", "_omitted", "_unexpected")


def _answered() -> Column:
    return F.col("raw").isNotNull() | F.col("error").isNotNull()


def job_answers(audited: DataFrame) -> DataFrame:
    """One row per job of every answered batch: ``result`` or ``error``."""
    by_id = F.map_from_entries("translations")
    good = F.transform("job_ids", lambda j: F.struct(
        j.alias("job_id"), F.try_element_at(by_id, j).alias("result"), F.lit(None).cast("string").alias("error")))
    bad = F.transform("job_ids", lambda j: F.struct(
        j.alias("job_id"), F.lit(None).cast("string").alias("result"), F.col("detail").alias("error")))
    return audited.where("answered").select(
        F.inline(F.when(F.col("defect").isNull(), good).otherwise(bad))
    )


def scatter(jobs: DataFrame, audited: DataFrame) -> DataFrame:
    """Give each job its result or its batch's error; a job with neither got no
    answer in time, which is an error too."""
    joined = jobs.join(job_answers(audited), "job_id", "left")
    return joined.withColumn(
        "error",
        F.when(F.col("result").isNull(), F.coalesce("error", F.lit("no translation was returned"))),
    )


def audit_single(replies: DataFrame) -> DataFrame:
    """Check replies of the direct transport: ``{"translation": string}``.

    Adds ``translation`` (stripped) and ``defect``: ``too_large``, ``json``,
    ``object`` or ``empty``.
    """
    value = with_json(replies, py_strip(F.col("raw")), "_v")
    text = py_strip(string_only(child(F.col("_v"), "$.translation")))
    return (
        value.withColumn("_text", text)
        .withColumn(
            "defect",
            F.when(F.col("_v").isNull() & too_large(F.col("raw")), "too_large")
            .when(F.col("_v").isNull(), "json")
            .when(~is_object(F.col("_v")), "object")
            .when(F.coalesce(F.col("_text"), F.lit("")) == "", "empty"),
        )
        .withColumn("translation", F.when(F.col("defect").isNull(), F.col("_text")))
        .drop("_v", "_text")
    )


def audit_direct(paired: DataFrame) -> DataFrame:
    """``audit_replies`` for calls that carry one text each."""
    single = audit_single(paired)
    failed = F.when(F.col("error").isNotNull(), "backend").when(F.col("raw").isNotNull(), F.col("defect"))
    pair = F.struct(F.get("job_ids", F.lit(0)).alias("id"), F.col("translation").alias("text"))
    detail = F.when(F.col("defect") == "backend", F.col("error")).when(
        F.col("defect").isNotNull(), F.concat(F.lit("reply is not usable: "), "defect")
    )
    return (
        single.withColumn("defect", failed)
        .withColumn("translations", F.when(F.col("translation").isNotNull(), F.array(pair)))
        .withColumns({"detail": detail, "answered": _answered()})
        .drop("translation")
    )


def deadline_audit(jobs: DataFrame, completions: DataFrame, limit_s: int) -> DataFrame:
    """Add ``done_at`` (first completion within ``limit_s`` of submission) and
    ``timed_out``. ``job_id`` is unique in ``jobs``."""
    due = F.col("submitted_at") + F.make_dt_interval(secs=F.lit(float(limit_s)))
    in_time = (
        completions.join(jobs.select("job_id", "submitted_at"), "job_id")
        .where(F.col("done_at").between(F.col("submitted_at"), due))
        .groupBy("job_id")
        .agg(F.min("done_at").alias("done_at"))
    )
    return jobs.join(in_time, "job_id", "left").withColumn("timed_out", F.col("done_at").isNull())


# What a translation has to keep, by class, most specific first.
TOKEN_PATTERNS = {
    "url": r"https?://[A-Za-z0-9./_~%?=&#:@+-]+",
    "tag": r"</?[A-Za-z][A-Za-z0-9]*>",
    "placeholder": r"\{[A-Za-z][A-Za-z0-9]*\}",
    "citation": r"\[[0-9]+\]",
    "number": r"[0-9]+(?:\.[0-9]+)?",
}


def preservation_audit(pairs: DataFrame) -> DataFrame:
    """Count tokens lost and added per segment and class.

    ``pairs`` has ``seg_id, source, output``. Both sides are counted in one
    aggregation (multisets, so repeats matter) instead of being joined.
    """
    def counted(cls: str, pattern: str, side: str, weight: int) -> Column:
        found = F.regexp_extract_all(F.coalesce(F.col(side), F.lit("")), F.lit(f"({pattern})"), F.lit(1))
        return F.transform(
            found, lambda t: F.struct(F.lit(cls).alias("cls"), t.alias("token"), F.lit(weight).alias("w"))
        )

    every = [
        counted(cls, pattern, side, weight)
        for cls, pattern in TOKEN_PATTERNS.items()
        for side, weight in (("source", 1), ("output", -1))
    ]
    # One segment's tokens come from one row; one shuffle serves both groupings.
    spread = pairs.select("seg_id", F.inline(F.concat(*every))).repartition("seg_id", "cls")
    balance = spread.groupBy("seg_id", "cls", "token").agg(F.sum("w").alias("d"))
    return balance.groupBy("seg_id", "cls").agg(
        F.sum(F.greatest("d", F.lit(0))).alias("lost"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("added")
    )
