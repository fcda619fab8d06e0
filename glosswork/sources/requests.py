"""Translation requests: one JSON body per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.frames import compute_once
from glosswork.functions.json_values import child, elements, is_object, truthy_text, with_json
from glosswork.options import BACKEND_DEFAULT_MODELS, DEFAULT_REQUEST_MODEL, MAX_REQUEST_BYTES
from glosswork.functions.text import py_strip


def triage_requests(requests: DataFrame, max_bytes: int = MAX_REQUEST_BYTES) -> DataFrame:
    """Classify request bodies and take valid ones apart.

    Adds ``reject`` (NULL for valid requests, else the first rule broken:
    ``size``, ``json``, ``object``, ``messages``, ``element``), ``messages``
    (the array as JSON text, as it was sent unless a key is repeated) and
    ``requested_model``. Of repeated keys the last counts, for the check and for
    what is passed on. A stateless projection, so it runs on streams too.
    """
    size = F.octet_length("body")
    # Bodies outside the limits are never parsed.
    in_limits = F.when(size.between(1, max_bytes), F.col("body"))
    parsed = with_json(requests, in_limits, "_v").withColumn(
        "_messages", elements(F.col("_v"), "$.messages")
    )
    reject = (
        F.when(~F.coalesce(size.between(1, max_bytes), F.lit(False)), "size")
        .when(F.col("_v").isNull(), "json")
        .when(~is_object(F.col("_v")), "object")
        .when(F.coalesce(F.size("_messages"), F.lit(0)) < 1, "messages")
        .when(F.exists("_messages", lambda m: ~is_object(m)), "element")
    )
    return (
        compute_once(parsed, {"reject": reject})
        .withColumn("messages", F.when(F.col("reject").isNull(), _checked_text("$.messages")))
        .withColumn(
            "requested_model",
            F.when(
                F.col("reject").isNull(),
                F.coalesce(truthy_text(child(F.col("_v"), "$.model")), F.lit(DEFAULT_REQUEST_MODEL)),
            ),
        )
        .drop("_v", "_messages")
    )


def _checked_text(path: str) -> Column:
    """The member's own text if it says the same as the value that was checked, which
    it does unless a key is repeated; else that value's text."""
    own = F.get_json_object("body", path)
    checked = F.to_json(child(F.col("_v"), path))
    return F.when(F.to_json(F.try_parse_json(own)) == checked, own).otherwise(checked)


def effective_model(requested: Column, override: str | None = None) -> Column:
    """Model a request is routed to; NULL stands for the backend's own default.

    A non-empty override wins as it is. Names are case-sensitive.
    """
    if override:
        return F.lit(override)
    name = py_strip(requested)
    return F.when((name != "") & ~name.isin(*BACKEND_DEFAULT_MODELS), name)


def route_model(jobs: DataFrame, override: str | None = None) -> DataFrame:
    return jobs.withColumn("effective_model", effective_model(F.col("requested_model"), override))
