"""Grouping a stream of jobs into backend calls, and translating it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glosswork.operators.inference import Translator, infer
from glosswork.operators.replies import audit_replies
from glosswork.options import RunOptions
from glosswork.sources.ledger import ledger_of
from glosswork.sources.requests import route_model, triage_requests

_JOB = "job_id string, effective_model string, messages string"
_CALL = "shard int, batch_no bigint, effective_model string, job_ids array<string>, payload string"


class CallPacker(StatefulProcessor):
    """Keeps one open batch per shard.

    A batch leaves when it is full or when its window, which starts with its
    first job, has passed; Spark checks the window once per trigger. Jobs that arrive
    in one trigger are taken in the order of ``queue_pos``. State is at most
    ``max_batch - 1`` jobs and a counter. No job is ever late: only
    processing time is used.
    """

    def __init__(self, max_batch: int, window_ms: int) -> None:
        self.max_batch = max_batch
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _JOB)
        self.counter = handle.getValueState("counter", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        waiting = [tuple(r) for r in self.open.get()]
        due = list(self.handle.listTimers())
        number = self._number()
        started_with = number
        if waiting and any(t <= now for t in due):
            yield self._calls(key[0], number, waiting)
            number, waiting = number + 1, []
        # With a window of zero nobody waits for company.
        limit = self.max_batch if self.window_ms else 1
        # Rows come in frames of any size and order: batches are cut once all of the
        # trigger's jobs of this shard are in order. The source's rate limit bounds them.
        arrived = pd.concat(list(rows), ignore_index=True).sort_values("queue_pos", kind="stable")
        waiting += list(arrived[["job_id", "effective_model", "messages"]].itertuples(index=False, name=None))
        full = len(waiting) - len(waiting) % limit
        for first in range(0, full, limit):
            yield self._calls(key[0], number, waiting[first: first + limit])
            number += 1
        waiting = waiting[full:]
        self.counter.update((number,))
        if number != started_with:
            for t in due:
                self.handle.deleteTimer(t)
            due = []
        if waiting:
            self.open.put([_clean(job) for job in waiting])
            if not due:
                self.handle.registerTimer(now + self.window_ms)
        else:
            self.open.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = [tuple(r) for r in self.open.get()]
        if waiting:
            number = self._number()
            self.open.clear()
            self.counter.update((number + 1,))
            yield self._calls(key[0], number, waiting)

    def close(self) -> None:
        pass

    def _number(self) -> int:
        return self.counter.get()[0] if self.counter.exists() else 0

    @staticmethod
    def _calls(shard: int, number: int, jobs: list[tuple]) -> pd.DataFrame:
        """One call per model among the batch's jobs."""
        by_model: dict[str | None, list[tuple]] = {}
        for job_id, model, messages in map(_clean, jobs):
            by_model.setdefault(model, []).append((job_id, messages))
        rows = []
        for model, members in by_model.items():
            listed = ",".join(
                f'{{"id":{json.dumps(i, ensure_ascii=False)},"messages":{m}}}' for i, m in members
            )
            rows.append((shard, number, model, [i for i, _ in members], f"[{listed}]"))
        return pd.DataFrame(rows, columns=["shard", "batch_no", "effective_model", "job_ids", "payload"])


def _clean(job: tuple) -> tuple:
    return tuple(v if isinstance(v, str) else None for v in job)


def triage_stream(requests: DataFrame) -> DataFrame:
    """Classified requests with ``accepted``; written with ``partitionBy`` on it,
    one query fills both the job folder and the reject folder."""
    triaged = triage_requests(requests)
    return triaged.withColumn("accepted", F.col("reject").isNull())


def pack_calls(jobs: DataFrame, max_batch: int, window_ms: int) -> DataFrame:
    """Backend calls from ``job_id, shard, queue_pos, effective_model, messages``.
    ``queue_pos`` orders jobs that arrive together."""
    return (
        jobs.select("job_id", F.col("shard").cast("int").alias("shard"), "queue_pos", "effective_model", "messages")
        .groupBy("shard")
        .transformWithStateInPandas(
            CallPacker(max_batch, window_ms), outputStructType=_CALL,
            outputMode="Append", timeMode="ProcessingTime",
        )
    )


def request_jobs(requests: DataFrame, options: RunOptions) -> DataFrame:
    """Jobs of the valid requests among ``req_id, body``, spread over the shards."""
    valid = triage_requests(requests).where(F.col("reject").isNull())
    return route_model(valid, options.model).select(
        F.col("req_id").cast("string").alias("job_id"),
        F.pmod(F.col("req_id"), F.lit(options.workers)).cast("int").alias("shard"),
        F.col("req_id").alias("queue_pos"),
        F.col("effective_model").cast("string").alias("effective_model"),
        "messages",
    )


def translate_stream(requests: DataFrame, translator: Translator, options: RunOptions | None = None) -> DataFrame:
    """Audited backend calls for a stream of requests.

    The sink records a trigger's output once. If Spark has to repeat a trigger, it calls
    the backend again, but for what ``options.ledger`` has recorded.
    """
    options = options or RunOptions()
    calls = pack_calls(request_jobs(requests, options), options.batch_limit, options.window_ms)
    return audit_replies(infer(calls, translator, options.parallelism, options.timeout_s, ledger_of(options)))
