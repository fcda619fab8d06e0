"""Calling the translation backend from Spark tasks.

A translator is any picklable callable ``(payload, model) -> raw reply``: it
gets the JSON job list (direct transport: the text) and the model name (None for
the backend's default) and raises to fail the batch. Its instructions to the model
are its own; what it has to return is ``{"translations": [{"id": …, "text": …}]}``
with one entry per job, or ``{"translation": …}`` for the direct transport. Spark
repeats a task that it loses; with a ``CallLedger`` the task makes only those calls again
that were not recorded. The caller writes replies once and reads them back from there.
"""

from __future__ import annotations

import json
import queue
import threading
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.operators.batching import BATCH_KEY
from glosswork.sources.ledger import CallLedger, place

TASKS_PER_CORE = 4

Translator = Callable[[str, "str | None"], str]


class OfflineTranslator:
    """Stand-in for a model: marks each job's last message with the target
    language. It lets the dataflow be tested; it does not translate."""

    def __init__(self, lang_out: str = "zh", broken_models: Sequence[str] = (), direct: bool = False) -> None:
        self.lang_out = lang_out
        self.direct = direct
        self.broken_models = frozenset(broken_models)

    def __call__(self, payload: str, model: str | None) -> str:
        if model in self.broken_models:
            raise RuntimeError(f"model {model} is not available")
        if self.direct:
            return json.dumps({"translation": f"[{self.lang_out}] {payload}"}, ensure_ascii=False)
        rows = [
            {"id": job["id"], "text": f"[{self.lang_out}] {job['messages'][-1]['content']}"}
            for job in json.loads(payload)
        ]
        return json.dumps({"translations": rows}, ensure_ascii=False, separators=(",", ":"))


class TimedCalls:
    """Calls one after the other; each returns the reply, or raises TimeoutError after
    ``timeout_s`` seconds.

    They run in a thread of their own, which serves until a call is late. It is left behind
    then, as Python cannot end a thread, and the next call starts another. It cannot hold up the
    task or its worker's end; a translator that starts programs or opens connections should
    bound those itself as well. ``close`` lets the thread end.
    """

    def __init__(self, translator: Translator, timeout_s: float | None) -> None:
        self.translator, self.timeout_s = translator, timeout_s
        self.asked: queue.SimpleQueue | None = None
        self.answers: queue.SimpleQueue | None = None

    def __call__(self, payload: str, model: str | None) -> str:
        if self.timeout_s is None:
            return self.translator(payload, model)
        if self.asked is None:
            self.asked, self.answers = queue.SimpleQueue(), queue.SimpleQueue()
            threading.Thread(target=_serve, args=(self.translator, self.asked, self.answers), daemon=True).start()
        self.asked.put((payload, model))
        try:
            raw, problem = self.answers.get(timeout=self.timeout_s)
        except queue.Empty:
            self.close()
            raise TimeoutError(f"timed out after {self.timeout_s:g} s") from None
        if problem is not None:
            raise problem
        return raw

    def close(self) -> None:
        if self.asked is not None:
            self.asked.put(None)
            self.asked = None


def _serve(translator: Translator, asked: queue.SimpleQueue, answers: queue.SimpleQueue) -> None:
    while (call := asked.get()) is not None:
        try:
            answers.put((translator(*call), None))
        except BaseException as problem:  # handed to the caller, whatever it is
            answers.put((None, problem))


def call_within(translator: Translator, payload: str, model: str | None, timeout_s: float | None) -> str:
    """One call of ``TimedCalls``."""
    calls = TimedCalls(translator, timeout_s)
    try:
        return calls(payload, model)
    finally:
        calls.close()


def infer(batches: DataFrame, translator: Translator, parallelism: int | None = None,
          timeout_s: float | None = None, ledger: CallLedger | None = None) -> DataFrame:
    """One backend call per row; adds ``raw`` (reply) or ``error``.

    The calls are always dealt out over ``parallelism`` tasks, which bounds how many
    run at once: payloads are small, so the tasks of their own shuffle would be
    merged into a few that make all calls one after the other. Without it there are
    TASKS_PER_CORE tasks for each core, so that a lost task repeats few calls.

    A call that raises or takes longer than ``timeout_s`` fails its batch and nothing
    else. With a ``ledger`` each reply is recorded as soon as it is there, and a call
    whose reply is recorded is not made; a task then has the calls of a stretch of the
    ledger's places, in their order.
    """
    tasks = parallelism or TASKS_PER_CORE * batches.sparkSession.sparkContext.defaultParallelism
    if ledger is None:
        batches = batches.repartition(tasks, F.xxhash64("job_ids"))
    else:
        placed = batches.withColumn("_place", place(F.col("payload")))
        stretch = F.shiftright(F.col("_place") * F.lit(tasks), 32).cast("int")
        dealt = placed.repartitionById(tasks, stretch)
        # Streams cannot be sorted; the few calls that a trigger gives a task go as they come.
        batches = (dealt if batches.isStreaming else dealt.sortWithinPartitions("_place")).drop("_place")
    kept = [*BATCH_KEY, "job_ids"]
    schema = T.StructType(
        [f for f in batches.schema if f.name in kept]
        + [T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())]
    )
    kept = [f.name for f in schema][:-2]

    def reply(calls, records, payload: str, model: str | None) -> str:
        known = records.get(payload, model) if records else None
        if known is None:
            known = calls(payload, model)
            if records:
                records.put(payload, model, known)
        return known

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls, records = TimedCalls(translator, timeout_s), ledger.open() if ledger else None
        try:
            for frame in frames:
                raws: list[str | None] = []
                errors: list[str | None] = []
                for payload, model in zip(frame["payload"], frame["effective_model"]):
                    try:
                        raws.append(reply(calls, records, payload, model if isinstance(model, str) else None))
                        errors.append(None)
                    except Exception as problem:  # one bad call fails its batch, not the job
                        raws.append(None)
                        errors.append(f"batch translation failed: {problem}")
                yield frame[kept].assign(raw=pd.Series(raws, index=frame.index, dtype=object),
                                         error=pd.Series(errors, index=frame.index, dtype=object))
        finally:
            calls.close()

    return batches.mapInPandas(call, schema)
