"""Live outcomes and counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glosswork.operators.events import BLOCKS, label_events
from glosswork.operators.reports import model_label, status_columns

_OUTCOME = "job_id bigint, outcome string, error string, n_progress bigint, last_label string"
# The summary of a stretch of a job's events: up to its first end, if it has one.
_STRETCH = "job_id bigint, at bigint, n bigint, label string, outcome string, error string"
_SUMMARY = ["at", "n", "label", "outcome", "error"]
_SUMMED = pa.schema([("job_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()),
                     ("label", pa.string()), ("outcome", pa.string()), ("error", pa.string())])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums up a partition of a trigger's events by job and block, all blocks at once."""
    parts = list(batches)
    if not parts:
        return
    events = pa.Table.from_batches(parts).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get).sort_values(["job_id", "at", "seq"], kind="stable")
    block = ["job_id", "at"]
    ended = events["outcome"].notna()
    before = ended.astype("int64").groupby([events[c] for c in block], dropna=False).cumsum() - ended
    events = events[before == 0]  # up to and with the first end
    told = events["outcome"].isna()
    events = events.assign(n=told.astype("int64"), label=events["label"].where(told, None))
    summed = events.groupby(block, dropna=False, sort=False).agg(
        n=("n", "sum"), label=("label", "last"), outcome=("outcome", "last"), error=("error", "last"))
    out = summed.reset_index()[[f.name for f in _SUMMED]]
    yield from pa.Table.from_pandas(out, schema=_SUMMED, preserve_index=False).to_batches(max_chunksize=2000)


class OutcomeTracker(StatefulProcessor):
    """Counts a job's progress until its first error or finish, reports that
    once, and ignores what follows. State is one row per job, input one row per
    block of sequence numbers."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState(
            "seen", "done boolean, n_progress bigint, last_label string", ttlDurationMs=self.ttl_ms
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done, n_progress, last = self.seen.get() if self.seen.exists() else (False, 0, None)
        if done:
            for _ in rows:
                pass
            return
        stretches = pd.concat([frame[_SUMMARY] for frame in rows], ignore_index=True).sort_values("at", kind="stable")
        for stretch in stretches.itertuples(index=False):
            if stretch.n:
                n_progress, last = n_progress + int(stretch.n), stretch.label
            if isinstance(stretch.outcome, str):
                done = True
                error = stretch.error if isinstance(stretch.error, str) else None
                yield pd.DataFrame([(key[0], stretch.outcome, error, n_progress, last)],
                                   columns=["job_id", "outcome", "error", "n_progress", "last_label"])
                break
        self.seen.update((done, n_progress, last))

    def close(self) -> None:
        pass


def outcome_stream(events: DataFrame, ttl_ms: int | None = None, block: int = BLOCKS[0]) -> DataFrame:
    """One row per finished job of a stream of ``job_id, seq, body``. Events of a
    job must arrive in order from one trigger to the next.

    As in ``job_outcome``, events are summed up by blocks of sequence numbers first, so a
    job with most of a trigger's events is spread over all tasks, and the task of the job
    itself gets one row a block. Sequence numbers are unique in a job.

    ``ttl_ms`` forgets jobs that were silent for so long; a stream that never
    ends needs it. It makes Spark run a trigger even without new input, so a run
    with ``availableNow`` has to leave it unset.
    """
    labelled = label_events(events).select(
        F.col("job_id").cast("bigint").alias("job_id"), F.expr(f"CAST(floor(seq / {block}) AS BIGINT)").alias("at"),
        F.col("seq").cast("bigint").alias("seq"), "label", "outcome", "error")
    stretches = labelled.repartition("job_id", "at").mapInArrow(_stretches, _STRETCH)
    return stretches.groupBy("job_id").transformWithStateInPandas(
        OutcomeTracker(ttl_ms), outputStructType=_OUTCOME, outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


def status_stream(audited: DataFrame) -> DataFrame:
    """Running counters per model; write in complete or update mode."""
    return audited.groupBy(model_label()).agg(*status_columns())


def windowed_status_stream(audited: DataFrame, ts: str, width: str, delay: str) -> DataFrame:
    """Counters per time window and model, final once the watermark has passed."""
    return (
        audited.withWatermark(ts, delay)
        .groupBy(F.window(ts, width), model_label())
        .agg(*status_columns())
    )
