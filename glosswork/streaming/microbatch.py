"""Backend calls in micro-batches, with queues of any size and a sink that bears replays.

``calls.pack_calls`` keeps a shard in one task, as keyed state does. Here a trigger's
jobs are a table like any other: FIFO numbers come from a range-partitioned sort, so one
shard with all the jobs of a trigger runs on all cores, and the batch that is not yet
full is a small table that the next trigger reads.

Each step (a trigger, or a look at the windows between two) goes

    jobs + open batches -> plan: calls, open batches, counters -> "planned"
    calls -> replies                                           -> "done"

and the log is written after the tables it speaks of. A trigger that Spark repeats is
skipped when it is done, and goes on from its plan when that was made, so the same calls
are asked again; with a call ledger, only those without a record. Readers see what is done.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glosswork.operators.batching import build_payload
from glosswork.operators.inference import Translator, infer
from glosswork.operators.ranking import fifo_number
from glosswork.operators.replies import audit_replies
from glosswork.options import RunOptions
from glosswork.sources.ledger import ledger_of
from glosswork.streaming.calls import request_jobs

_JOB = "shard int, job_id string, effective_model string, messages string"
_TABLES = {
    "queue": f"{_JOB}, turn int, queue_pos bigint",
    "open": f"{_JOB}, place bigint",
    "shards": "shard int, base bigint, full bigint, next_no bigint, opened_ms bigint",
    "calls": "shard int, batch_no bigint, effective_model string, job_ids array<string>, payload string",
}
_LOG = "seq bigint, step bigint, batch_id bigint, phase string, earliest_ms bigint"


@dataclass(frozen=True)
class Entry:
    """The newest line of the log. ``earliest_ms`` is when the oldest open batch began."""

    seq: int = -1
    step: int = -1
    batch_id: int = -1
    phase: str = "done"
    earliest_ms: int | None = None


class StepLog:
    """The newest state of a query, in two places that are overwritten by turns: whoever is
    stopped while writing one leaves the other as it was."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        spark.createDataFrame([], _LOG).write.mode("ignore").parquet(f"{path}/slot=none")

    def newest(self) -> Entry:
        rows = self.spark.read.schema(f"{_LOG}, slot string").parquet(self.path)
        found = rows.orderBy(F.desc("seq")).drop("slot").first()
        return Entry(**found.asDict()) if found else Entry()

    def put(self, entry: Entry) -> Entry:
        row = (entry.seq, entry.step, entry.batch_id, entry.phase, entry.earliest_ms)
        self.spark.createDataFrame([row], _LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/slot={entry.seq % 2}")
        return entry


class MicroBatcher:
    """A ``foreachBatch`` function for ``job_id, shard, queue_pos, effective_model, messages``
    (ids unique within a trigger, ``queue_pos`` not null).

    A batch leaves when it is full or when its window, which starts with its first job,
    has passed; what waits comes before what arrives. ``answer`` makes a table of replies
    from a table of calls; its columns are ``reply_schema``. One object at a time may work on
    a ``root``, a folder that driver and executors share.
    """

    def __init__(self, spark: SparkSession, root: str, max_batch: int, window_ms: int,
                 answer: Callable[[DataFrame], DataFrame] | None = None,
                 clock: Callable[[], int] = lambda: time.time_ns() // 1_000_000) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        # With a window of zero nobody waits for company.
        self.limit, self.window_ms = max_batch if window_ms else 1, window_ms
        self.answer, self.clock = answer, clock
        self.log = StepLog(spark, f"{self.root}/log")
        self.last = self.log.newest()
        self.busy = threading.Lock()

    def __call__(self, jobs: DataFrame, batch_id: int) -> None:
        with self.busy:
            self._finish()
            if batch_id > self.last.batch_id:
                columns = ["shard", "job_id", "effective_model", "messages", F.lit(1).alias("turn"), "queue_pos"]
                self._step(jobs.select(*columns), batch_id, close=False)

    def flush(self, everything: bool = False) -> None:
        """Send open batches whose window has passed, or all of them."""
        with self.busy:
            self._finish()
            began = self.last.earliest_ms
            if began is not None and (everything or began + self.window_ms <= self.clock()):
                self._step(None, self.last.batch_id, close=everything)

    def calls(self) -> DataFrame:
        return self._done("calls", _TABLES["calls"])

    def replies(self) -> DataFrame:
        schema = self.answer(self.spark.createDataFrame([], _TABLES["calls"])).schema
        return self._done("replies", schema)

    def _done(self, table: str, schema) -> DataFrame:
        done = self.last.step if self.last.phase == "done" else self.last.step - 1
        found = self.spark.createDataFrame([], schema)
        if done < 0:
            return found
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
        read = self.spark.read.schema(f"{fields}, step bigint").parquet(f"{self.root}/{table}")
        return read.where(F.col("step") <= done).drop("step")

    def _path(self, table: str, step: int) -> str:
        """Calls and replies stay; of the others only the last step counts, so they take turns."""
        return f"{self.root}/{table}/step={step}" if table in ("calls", "replies") else f"{self.root}/{table}/slot={step % 2}"

    def _state(self, table: str) -> DataFrame:
        """A table of the last step; nothing before the first."""
        if self.last.step < 0:
            return self.spark.createDataFrame([], _TABLES[table])
        return self.spark.read.schema(_TABLES[table]).parquet(self._path(table, self.last.step))

    def _kept(self, frame: DataFrame, table: str, step: int) -> DataFrame:
        path = self._path(table, step)
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def _step(self, arrived: DataFrame | None, batch_id: int, close: bool) -> None:
        now, step = self.clock(), self.last.step + 1
        shards = self._state("shards").select("shard", "next_no", "opened_ms").withColumn(
            "due", F.lit(close) | (F.col("opened_ms") + self.window_ms <= now)).withColumn("due", F.coalesce("due", F.lit(False)))
        waiting = self._state("open").join(shards, "shard")
        queue = waiting.where("NOT due").select(
            "shard", "job_id", "effective_model", "messages", F.lit(0).alias("turn"), F.col("place").alias("queue_pos"))
        if arrived is not None:
            # The trigger's rows are read once, in the session of the stream.
            arrived.write.mode("overwrite").parquet(self._path("queue", step))
            queue = queue.unionByName(self.spark.read.schema(_TABLES["queue"]).parquet(self._path("queue", step)))
        numbered = fifo_number(queue.select("shard", "turn", "queue_pos", "job_id"), ["shard"], ["turn", "queue_pos", "job_id"],
                               keep=lambda frame, name: self._kept(frame, name, step))
        numbered = self._kept(numbered, "numbers", step)
        counts = numbered.groupBy("shard").agg(
            F.count("*").alias("n"), F.count_if(F.col("turn") == 0).alias("n_waited"))
        zero = F.lit(0).cast("bigint")
        # One row a shard: where its numbers start, and how many jobs leave in full batches.
        plan = shards.join(counts, "shard", "full").select(
            "shard", F.coalesce("n", zero).alias("n"), F.coalesce("n_waited", zero).alias("n_waited"), "opened_ms",
            (F.coalesce("next_no", zero) + F.coalesce(F.col("due") & F.col("opened_ms").isNotNull(), F.lit(False)).cast("bigint")).alias("base"),
        ).withColumn("full", F.expr(f"n - n % {self.limit}"))
        # What is left opens a batch now, or fills up one that was open before.
        began = F.when(F.col("n") == F.col("full"), None).when(
            (F.col("full") == 0) & (F.col("n_waited") > 0), F.col("opened_ms")).otherwise(F.lit(now))
        plan = self._kept(plan.select(
            "shard", "base", "full", F.expr(f"base + full div {self.limit}").alias("next_no"),
            began.cast("bigint").alias("opened_ms")), "shards", step)
        place = numbered.join(plan.select("shard", "base", "full"), "shard")
        leaves = place.where("rn <= full").select(
            "shard", "turn", "queue_pos", "job_id",
            F.expr(f"base + (rn - 1) div {self.limit}").alias("batch_no"), F.expr(f"CAST((rn - 1) % {self.limit} AS INT)").alias("ord"))
        keys = ["shard", "turn", "queue_pos", "job_id"]
        late = waiting.where("due").select(
            "shard", "job_id", "effective_model", "messages", F.col("next_no").alias("batch_no"), F.col("place").cast("int").alias("ord"))
        members = queue.join(leaves, keys).select("shard", "job_id", "effective_model", "messages", "batch_no", "ord")
        self._kept(build_payload(members.unionByName(late)), "calls", step)
        # Fewer than max_batch jobs a shard stay.
        rest = place.where("rn > full").select(*keys, (F.col("rn") - F.col("full") - 1).alias("place"))
        self._kept(queue.join(rest, keys).select("shard", "job_id", "effective_model", "messages", "place"), "open", step)
        earliest = plan.agg(F.min("opened_ms")).first()[0]
        self.last = self.log.put(Entry(2 * step, step, batch_id, "planned", earliest))
        self._finish()

    def _finish(self) -> None:
        if self.last.phase == "planned":
            if self.answer is not None:
                calls = self.spark.read.schema(_TABLES["calls"]).parquet(self._path("calls", self.last.step))
                self._kept(self.answer(calls), "replies", self.last.step)
            done = Entry(self.last.seq + 1, self.last.step, self.last.batch_id, "done", self.last.earliest_ms)
            self.last = self.log.put(done)


def attend(query: StreamingQuery, batcher: MicroBatcher, poll_s: float = 0.1) -> None:
    """Look at the windows while the query runs; once it has ended, send all that is open."""
    while query.isActive:
        query.awaitTermination(poll_s)  # raises if the query has failed
        batcher.flush()
    batcher.flush(everything=True)


def translator_of(translator: Translator, options: RunOptions) -> Callable[[DataFrame], DataFrame]:
    """Audited replies of the backend, as the ``answer`` of a batcher."""
    return lambda calls: audit_replies(infer(calls, translator, options.parallelism, options.timeout_s, ledger_of(options)))


def start_translation(requests: DataFrame, translator: Translator, options: RunOptions, root: str, **trigger) -> tuple[StreamingQuery, MicroBatcher]:
    """Translate a stream of ``req_id, body``; ``attend`` to the query that comes back.

    Everything lies below ``root``: the stream's checkpoint, the tables and, unless
    ``options.ledger`` names another folder, nothing else. Starting again on the same root
    goes on where the last run stopped."""
    spark = requests.sparkSession
    batcher = MicroBatcher(spark, f"{root}/steps", options.max_batch, options.window_ms, translator_of(translator, options))
    writer = request_jobs(requests, options).writeStream.foreachBatch(batcher)
    return writer.option("checkpointLocation", f"{root}/checkpoint").trigger(**trigger).start(), batcher
