"""Micro-batches with replays, stops at any place, and queues that hold everything."""

import random

import pytest
from pyspark.sql import functions as F

from glosswork import RunOptions
from glosswork.operators.inference import OfflineTranslator
from glosswork.operators.replies import job_answers
from glosswork.streaming import microbatch
from glosswork.streaming.microbatch import MicroBatcher, attend, start_translation, translator_of

JOBS = "job_id string, shard int, queue_pos bigint, effective_model string, messages string"
MESSAGES = '[{"role":"user","content":"text %d"}]'


def jobs(spark, ids, shard=lambda i: 0, model=lambda i: None):
    return spark.createDataFrame([(str(i), shard(i), i, model(i), MESSAGES % i) for i in ids], JOBS)


class Clock:
    def __init__(self):
        self.now = 1000

    def __call__(self):
        return self.now


def sent(batcher):
    return sorted((r.shard, r.batch_no, r.effective_model or "", tuple(r.job_ids)) for r in batcher.calls().collect())


def simulate(triggers, limit, window):
    """One queue after the other, job by job."""
    out, state = [], {}
    for now, ids, shard in triggers:
        for s, (number, waiting, began) in list(state.items()):
            if waiting and began + window <= now:
                out.append((s, number, tuple(waiting)))
                state[s] = number + 1, [], None
        for i in sorted(ids):
            number, waiting, began = state.get(shard(i), (0, [], None))
            waiting, began = [*waiting, str(i)], now if not waiting else began
            if len(waiting) == limit:
                out.append((shard(i), number, tuple(waiting)))
                number, waiting = number + 1, []
            state[shard(i)] = number, waiting, began
    out += [(s, n, tuple(w)) for s, (n, w, _) in state.items() if w]
    return sorted(out)


def test_batches_over_triggers_match_a_queue_worked_off_job_by_job(spark, tmp_path):
    rnd, clock, triggers = random.Random(1), Clock(), []
    batcher = MicroBatcher(spark, str(tmp_path / "steps"), 4, 100, clock=clock)
    shard = lambda i: i * i % 3
    start = 0
    for n in range(4):
        clock.now += rnd.choice([10, 60, 150])
        ids = range(start, start + rnd.randrange(1, 14))
        start = ids.stop
        triggers.append((clock.now, ids, shard))
        batcher(jobs(spark, ids, shard), n)
    clock.now += 1000
    batcher.flush()
    batcher.flush()
    assert [(s, n, i) for s, n, _, i in sent(batcher)] == simulate(triggers, 4, 100)


def test_a_trigger_that_comes_again_adds_nothing(spark, tmp_path):
    clock = Clock()
    make = lambda: MicroBatcher(spark, str(tmp_path / "steps"), 4, 100, translator_of(OfflineTranslator(), RunOptions()), clock)
    batcher = make()
    batcher(jobs(spark, range(6)), 0)
    batcher(jobs(spark, range(6)), 0)
    make()(jobs(spark, range(6)), 0)
    again = make()
    again(jobs(spark, range(6, 8)), 1)
    again.flush(everything=True)
    assert sent(again) == [(0, 0, "", ("0", "1", "2", "3")), (0, 1, "", ("4", "5", "6", "7"))]
    assert sorted(r.result for r in job_answers(again.replies()).collect()) == sorted(f"[zh] text {i}" for i in range(8))


@pytest.mark.parametrize("stops_at", ["numbers", "open", "replies", "log 0", "log 1"])
def test_a_run_that_stops_anywhere_goes_on_where_it_was(spark, tmp_path, monkeypatch, stops_at):
    asked = []

    def answer(calls):
        asked.append(sorted(tuple(r.job_ids) for r in calls.collect()))
        return translator_of(OfflineTranslator(), RunOptions())(calls)

    clock = Clock()
    make = lambda: MicroBatcher(spark, str(tmp_path / "steps"), 4, 100, answer, clock)
    make()(jobs(spark, range(6)), 0)

    kept, put, left = MicroBatcher._kept, microbatch.StepLog.put, {"log": 0}

    def stop(*_):
        raise RuntimeError("stopped")

    def kept_until(self, frame, table, step):
        return stop() if table == stops_at else kept(self, frame, table, step)

    def put_until(self, entry):
        left["log"] += 1
        return stop() if stops_at == f"log {left['log'] - 1}" else put(self, entry)

    with monkeypatch.context() as m:
        m.setattr(MicroBatcher, "_kept", kept_until)
        m.setattr(microbatch.StepLog, "put", put_until)
        with pytest.raises(RuntimeError):
            make()(jobs(spark, range(6, 11)), 1)
    clock.now += 30
    batcher = make()
    batcher(jobs(spark, range(6, 11)), 1)
    batcher.flush(everything=True)
    assert [i for *_, i in sent(batcher)] == [("0", "1", "2", "3"), ("4", "5", "6", "7"), ("8", "9", "10")]
    assert job_answers(batcher.replies()).count() == 11
    # The calls that were planned are asked again as they were, never others.
    assert {c for calls in asked for c in calls} == {("0", "1", "2", "3"), ("4", "5", "6", "7"), ("8", "9", "10")}


def test_one_queue_with_all_jobs_is_cut_into_equal_batches_by_many_tasks(spark, tmp_path):
    n = 200_000
    all_jobs = spark.range(n).select(
        F.col("id").cast("string").alias("job_id"), F.lit(0).alias("shard"), (n - F.col("id")).alias("queue_pos"),
        F.when(F.col("id") % 5 == 0, "m").alias("effective_model"), F.lit("[]").alias("messages"))
    batcher = MicroBatcher(spark, str(tmp_path / "steps"), 7, 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        batcher(all_jobs, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ranges = spark.read.parquet(str(tmp_path / "steps/fifo-ranges/slot=0")).groupBy("_range").count().collect()
    assert len(ranges) >= 4 and max(r["count"] for r in ranges) < n / 2
    batcher.flush(everything=True)
    sizes = batcher.calls().groupBy("batch_no").agg(F.sum(F.size("job_ids")).alias("n"))
    assert sizes.groupBy("n").count().orderBy("n").collect() == [(n % 7, 1), (7, n // 7)]
    first = batcher.calls().where("batch_no = 0 AND effective_model IS NULL").first()
    assert first.job_ids[0] == str(n - 1)


def test_window_of_zero_and_an_empty_trigger(spark, tmp_path):
    batcher = MicroBatcher(spark, str(tmp_path / "steps"), 4, 0)
    batcher(jobs(spark, range(3), shard=lambda i: i), 0)
    batcher(jobs(spark, []), 1)
    batcher.flush(everything=True)
    assert [i for *_, i in sent(batcher)] == [("0",), ("1",), ("2",)]


def test_a_stream_is_translated_and_started_again(spark, tmp_path):
    schema, body = "req_id bigint, body string", '{"model":"","messages":[{"role":"user","content":"text %d"}]}'

    def put(ids):
        spark.createDataFrame([(i, body % i) for i in ids], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def run():
        live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query, batcher = start_translation(live, OfflineTranslator(), RunOptions(workers=2), str(tmp_path / "run"), availableNow=True)
        attend(query, batcher)
        return {r.job_id: r.result for r in job_answers(batcher.replies()).collect()}

    put(range(5))
    assert run() == {str(i): f"[zh] text {i}" for i in range(5)}
    put(range(5, 9))
    assert run() == {str(i): f"[zh] text {i}" for i in range(9)}
