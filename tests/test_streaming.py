import time

from pyspark.sql import functions as F

from glosswork import RunOptions
from glosswork.catalog import queries
from glosswork.catalog.queries import QUERIES
from glosswork.operators.events import job_outcome
from glosswork.operators.inference import OfflineTranslator
from glosswork.operators.replies import job_answers
from glosswork.streaming.calls import request_jobs, pack_calls, translate_stream, triage_stream
from glosswork.streaming.progress import outcome_stream, status_stream, windowed_status_stream

BODY = '{"model":"%s","messages":[{"role":"user","content":"text %d"}]}'
REQUESTS = "req_id bigint, body string"


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def put(spark, path, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").json(str(path))


def start(stream, tmp_path, **trigger):
    writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    return writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(**trigger).start()


def wait_until(condition, query, seconds=60):
    end = time.time() + seconds
    while time.time() < end and query.isActive:
        if condition():
            return
        time.sleep(0.2)
    raise AssertionError(query.exception() or "condition was not reached")


def recorded(spark, stream, tmp_path):
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_full_batches_leave_at_once_and_the_rest_when_the_window_closes(spark, tmp_path):
    put(spark, tmp_path / "in", [(i, BODY % ("m" if i % 2 else "", i)) for i in range(6)] + [(9, "junk")], REQUESTS)
    calls = pack_calls(request_jobs(source(spark, tmp_path / "in", REQUESTS), RunOptions()), 4, 5000)
    query = start(calls, tmp_path, processingTime="0 seconds")
    try:
        size = lambda: sum(len(r.job_ids) for r in recorded(spark, calls, tmp_path).collect())
        wait_until(lambda: (tmp_path / "out" / "_spark_metadata").exists() and size() >= 4, query)
        early = {(r.batch_no, r.effective_model): r.job_ids for r in recorded(spark, calls, tmp_path).collect()}
        assert early[(0, None)] == ["0", "2"] and early[(0, "m")] == ["1", "3"]
        wait_until(lambda: size() == 6, query)
        late = {(r.batch_no, r.effective_model): r.job_ids for r in recorded(spark, calls, tmp_path).collect()}
        assert late == {**early, (1, None): ["4"], (1, "m"): ["5"]}
    finally:
        query.stop()


def test_open_batch_is_filled_by_a_later_file(spark, tmp_path):
    put(spark, tmp_path / "in", [(i, BODY % ("", i)) for i in range(3)], REQUESTS)
    audited = translate_stream(source(spark, tmp_path / "in", REQUESTS), OfflineTranslator(), RunOptions(window_ms=5000, max_batch=4))
    put(spark, tmp_path / "in", [(i, BODY % ("", i)) for i in range(3, 8)], REQUESTS)
    query = start(audited, tmp_path, processingTime="0 seconds")
    try:
        done = lambda: (tmp_path / "out" / "_spark_metadata").exists() and recorded(spark, audited, tmp_path).count() >= 2
        wait_until(done, query)
    finally:
        query.stop()
    calls = recorded(spark, audited, tmp_path)
    assert all(len(r.job_ids) <= 4 and r.defect is None for r in calls.collect())
    answers = {r.job_id: r.result for r in job_answers(calls).collect()}
    assert all(answers[k] == f"[zh] text {k}" for k in answers) and len(answers) >= 7


def test_window_of_zero_makes_single_calls(spark, tmp_path):
    put(spark, tmp_path / "in", [(i, BODY % ("", i)) for i in range(5)], REQUESTS)
    calls = pack_calls(request_jobs(source(spark, tmp_path / "in", REQUESTS), RunOptions()), 4, 0)
    query = start(calls, tmp_path, processingTime="0 seconds")
    try:
        wait_until(lambda: (tmp_path / "out" / "_spark_metadata").exists() and recorded(spark, calls, tmp_path).count() == 5, query)
    finally:
        query.stop()
    assert {tuple(r.job_ids) for r in recorded(spark, calls, tmp_path).collect()} == {(str(i),) for i in range(5)}


def test_triage_stream_splits_requests(spark, tmp_path):
    put(spark, tmp_path / "in", [(1, BODY % ("", 1)), (2, "junk"), (3, "[]")], REQUESTS)
    triaged = triage_stream(source(spark, tmp_path / "in", REQUESTS))
    writer = triaged.writeStream.format("parquet").option("path", str(tmp_path / "out")).partitionBy("accepted")
    writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    got = recorded(spark, triaged, tmp_path)
    assert sorted((r.req_id, r.accepted, r.reject) for r in got.collect()) == [(1, True, None), (2, False, "json"), (3, False, "object")]


EVENTS = "job_id bigint, seq bigint, body string"


def test_outcomes_across_files(spark, tmp_path):
    step = '{"type":"progress","stage":"s","progress":%d}'
    put(spark, tmp_path / "in", [(1, 2, step % 20), (1, 1, step % 10), (2, 1, '{"type":"error"}'), (3, 1, step % 5)], EVENTS)
    time.sleep(1.1)  # files are read in order of modification time
    put(spark, tmp_path / "in", [(1, 3, '{"type":"finish","translate_result":1}'), (1, 4, step % 30), (2, 2, '{"type":"finish"}')], EVENTS)
    ended = outcome_stream(source(spark, tmp_path / "in", EVENTS))
    start(ended, tmp_path, availableNow=True).awaitTermination()
    got = {r.job_id: (r.outcome, r.error, r.n_progress, r.last_label) for r in recorded(spark, ended, tmp_path).collect()}
    assert got == {1: ("finish", None, 2, "s: 20%"), 2: ("error", "translation failed", 0, None)}


def test_a_busy_job_is_folded_as_it_comes(spark, tmp_path):
    n = 300_000
    spark.range(n, 0, -1, 1).selectExpr(
        "1L AS job_id", "id AS seq",
        f"if(id = {n - 5}, '{{\"type\":\"finish\",\"translate_result\":1}}', '{{\"type\":\"progress\",\"stage\":\"s\",\"progress\":' || (id % 7 + 2) || '}}') AS body",
    ).write.json(str(tmp_path / "in"))
    ended = outcome_stream(source(spark, tmp_path / "in", EVENTS))
    start(ended, tmp_path, availableNow=True).awaitTermination()
    want = ("finish", None, n - 6, f"s: {(n - 6) % 7 + 2}%")
    assert [(r.outcome, r.error, r.n_progress, r.last_label) for r in recorded(spark, ended, tmp_path).collect()] == [want]


def test_small_blocks_give_the_outcomes_of_the_batch_form(spark, tmp_path):
    """Ends in the middle of blocks and before others, blocks that two triggers share."""
    body = lambda j, n: ('{"type":"error","error":"e%d"}' % n if n % (7 + j) == 5 and n > 10 * j else
                         '{"type":"progress","stage":"s","progress":%d}' % (n % 50 + 2) if n % 3 else "junk")
    data = [(j, n, body(j, n)) for n in range(120) for j in range(6)] + [(9, 1, "{}")]
    put(spark, tmp_path / "in", [r for r in reversed(data) if r[1] < 37], EVENTS)
    time.sleep(1.1)
    put(spark, tmp_path / "in", [r for r in reversed(data) if r[1] >= 37], EVENTS)
    ended = outcome_stream(source(spark, tmp_path / "in", EVENTS), block=8)
    start(ended, tmp_path, availableNow=True).awaitTermination()
    want = job_outcome(spark.createDataFrame(data, EVENTS)).where("outcome <> 'no_result'")
    assert sorted(map(tuple, recorded(spark, ended, tmp_path).collect())) == sorted(map(tuple, want.collect()))


def test_status_streams(spark, tmp_path):
    schema = "effective_model string, job_ids array<string>, answered boolean, defect string, at timestamp"
    rows = [(None, ["a", "b"], True, None, "2024-01-01T00:00:10"), ("m", ["c"], True, "backend", "2024-01-01T00:00:20"),
            ("m", ["d"], False, None, "2024-01-01T00:05:00"), (None, ["e"], True, None, "2024-01-01T01:00:00")]
    put(spark, tmp_path / "in", rows, schema.replace("at timestamp", "at string"))
    live = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    status = status_stream(live).writeStream.format("memory").queryName("live_status").outputMode("complete")
    status.option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.table("live_status").collect()) == [("codex-cli-default", 2, 0, 3, 0), ("m", 0, 1, 0, 1)]
    windows = windowed_status_stream(live, "at", "1 minute", "10 minutes")
    start(windows, tmp_path, availableNow=True).awaitTermination()
    got = recorded(spark, windows, tmp_path).select(F.minute("window.start").alias("m"), "model", "batches", "failed_batches", "queued_items")
    assert sorted(tuple(r) for r in got.collect()) == [(0, "codex-cli-default", 1, 0, 0), (0, "m", 0, 1, 0), (5, "m", 0, 0, 1)]


def test_stream_and_batch_outcomes_agree(spark):
    sf = "/root/testdata/sf0.001"
    batch = QUERIES["job_outcome"](spark, sf).where("outcome <> 'no_result'")
    assert sorted(map(tuple, QUERIES["stream_outcome"](spark, sf).collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_jobs_of_a_trigger_are_batched_in_queue_order(spark, tmp_path):
    """6000 jobs in one file, in descending order, in frames of any size."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        put(spark, tmp_path / "in", [(i, BODY % ("", i)) for i in range(5999, -1, -1)], REQUESTS)
        calls = pack_calls(request_jobs(source(spark, tmp_path / "in", REQUESTS), RunOptions()), 4, 5000)
        query = start(calls, tmp_path, processingTime="0 seconds")
        try:
            done = lambda: (tmp_path / "out" / "_spark_metadata").exists() and recorded(spark, calls, tmp_path).count() >= 1500
            wait_until(done, query)
        finally:
            query.stop()
        got = {r.batch_no: r.job_ids for r in recorded(spark, calls, tmp_path).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {n: [str(4 * n + k) for k in range(4)] for n in range(1500)}


def test_replayed_requests_arrive_twice_in_files_of_a_part_of_the_table(spark, tmp_path, monkeypatch):
    spark.range(600).repartition(6).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"),
    ).write.parquet(str(tmp_path / "tables/documents.parquet"))
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: str(tmp_path / name))
    answers = QUERIES["stream_replay"](spark, str(tmp_path / "tables")).collect()
    run = tmp_path / "stream_replay"
    files = [spark.read.parquet(str(f)).count() for f in (run / "requests").rglob("*.parquet")]
    assert sum(files) == 600 and max(files) <= 100
    assert sorted(f.name for f in (run / "checkpoint/offsets").iterdir() if f.name[0] != ".") == ["0", "1"]
    # Of twelve kinds of request, four are valid; one of them is for the broken model.
    assert len(answers) == len({a.job_id for a in answers}) == 200
    assert sum(a.error is not None for a in answers) == 50
