"""Every operator as a query over the test tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.catalog import fixtures as fx
from glosswork.functions.text import py_strip
from glosswork.operators import batching, events, library, replies, reports, results, segments
from glosswork.operators.inference import OfflineTranslator, infer
from glosswork.options import RunOptions
from glosswork.plans.corpus import translate_corpus
from glosswork.session import configure, scratch_path, written
from glosswork.sources import files, memory, requests
from glosswork.sources.ledger import CallLedger
from glosswork.streaming import calls as streaming_calls
from glosswork.streaming import microbatch
from glosswork.streaming import progress as streaming_progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


@query
def input_gate(spark, sf):
    documents = fx.table(spark, sf, "documents")
    candidates = documents.select("doc_id", F.expr(fx.CANDIDATE_PATH).alias("path"))
    present = documents.where(fx.FILE_PRESENT).select(F.expr(fx.CANDIDATE_PATH).alias("path"))
    return files.gate_inputs(candidates, present)


@query
def request_triage(spark, sf):
    return requests.triage_requests(fx.requests(spark, sf)).select(
        "req_id", "reject", "requested_model", F.md5("messages").alias("messages_md5")
    )


@query
def model_routing(spark, sf):
    asked = fx.segments(spark, sf).withColumn("requested_model", F.expr(fx.REQUESTED_MODEL))
    return requests.route_model(asked).select(
        "seg_id", "effective_model",
        requests.effective_model(F.col("requested_model"), "forced").alias("forced_model"),
    )


@query
def segment_explode(spark, sf):
    return fx.segments(spark, sf).withColumn("text_md5", F.md5("text")).drop("text")


@query
def page_select(spark, sf):
    return segments.select_pages(fx.segments(spark, sf), "1,2,4-6").select("seg_id", "page_no")


@query
def listed_pages(spark, sf):
    """A page expression for each document; some have none, some an invalid one."""
    documents = fx.table(spark, sf, "documents")
    lists = segments.page_lists(documents.where(fx.HAS_PAGE_LIST).select("doc_id", F.expr(fx.PAGE_LIST).alias("pages")))
    picked = segments.select_listed_pages(fx.segments(spark, sf), lists)
    return picked.groupBy("doc_id", "page_no").agg(F.count("*").alias("n_segments")).unionByName(
        lists.where("error IS NOT NULL").select("doc_id", F.lit(-1).alias("page_no"), F.length("error").cast("bigint").alias("n_segments")))


@query
def segment_gate(spark, sf):
    rows = fx.segments(spark, sf)
    gated = segments.gate(segments.gate(rows, translate_table_text=False)
                          .withColumnRenamed("translate", "translate_no_tables"))
    return gated.select("seg_id", "translate", "translate_no_tables", (py_strip(F.col("text")) != "").alias("has_text"))


@query
def collect_targets(spark, sf):
    return library.collect_targets(
        fx.selection(spark, sf), fx.attachments(spark, sf), fx.items(spark, sf),
        fx.libraries(spark, sf), fx.library_files(spark, sf),
    )


@query
def best_attachment(spark, sf):
    return library.best_attachment(fx.attachments(spark, sf), fx.library_files(spark, sf))


@query
def batch_by_count(spark, sf):
    return fx.batched(spark, sf).select("job_id", "shard", "batch_no", "effective_model", "ord")


@query
def batch_by_window(spark, sf):
    arrivals = fx.table(spark, sf, "events").select("user_id", "event_id", "ts")
    return batching.batch_by_window(
        arrivals, key="user_id", ts="ts", order_id="event_id", max_batch=4, window_us=12 * 3_600_000_000
    ).select("user_id", "event_id", "batch_no")


@query
def batch_payload(spark, sf):
    return fx.batches(spark, sf).select(
        *batching.BATCH_KEY, F.size("job_ids").cast("bigint").alias("n_jobs"),
        F.octet_length("payload").cast("bigint").alias("n_bytes"), F.md5("payload").alias("payload_md5"),
    )


@query
def segment_dedup(spark, sf):
    routed = requests.route_model(fx.wanted_segments(spark, sf))
    return segments.dedup_segments(routed).select(
        "key_hash", "effective_model", "first.doc_id", "first.pos", "n_rows"
    )


@query
def memory_split(spark, sf):
    stored = _stored(spark, sf)
    rows = fx.with_memory_key(fx.wanted_segments(spark, sf))
    return memory.memory_lookup(rows, stored).select(
        "seg_id", F.col("memory_text").isNotNull().alias("hit"), F.md5("memory_text").alias("memory_md5")
    )


@query
def memory_upsert(spark, sf):
    merged = memory.memory_upsert(fx.memory_rows(spark, sf, True), fx.memory_rows(spark, sf, False))
    return merged.select("key_hash", "effective_model", F.md5("text").alias("text_md5"), "version")


@query
def memory_store(spark, sf):
    """The same memory, grown by additions and a merge."""
    store = memory.MemoryStore(spark, scratch_path(spark, "memory-store"), buckets=8, most_parts=2)
    rest = fx.memory_rows(spark, sf, False)
    for rows in (fx.memory_rows(spark, sf, True), rest.where("version < 4"), rest.where("version >= 4")):
        store.add(rows)
        store.merge()
    return store.table().select("key_hash", "effective_model", F.md5("text").alias("text_md5"), "version")


def _stored(spark, sf):
    """A partly filled memory."""
    first = fx.memory_rows(spark, sf, True)
    return memory.memory_upsert(first, first.where("false"))


@query
def batch_infer(spark, sf):
    answered = infer(fx.batches(spark, sf), OfflineTranslator(broken_models=["Model-Y"]))
    return answered.select(*batching.BATCH_KEY, F.md5("raw").alias("raw_md5"), "error")


@query
def call_ledger(spark, sf):
    """A run that fails for one model, then one that may not call at all: recorded replies stay."""
    batches, ledger = written(fx.batches(spark, sf), "batches"), CallLedger(scratch_path(spark, "call-ledger"))
    first = infer(batches, OfflineTranslator(broken_models=["Model-Y"]), timeout_s=240, ledger=ledger)
    first.write.format("noop").mode("overwrite").save()
    again = infer(batches, _no_calls, timeout_s=240, ledger=ledger)
    return again.select(*batching.BATCH_KEY, F.md5("raw").alias("raw_md5"), "error")


def _no_calls(payload, model):
    raise RuntimeError("not recorded")


@query
def reply_audit(spark, sf):
    return replies.audit_replies(fx.replies(spark, sf)).select(
        *batching.BATCH_KEY, "defect", "detail",
        F.coalesce(F.size("translations"), F.lit(0)).cast("bigint").alias("n_usable"),
    )


@query
def single_reply_audit(spark, sf):
    quoted = F.to_json(F.struct(F.col("text").alias("t")))
    single = files.spread(fx.table(spark, sf, "documents")).select(
        "doc_id", F.substring(quoted, F.lit(6), F.length(quoted) - 6).alias("quoted")
    ).select("doc_id", F.expr(fx.SINGLE_REPLY).alias("raw"))
    return replies.audit_single(single).select("doc_id", F.md5("translation").alias("translation_md5"), "defect")


@query
def result_scatter(spark, sf):
    audited = replies.audit_replies(fx.replies(spark, sf))
    return replies.scatter(fx.batched(spark, sf).select("job_id"), audited)


@query
def deadline_audit(spark, sf):
    rows = fx.table(spark, sf, "events")
    submitted = rows.select(F.col("event_id").alias("job_id"), F.col("ts").alias("submitted_at"))

    def done(shift, condition="true"):
        return rows.where(condition).select((F.col("event_id") + shift).alias("job_id"), F.col("ts").alias("done_at"))

    completions = done(-1).unionByName(done(-2, "event_id % 3 = 0")).unionByName(done(1, "event_id % 4 = 0"))
    waited = F.expr("timestampdiff(MICROSECOND, submitted_at, done_at)")
    return replies.deadline_audit(submitted, completions, RunOptions().deadline_s).select(
        "job_id", "timed_out", F.coalesce(waited, F.lit(-1)).alias("waited_us")
    )


@query
def preservation_audit(spark, sf):
    rows = fx.wanted_segments(spark, sf)
    return replies.preservation_audit(rows.select(
        "seg_id",
        F.concat("text", F.expr(fx.TOKENS)).alias("source"),
        F.concat(F.lit("[zh] "), "text", F.expr(fx.TOKENS_OUT)).alias("output"),
    ))


@query
def progress_normalize(spark, sf):
    return events.progress(fx.job_events(spark, sf))


@query
def job_outcome(spark, sf):
    return events.job_outcome(fx.job_events(spark, sf))


@query
def result_salvage(spark, sf):
    return results.salvage_results(fx.logs(spark, sf)).drop("stdout", "stderr")


@query
def output_manifest(spark, sf):
    return results.output_manifest(
        fx.results(spark, sf), fx.output_files(spark, sf), fx.OUTPUT_DIR, fx.ROOT
    ).drop("place")


@query
def outcome_results(spark, sf):
    return events.outcome_results(fx.job_events(spark, sf), fx.OUTPUT_DIR)


@query
def job_verdicts(spark, sf):
    return results.job_verdicts(results.output_manifest(
        fx.results(spark, sf), fx.output_files(spark, sf), fx.OUTPUT_DIR, fx.ROOT
    ))


@query
def result_records(spark, sf):
    return results.result_records(fx.results(spark, sf))


@query
def assemble_outputs(spark, sf):
    gated = segments.gate(fx.segments(spark, sf))
    translated = gated.withColumn("result", F.when(F.col("translate"), F.concat(F.lit("[zh] "), "text")))
    return results.assemble(translated, "both").select(
        "doc_id", "kind", F.md5("text").alias("text_md5"), "n_segments", "n_translated"
    )


@query
def backend_status(spark, sf):
    return reports.backend_status(replies.audit_replies(fx.replies(spark, sf)))


@query
def shard_status(spark, sf):
    status = reports.shard_status(replies.audit_replies(fx.replies(spark, sf)))
    return status.withColumns({"shard": F.coalesce(F.col("shard").cast("string"), F.lit("all")),
                               "model": F.coalesce("model", F.lit("all"))})


@query
def run_summary(spark, sf):
    return reports.run_summary(fx.run_targets(spark, sf), fx.run_outcomes(spark, sf))


@query
def first_failures(spark, sf):
    return reports.first_failures(fx.run_targets(spark, sf), fx.run_outcomes(spark, sf))


@query
def failure_report(spark, sf):
    report = reports.failure_report(fx.logs(spark, sf))
    return report.select("job_id", F.md5("detail").alias("detail_md5"), F.md5("library_detail").alias("library_md5"),
                         F.md5("notes_detail").alias("notes_md5"), F.md5("stdout_note").alias("stdout_md5"),
                         F.md5("stderr_note").alias("stderr_md5"))


@query
def failure_counts(spark, sf):
    report = reports.failure_report(fx.logs(spark, sf))
    return reports.failure_counts(report).select(F.md5("detail").alias("detail_md5"), "n_jobs")


def _corpus_run(spark, sf, **options):
    stored = _stored(spark, sf)
    translator = OfflineTranslator(direct=options.get("transport") == "direct")
    return translate_corpus(
        spark, fx.table(spark, sf, "documents"), translator,
        RunOptions(workers=fx.WORKERS, **options), memory=stored, memory_version=3,
    )


@query
def corpus_documents(spark, sf):
    return _corpus_run(spark, sf, mode="both", pages="1-3,5").documents.select(
        "doc_id", "kind", F.md5("text").alias("text_md5"), "n_segments", "n_translated"
    )


@query
def corpus_calls(spark, sf):
    run = _corpus_run(spark, sf, model="Model-Y")
    return reports.backend_status(run.audited)


@query
def corpus_memory(spark, sf):
    merged = _corpus_run(spark, sf).memory
    return merged.groupBy("effective_model", "version").agg(
        F.count("*").alias("n_keys"), F.sum(F.length("text")).alias("n_chars")
    )


@query
def direct_documents(spark, sf):
    return _corpus_run(spark, sf, mode="mono", transport="direct").documents.select(
        "doc_id", "kind", F.md5("text").alias("text_md5"), "n_segments", "n_translated"
    )


# A stateful stream keeps the number of partitions it starts with for life.
STATE_PARTITIONS = 8


def _stream_session(spark, state_partitions=STATE_PARTITIONS):
    """A session of its own, so that the caller's settings stay as they are."""
    own = configure(spark.newSession())
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    return own


def _step_session(spark):
    """For the micro-batcher: its steps keep no state, so they have as many partitions as
    the caller's shuffles, which grow with the data."""
    return _stream_session(spark, max(STATE_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _two_arrivals(requests, path):
    """Write ``req_id, body`` as files of two arrivals; returns how many files a trigger takes
    so that there are two triggers. Each task writes its own rows: files are as many
    as the table has parts, and no task reads a fixed share of it."""
    requests.withColumn("arrival", F.pmod(F.hash("req_id"), F.lit(2))).write.partitionBy("arrival").parquet(path)
    files = requests.sparkSession.read.schema("req_id bigint, body string, arrival int").parquet(path).inputFiles()
    return max(1, -(-len(files) // 2))


def _drained(spark, name, stream, partition_by=(), window_ms=None):
    """Run the stream over all that is there and read what the sink recorded.

    A query with timers keeps running triggers to look at them. No batch is open any
    more after a trigger without input that began when the window of the last one
    with input had passed.
    """
    path = scratch_path(spark, name)
    writer = stream.writeStream.format("parquet").option("path", f"{path}/out").partitionBy(*partition_by)
    writer = writer.option("checkpointLocation", f"{path}/checkpoint")
    trigger = {"availableNow": True} if window_ms is None else {"processingTime": "0 seconds"}
    running = writer.trigger(**trigger).start()
    try:
        while running.isActive and not (window_ms is not None and _windows_passed(running.recentProgress, window_ms)):
            running.awaitTermination(0.1)  # raises if the query has failed
    finally:
        running.stop()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _windows_passed(triggers, window_ms):
    if not triggers or triggers[-1]["numInputRows"]:
        return False
    began = [datetime.fromisoformat(t["timestamp"].replace("Z", "+00:00")) for t in triggers]
    ends = [b + timedelta(milliseconds=t["batchDuration"] + window_ms) for b, t in zip(began, triggers) if t["numInputRows"]]
    return not ends or began[-1] >= ends[-1]


@query
def stream_triage(spark, sf):
    own = _stream_session(spark)
    triaged = streaming_calls.triage_stream(fx.document_requests(fx.table_stream(own, sf, "documents")))
    return _drained(spark, "stream_triage", triaged, ["accepted"]).select(
        "req_id", "accepted", "reject", "requested_model", F.md5("messages").alias("messages_md5")
    )


@query
def stream_microbatch(spark, sf):
    options = RunOptions(workers=fx.WORKERS, max_batch=fx.MAX_BATCH)
    jobs = streaming_calls.request_jobs(
        fx.document_requests(fx.table_stream(_stream_session(spark), sf, "documents")), options
    )
    packed = streaming_calls.pack_calls(jobs, options.max_batch, options.window_ms)
    return _drained(spark, "stream_microbatch", packed, window_ms=options.window_ms).select(
        *batching.BATCH_KEY, F.size("job_ids").cast("bigint").alias("n_jobs"), F.md5("payload").alias("payload_md5")
    )


@query
def stream_translate(spark, sf):
    options = RunOptions(workers=fx.WORKERS)
    audited = streaming_calls.translate_stream(
        fx.document_requests(fx.table_stream(_stream_session(spark), sf, "documents")),
        OfflineTranslator(broken_models=["12"]), options,
    )
    return replies.job_answers(_drained(spark, "stream_translate", audited, window_ms=options.window_ms)).select(
        "job_id", F.md5("result").alias("result_md5"), "error"
    )


@query
def stream_hot_shard(spark, sf):
    """All jobs in one queue."""
    options = RunOptions(workers=1, max_batch=fx.MAX_BATCH)
    own, path = _step_session(spark), scratch_path(spark, "stream_hot_shard")
    jobs = streaming_calls.request_jobs(fx.document_requests(fx.table_stream(own, sf, "documents")), options)
    batcher = microbatch.MicroBatcher(own, f"{path}/steps", options.max_batch, options.window_ms)
    running = jobs.writeStream.foreachBatch(batcher).option("checkpointLocation", f"{path}/checkpoint")
    microbatch.attend(running.trigger(availableNow=True).start(), batcher)
    return batcher.calls().select(
        *batching.BATCH_KEY, F.size("job_ids").cast("bigint").alias("n_jobs"), F.md5("payload").alias("payload_md5")
    )


@query
def stream_replay(spark, sf):
    """Every trigger comes three times, the last time to a backend that knows nothing."""
    own, path = _step_session(spark), scratch_path(spark, "stream_replay")
    options = RunOptions(workers=fx.WORKERS, ledger=f"{path}/ledger")
    requests_path = f"{path}/requests"
    files = _two_arrivals(fx.document_requests(fx.table(spark, sf, "documents")), requests_path)
    live = own.readStream.schema("req_id bigint, body string, arrival int").option("maxFilesPerTrigger", files).parquet(requests_path)

    def batcher(translator):
        answer = microbatch.translator_of(translator, options)
        return microbatch.MicroBatcher(own, f"{path}/steps", options.max_batch, options.window_ms, answer)

    first = batcher(OfflineTranslator(broken_models=["12"]))

    def thrice(jobs, batch_id):
        first(jobs, batch_id)
        first(jobs, batch_id)
        batcher(_no_calls)(jobs, batch_id)

    running = streaming_calls.request_jobs(live, options).writeStream.foreachBatch(thrice)
    microbatch.attend(running.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(), first)
    return replies.job_answers(first.replies()).select("job_id", F.md5("result").alias("result_md5"), "error")


@query
def stream_outcome(spark, sf):
    own = _stream_session(spark)
    ended = streaming_progress.outcome_stream(fx.event_bodies(fx.table_stream(own, sf, "events")))
    return _drained(spark, "stream_outcome", ended)


@query
def stream_status(spark, sf):
    path = scratch_path(spark, "stream_status")
    audited = replies.audit_replies(fx.replies(spark, sf))
    audited.write.parquet(f"{path}/audited")
    live = _stream_session(spark).readStream.schema(audited.schema).parquet(f"{path}/audited")
    status = streaming_progress.status_stream(live)
    recorded = [-1]

    def record(frame, batch):
        # Complete mode: each trigger's table holds all counters, the newest counts.
        frame.write.mode("overwrite").parquet(f"{path}/status/{batch}")
        recorded[0] = max(recorded[0], batch)

    (status.writeStream.foreachBatch(record).outputMode("complete")
     .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(status.schema).parquet(f"{path}/status/{recorded[0]}")


@query
def stream_status_windows(spark, sf):
    """Counters of finished days. Days that the first trigger closed are sent by the second;
    what the third has for them is late and does not count."""
    path = scratch_path(spark, "stream_status_windows")
    replied = fx.timed_replies(fx.table(spark, sf, "events"))
    for arrival in range(3):  # files are read in order of modification time
        replied.where(F.col("arrival") == arrival).drop("arrival").coalesce(1).write.mode("append").parquet(f"{path}/in")
        time.sleep(1.1)
    live = _stream_session(spark).readStream.schema(replied.drop("arrival").schema).option("maxFilesPerTrigger", 1)
    windows = streaming_progress.windowed_status_stream(
        live.parquet(f"{path}/in"), "at", "1 day", f"{fx.STATUS_DELAY_DAYS} days")
    return _drained(spark, "stream_status_windows", windows).select(
        F.date_format("window.start", "yyyy-MM-dd").alias("day"), "model", "batches", "failed_batches",
        "translated_items", "queued_items")
