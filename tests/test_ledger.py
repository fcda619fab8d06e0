"""Calls with a time limit, recorded one by one."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from glosswork import RunOptions
from glosswork.operators.inference import OfflineTranslator, infer
from glosswork.plans.corpus import translate_corpus
from glosswork.sources.ledger import CallLedger, SingleRecords, ledger_of
from glosswork.streaming.calls import request_jobs


class Counting:
    """Leaves a file for each call it gets, and may break the task or hang."""

    def __init__(self, folder, dies_at=None, hangs_at=None, seconds=60):
        self.folder, self.dies_at, self.hangs_at, self.seconds = str(folder), dies_at, hangs_at, seconds
        os.makedirs(self.folder, exist_ok=True)

    def __call__(self, payload, model):
        name = json.loads(payload)[0]["id"]
        first = not any(f.startswith(f"{name}-") for f in os.listdir(self.folder))
        open(f"{self.folder}/{name}-{time.time_ns()}", "w").close()
        if name == self.hangs_at:
            time.sleep(self.seconds)
        if name == self.dies_at and first:
            os._exit(1)  # as if the executor were lost
        return OfflineTranslator()(payload, model)

    def calls(self):
        names = [f.split("-")[0] for f in os.listdir(self.folder)]
        return {n: names.count(n) for n in names}


@pytest.fixture
def batches(spark):
    payload = F.concat(F.lit('[{"id":"'), F.col("id"), F.lit('","messages":[{"role":"user","content":"t"}]}]'))
    return spark.range(20).select(
        F.lit(0).alias("shard"), F.col("id").alias("batch_no"), F.lit(None).cast("string").alias("effective_model"),
        F.array(F.col("id").cast("string")).alias("job_ids"), payload.alias("payload"))


def test_a_slow_call_fails_its_batch_and_holds_up_nothing(batches, tmp_path):
    slow = Counting(tmp_path / "calls", hangs_at="7", seconds=60)
    began = time.time()
    got = {r.batch_no: r for r in infer(batches, slow, parallelism=2, timeout_s=1).collect()}
    assert time.time() - began < 30
    assert got[7].raw is None and got[7].error == "batch translation failed: timed out after 1 s"
    assert all(r.error is None and r.raw for n, r in got.items() if n != 7) and len(got) == 20


def test_a_lost_task_repeats_only_what_was_not_recorded(spark, batches, tmp_path):
    """The worker dies in the middle of a task of twenty calls; the job fails in local
    mode, and what runs after it finds the replies of before."""
    ledger = CallLedger(str(tmp_path / "ledger"))
    dying = Counting(tmp_path / "calls", dies_at="12")
    with pytest.raises(Exception):
        infer(batches, dying, parallelism=1, timeout_s=30, ledger=ledger).collect()
    before = dying.calls()
    assert before["12"] == 1
    got = infer(batches, dying, parallelism=1, timeout_s=30, ledger=ledger).collect()
    assert len(got) == 20 and all(r.raw and r.error is None for r in got)
    # Only the call that killed the worker was made twice.
    assert dying.calls() == {**{str(n): 1 for n in range(20)}, "12": 2}


def test_failures_are_not_recorded_and_models_and_namespaces_are_apart(batches, tmp_path):
    ledger = CallLedger(str(tmp_path / "ledger"))
    broken = OfflineTranslator(broken_models=[None])
    assert all(r.raw is None for r in infer(batches, broken, ledger=ledger).collect())
    assert all(r.raw for r in infer(batches, OfflineTranslator(), ledger=ledger).collect())
    assert all(r.raw for r in infer(batches, broken, ledger=ledger).collect())
    other = batches.withColumn("effective_model", F.lit("m"))
    assert all("zh" in r.raw for r in infer(other, OfflineTranslator(), ledger=ledger).collect())
    fresh = CallLedger(str(tmp_path / "ledger"), "other instructions")
    assert all(r.raw is None for r in infer(batches, broken, ledger=fresh).collect())


def test_texts_of_any_kind_come_back_and_unknown_stores_are_refused(tmp_path):
    ledger = CallLedger(f"file://{tmp_path}/ledger")
    for reply in ("", "ü\n\x00🙂", "x" * 1_000_000):
        ledger.put(reply + "?", None, reply)
        assert ledger.get(reply + "?", None) == reply
    assert ledger.get("?!", None) is None and ledger.get("?", "m") is None
    with pytest.raises(Exception):
        CallLedger("nosuchstore://x/y")


def test_a_corpus_run_takes_up_its_ledger(spark, tmp_path):
    docs = spark.createDataFrame([(d, f"A line of text {d}\nAnother line {d}", "en", "s", 0) for d in range(6)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    options = RunOptions(ledger=str(tmp_path / "ledger"), workers=2)
    first = translate_corpus(spark, docs, OfflineTranslator(), options)
    again = translate_corpus(spark, docs, OfflineTranslator(broken_models=[None]), options)
    assert first.audited.where("error IS NOT NULL").count() == again.audited.where("error IS NOT NULL").count() == 0
    assert sorted(map(tuple, first.segments.collect()), key=repr) == sorted(map(tuple, again.segments.collect()), key=repr)


def test_many_calls_share_a_few_files_and_threads(spark, batches, tmp_path):
    """Records of the same folder are one log a task, and a task's calls one thread."""
    many = batches.withColumn("batch_no", F.explode(F.sequence(F.lit(0), F.lit(999)))).withColumn(
        "payload", F.concat(F.lit('[{"id":"'), "batch_no", F.lit('","messages":[{"role":"user","content":"'), F.col("job_ids")[0], F.lit('"}]}]')))
    ledger = CallLedger(f"file://{tmp_path}/ledger")

    def threaded(payload, model):
        return json.dumps([threading.get_ident(), os.getpid(), payload])

    first = infer(many, threaded, parallelism=2, timeout_s=30, ledger=ledger)
    got = first.collect()
    assert len(got) == 20_000 and len({tuple(json.loads(r.raw)[:2]) for r in got}) <= 2
    # 4096 folders and the one where the two tasks meet.
    assert sum(len(files) for _, _, files in os.walk(tmp_path / "ledger")) <= 4097
    again = infer(many, OfflineTranslator(broken_models=[None]), parallelism=3, timeout_s=30, ledger=ledger).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_full_folders_go_deeper_and_cut_records_count_as_absent(tmp_path, monkeypatch):
    monkeypatch.setattr("glosswork.sources.ledger.FOLDER_BYTES", 300)
    monkeypatch.setattr("glosswork.sources.ledger._place", lambda payload: "abcdef0" + payload[0])
    ledger = CallLedger(str(tmp_path))
    one, other = ledger.open(), ledger.open()
    for n in range(40):
        (one if n % 3 else other).put(f"{n}", None, f"reply\n{n}")
        assert one.get(f"{n}", None) == other.get(f"{n}", None) == f"reply\n{n}"
    assert one.get("40", None) is None
    logs = sorted(tmp_path.rglob("*.log"))
    assert max(len(f.relative_to(tmp_path).parts) for f in logs) == 8
    assert all(ledger.open().get(f"{n}", None) == f"reply\n{n}" for n in range(40))
    for log in logs:
        log.write_bytes(log.read_bytes()[:-3])
    left = [n for n in range(40) if ledger.open().get(f"{n}", None)]
    assert len(left) == 40 - len(logs)
    again = ledger.open()
    for n in range(40):
        again.put(f"{n}", None, "anew")
    assert all(ledger.open().get(f"{n}", None) == "anew" or n in left for n in range(40))


def test_records_of_one_file_each_are_found(tmp_path):
    ledger = CallLedger(str(tmp_path))
    SingleRecords(ledger).put("p", "m", "before")
    assert ledger.get("p", "m") == "before" and ledger.get("p", None) is None
    ledger.put("p", None, "now")
    assert ledger.get("p", None) == "now" and ledger.get("p", "m") == "before"


def test_a_stream_takes_up_its_ledger(spark, tmp_path):
    body = '{"model":"","messages":[{"role":"user","content":"text %d"}]}'
    spark.createDataFrame([(i, body % i) for i in range(8)], "req_id bigint, body string").coalesce(1).write.json(str(tmp_path / "in"))
    options = RunOptions(ledger=str(tmp_path / "ledger"), window_ms=0)
    live = spark.readStream.schema("req_id bigint, body string").json(str(tmp_path / "in"))
    for name, translator in (("a", OfflineTranslator()), ("b", OfflineTranslator(broken_models=[None]))):
        calls = request_jobs(live, options).select(
            "shard", F.col("queue_pos").alias("batch_no"), "effective_model", F.array("job_id").alias("job_ids"),
            F.concat(F.lit('[{"id":"'), "job_id", F.lit('","messages":'), "messages", F.lit("}]")).alias("payload"))
        out = infer(calls, translator, timeout_s=30, ledger=ledger_of(options)).writeStream.format("memory").queryName(name)
        out.trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).where("raw LIKE '%[zh] text%'").count() == 8
