import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from glosswork.operators.inference import TASKS_PER_CORE, OfflineTranslator, infer
from glosswork.operators.replies import (
    audit_direct, audit_replies, audit_single, deadline_audit, pair_replies, preservation_audit, scatter,
)

BATCH = "shard int, batch_no bigint, effective_model string, job_ids array<string>"


def row(i, text="t"):
    return {"id": i, "text": text}


def reply(*rows):
    return json.dumps({"translations": list(rows)}, ensure_ascii=False)


A, B = row("a", " é \n"), row("b")
CASES = [
    (reply(A, B), None), (reply(B, A), None), ("  " + reply(A, B) + "\n", None), ("no", "json"), ("", "json"),
    (reply(A, B) + " ok", "json"), ("[]", "missing_translations"), ("7", "missing_translations"),
    ("{}", "missing_translations"), ('{"translations":null}', "missing_translations"),
    ('{"translations":{"a":1}}', "missing_translations"), (reply(A), "omitted"), (reply(), "omitted"),
    (reply(A, B, row("x")), "unexpected"), (reply(A, row("x")), "omitted"), (reply(A, B, A), "duplicate"),
    (reply(A, A), "duplicate"), (reply(A, B, row("x"), row("x")), "duplicate"), (reply(A, row("b", " 　")), "omitted"),
    (reply(A, row(3), B), None), (reply(A, row("b", 3)), "omitted"), (reply(A, 7, None, [B], B), None),
    (reply(A, B, row("a", " ")), None), (reply(A, {"id": "b"}), "omitted"), (reply(A, {**B, "extra": 1}), None),
]


def test_audit_matrix(spark):
    data = [(0, n, None, ["a", "b"], raw) for n, (raw, _) in enumerate(CASES)]
    audited = audit_replies(spark.createDataFrame(data, BATCH + ", raw string")).collect()
    assert {r.batch_no: r.defect for r in audited} == {n: d for n, (_, d) in enumerate(CASES)}
    first = next(r for r in audited if r.batch_no == 0)
    assert [(t.id, t.text) for t in first.translations] == [("a", "é"), ("b", "t")]


def test_audit_details(spark):
    data = [(0, 0, None, ["a", "b", "c"], reply(row("x"), row("y"), row("y"))), (0, 1, None, ["a", "b", "c"], reply(A)),
            (0, 2, "m", ["a", "a"], reply(A))]
    got = {r.batch_no: (r.defect, r.detail) for r in audit_replies(spark.createDataFrame(data, BATCH + ", raw string")).collect()}
    assert got == {0: ("duplicate", "reply repeats id y"), 1: ("omitted", "reply omits 2 item(s)"),
                   2: ("count", "reply has another number of items than the batch")}


def test_scatter_gives_every_job_one_ending(spark):
    batches = spark.createDataFrame(
        [(0, 0, None, ["a", "b"]), (0, 0, "m", ["c"]), (0, 1, None, ["d", "e"]), (1, 0, None, ["f"])], BATCH)
    replies = spark.createDataFrame(
        [(0, 0, None, reply(B, A), None), (0, 0, "m", None, "down"), (0, 1, None, reply(row("d")), None)],
        "shard int, batch_no bigint, effective_model string, raw string, error string")
    jobs = spark.createDataFrame([(j,) for j in "abcdefg"], "job_id string")
    got = {r.job_id: (r.result, r.error) for r in scatter(jobs, audit_replies(pair_replies(batches, replies))).collect()}
    late = "no translation was returned"
    assert got == {"a": ("é", None), "b": ("t", None), "c": (None, "down"), "d": (None, "reply omits 1 item(s)"),
                   "e": (None, "reply omits 1 item(s)"), "f": (None, late), "g": (None, late)}


def test_single_replies(spark):
    cases = {'{"translation":" x "}': (None, "x"), '{"translation":""}': ("empty", None), '{"translation":7}': ("empty", None),
             "{}": ("empty", None), "[]": ("object", None), "x": ("json", None), '{"translation":"x"} y': ("json", None)}
    frame = spark.createDataFrame([(raw,) for raw in cases], "raw string")
    assert {r.raw: (r.defect, r.translation) for r in audit_single(frame).collect()} == cases


CALLS = BATCH + ", payload string"

@pytest.fixture
def calls(spark):
    payload = json.dumps([{"id": "a", "messages": [{"content": "x"}]}])
    return spark.createDataFrame([(0, 0, None, ["a"], payload), (0, 1, "m", ["a"], payload)], CALLS)


@pytest.mark.parametrize("parallelism", [None, 2])
def test_offline_translator_and_failure_isolation(calls, parallelism):
    got = {r.effective_model: (r.raw, r.error) for r in infer(calls, OfflineTranslator(broken_models=["m"]), parallelism).collect()}
    assert got == {None: ('{"translations":[{"id":"a","text":"[zh] x"}]}', None),
                   "m": (None, "batch translation failed: model m is not available")}


@pytest.mark.parametrize("parallelism", [None, 6])
def test_calls_are_spread_over_tasks(spark, parallelism):
    """12 500 small payloads in a thousand shuffle partitions, which would be merged."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        jobs = spark.range(12_500).select(
            F.lit(0).alias("shard"), F.col("id").alias("batch_no"), F.lit(None).cast("string").alias("effective_model"),
            F.array(F.col("id").cast("string")).alias("job_ids"), F.lit("[]").alias("payload"))
        grouped = jobs.groupBy("shard", "batch_no", "effective_model", "payload").agg(F.first("job_ids").alias("job_ids"))
        answered = infer(grouped, lambda payload, model: "{}", parallelism)
        sizes = [r["count"] for r in answered.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(sizes) == 12_500
    assert len(sizes) == (parallelism or TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def test_direct_audit(spark):
    data = [(0, None, None, ["a"], '{"translation":" x "}', None), (0, None, None, ["b"], "no", None), (0, None, None, ["c"], None, "down")]
    got = {r.job_ids[0]: (r.defect, r.translations and r.translations[0].text)
           for r in audit_direct(spark.createDataFrame(data, BATCH + ", raw string, error string")).collect()}
    assert got == {"a": (None, "x"), "b": ("json", None), "c": ("backend", None)}


def test_deadline(spark):
    t = lambda s: datetime(2024, 1, 1, 0, s // 60, s % 60)
    jobs = spark.createDataFrame([(i, t(100)) for i in range(5)], "job_id int, submitted_at timestamp_ntz")
    done = spark.createDataFrame([(0, t(130)), (0, t(101)), (1, t(430)), (2, t(431)), (3, t(99)), (3, t(200))],
                                 "job_id int, done_at timestamp_ntz")
    got = {r.job_id: (r.done_at, r.timed_out) for r in deadline_audit(jobs, done, 330).collect()}
    assert got == {0: (t(101), False), 1: (t(430), False), 2: (None, True), 3: (t(200), False), 4: (None, True)}


def test_preservation_counts_multisets(spark):
    data = [(1, "[1] [1] {v1} http://a.b/c?d=1 <b>x</b>", "[1] {v2} <b>x"), (2, "TP53 PMID:12345", None), (3, "a", "b")]
    frame = spark.createDataFrame(data, "seg_id int, source string, output string")
    got = {(r.seg_id, r.cls): (r.lost, r.added) for r in preservation_audit(frame).collect()}
    assert got == {(1, "citation"): (1, 0), (1, "placeholder"): (1, 1), (1, "url"): (1, 0), (1, "tag"): (1, 0),
                   (1, "number"): (3, 1), (2, "number"): (2, 0)}
