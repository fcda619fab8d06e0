import json
import random

import pytest
from pyspark.sql import functions as F

from glosswork.operators.batching import BATCH_KEY, batch_by_count, batch_by_window, build_payload
from glosswork.operators.ranking import fifo_number


def numbered_by_hand(jobs, max_batch):
    """job -> (shard, batch_no, ord)"""
    out, seen = {}, {}
    for job_id, shard, doc, pos in sorted(jobs, key=lambda j: (j[1], j[2], j[3])):
        n = seen.get(shard, 0)
        seen[shard] = n + 1
        out[job_id] = (shard, n // max_batch, n % max_batch)
    return out


@pytest.mark.parametrize("ids", ["dense", "random", "string"])
@pytest.mark.parametrize("workers, max_batch", [(1, 4), (3, 1), (5, 64)])
def test_count_batches_match_a_plain_queue(spark, workers, max_batch, ids):
    rng = random.Random(workers * 100 + max_batch)
    name = {d: {"dense": d, "random": rng.getrandbits(63) - 2**62, "string": f"{rng.getrandbits(40):x}"}[ids] for d in range(40)}
    # One document holds a third of all jobs.
    jobs = [(f"d{d}:{p}", d % workers, name[d], p) for d in range(40) for p in rng.sample(range(60), rng.randint(0, 12))]
    jobs += [(f"d7:h{p}", 7 % workers, name[7], 100 + p) for p in range(150)]
    frame = spark.createDataFrame(jobs, f"job_id string, shard int, doc_id {'string' if ids == 'string' else 'bigint'}, pos int").withColumn(
        "effective_model", F.lit(None).cast("string"))
    got = {r.job_id: (r.shard, r.batch_no, r.ord) for r in batch_by_count(frame, max_batch).collect()}
    assert got == numbered_by_hand(jobs, max_batch)


def test_fifo_number_cuts_one_partition_into_ranges(spark):
    frame = spark.range(20_000).select(F.lit("k").alias("k"), F.xxhash64("id").alias("id"), F.lit("text").alias("text"))
    advisory = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(advisory)
    spark.conf.set(advisory, "false")
    try:
        ranked = fifo_number(frame, ["k"], ["id"])
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        rows = ranked.collect()
        sizes = [r["count"] for r in fifo_number(frame.select("k", "id"), ["k"], ["id"])
                 .groupBy(F.floor((F.col("rn") - 1) / 5000)).count().collect()]
    finally:
        spark.conf.set(advisory, before)
    assert [r.rn for r in sorted(rows, key=lambda r: r.id)] == list(range(1, 20_001)) and sum(sizes) == 20_000
    # No row is numbered by a window over its whole partition.
    for line in plan.splitlines():
        if "Window" in line and "row_number" in line:
            assert "_range" in line.split("windowspecdefinition")[1]


def test_payload_embeds_messages_untouched(spark):
    jobs = [('q"1', 0, 0, None, 1, '[{"z":1,"a":"é\\n"}]'), ("b", 0, 0, None, 0, '[{"role":"user"}]'), ("c", 0, 0, "m", 2, "[7]")]
    frame = spark.createDataFrame(jobs, "job_id string, shard int, batch_no bigint, effective_model string, ord int, messages string")
    calls = {r.effective_model: r for r in build_payload(frame).collect()}
    assert calls[None].job_ids == ["b", 'q"1']
    assert calls[None].payload == '[{"id":"b","messages":[{"role":"user"}]},{"id":"q\\"1","messages":[{"z":1,"a":"é\\n"}]}]'
    assert json.loads(calls["m"].payload) == [{"id": "c", "messages": [7]}]


def windows_by_hand(arrivals, max_batch, window):
    out, state = {}, {}
    for key, t, i in sorted(arrivals):
        number, anchor, count = state.get(key, (-1, 0, 0))
        if count and count < max_batch and t < anchor + window:
            count += 1
        else:
            number, anchor, count = number + 1, t, 1
        state[key] = (number, anchor, count)
        out[(key, i)] = number
    return out


@pytest.mark.parametrize(
    "max_batch, window, chunk_rows",
    [(4, 10, 8), (4, 10, 65_536), (1, 50, 5), (7, 0, 16), (5, 1_000, 5), (64, 30, 64), (3, 12, 10), (64, 500, 20)],
)
def test_window_batches_match_a_plain_walk(spark, max_batch, window, chunk_rows):
    rng = random.Random(max_batch * 1000 + window)
    arrivals, ident = [], 0
    for key, n in (("hot", 400), ("warm", 60), ("a", 3), ("b", 1), ("c", 17)):
        t = 0
        for _ in range(n):
            t += rng.choice([0, 0, 1, 2, 5, 9, 10, 11, 60])
            arrivals.append((key, t, ident))
            ident += 1
    rng.shuffle(arrivals)
    frame = spark.createDataFrame(arrivals, "key string, us bigint, id bigint").select(
        "key", "id", F.timestamp_micros("us").alias("ts"))
    got = batch_by_window(frame, "key", "ts", "id", max_batch, window, chunk_rows=chunk_rows)
    assert {(r.key, r.id): r.batch_no for r in got.collect()} == windows_by_hand(arrivals, max_batch, window)


def test_window_edge_opens_a_new_batch(spark):
    frame = spark.createDataFrame([("k", 0, 1), ("k", 99, 2), ("k", 100, 3)], "key string, us bigint, id bigint").select(
        "key", "id", F.timestamp_micros("us").alias("ts"))
    got = batch_by_window(frame, "key", "ts", "id", 4, 100)
    assert {r.id: r.batch_no for r in got.collect()} == {1: 0, 2: 0, 3: 1}
    with pytest.raises(ValueError):
        batch_by_window(frame, "key", "ts", "id", 0, 100)


def test_batches_are_cut_before_models_split_them(spark):
    frame = spark.range(10).select(
        F.col("id").cast("string").alias("job_id"), F.lit(0).alias("shard"), F.col("id").alias("doc_id"), F.lit(0).alias("pos"),
        F.when(F.col("id") % 2 == 0, "m").alias("effective_model"), F.lit("[]").alias("messages"))
    calls = build_payload(batch_by_count(frame, 4)).select(*BATCH_KEY, F.size("job_ids").alias("n")).collect()
    assert sorted((r.batch_no, r.effective_model or "", r.n) for r in calls) == [
        (0, "", 2), (0, "m", 2), (1, "", 2), (1, "m", 2), (2, "", 1), (2, "m", 1)]
