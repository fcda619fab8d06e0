import random
import time

import pytest
from pyspark.sql import functions as F

from glosswork.llm import chat_format, secret_scan
from glosswork.llm.common import small_side, starts_of


def test_starts_of_any_number_of_neighbours(spark):
    rnd = random.Random(1)
    rows = [(n, [rnd.randrange(9) for _ in range(n)]) for n in (0, 1, 2, 255, 256, 257, 512, 513, 3000)]
    got = spark.createDataFrame(rows, "n int, lengths array<int>").select("n", "lengths", starts_of(F.col("lengths")).alias("at")).collect()
    assert len(got) == len(rows)
    assert all(r["at"] == [sum(r.lengths[:k]) for k in range(r.n)] for r in got)


def test_wide_rows_are_not_broadcast(spark):
    hinted = lambda f: "ResolvedHint" in f._jdf.queryExecution().analyzed().toString()
    assert hinted(small_side(spark.range(10)))
    assert not hinted(small_side(spark.range(100).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))))


def seconds(action):
    began = time.perf_counter()
    action()
    return time.perf_counter() - began


def noop(frame):
    frame.write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("what", ["secrets", "turns"])
def test_many_matches_and_turns_take_time_in_proportion(spark, what):
    def run(n):
        if what == "secrets":
            docs = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("the token = abcdefgh1 and "), n).alias("text"))
            noop(secret_scan.scan_unseen(docs, secret_scan.empty_ledger(spark), secret_scan.BASE_RULES))
        else:
            turns = spark.range(n).select(
                F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                F.lit("some words & more").alias("text"))
            noop(chat_format.digests(chat_format.render(chat_format.fold_events(chat_format.log_of(turns)))))

    run(500)
    small, large = min(seconds(lambda: run(8000)) for _ in range(2)), min(seconds(lambda: run(32_000)) for _ in range(2))
    assert large < 7 * small + 1, (small, large)
