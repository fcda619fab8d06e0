from pyspark.sql import functions as F

from glosswork.operators.joins import skew_join
from glosswork.sources.memory import memory_lookup, memory_upsert, write_memory


def test_salted_join_equals_plain_join(spark, rows):
    fact = spark.range(900).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 1, None).otherwise(
            (F.col("id") % 40).cast("string")).alias("k"))
    counts = fact.groupBy("k").agg(F.count("*").alias("n_rows"))
    answers = counts.where("k is null or k <> '5'").withColumn("a", F.concat(F.lit("answer "), F.coalesce("k", F.lit("-"))))
    by_k = {r.k: r.a for r in answers.collect()}
    plain = sorted(((r.id, r.k, by_k.get(r.k)) for r in fact.collect()), key=repr)
    for hot, per_salt in ((1_000_000, 10), (30, 10), (1, 1), (20, 1000)):
        got = skew_join(fact, answers, ["k"], hot_rows=hot, rows_per_salt=per_salt)
        assert got.columns == ["id", "k", "a"]
        assert rows(got) == plain


def test_hot_key_is_spread(spark):
    fact = spark.range(1000).select("id", F.lit("hot").alias("k"))
    answers = spark.createDataFrame([("hot", 1000, "x")], "k string, n_rows bigint, a string")
    joined = skew_join(fact, answers, ["k"], hot_rows=100, rows_per_salt=50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = joined.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in parts) == 1000
    assert len(parts) > 4


KEYED = "key_hash string, lang_in string, lang_out string, effective_model string, text string, version int"


def test_memory_keeps_latest_and_skips_blank(spark, rows, tmp_path):
    old = spark.createDataFrame([("a", "en", "zh", None, "old a", 1), ("b", "en", "zh", "m", "old b", 5)], KEYED)
    new = spark.createDataFrame([("a", "en", "zh", None, "new a", 2), ("a", "en", "zh", "m", "a m", 2),
                                 ("b", "en", "zh", "m", "new b", 2), ("c", "en", "zh", None, "", 2)], KEYED)
    merged = memory_upsert(old, new)
    assert rows(merged, "key_hash", "effective_model", "text", "version") == sorted(
        [("a", None, "new a", 2), ("a", "m", "a m", 2), ("b", "m", "old b", 5)], key=repr)
    path = write_memory(merged, str(tmp_path / "memory"), 2)
    assert spark.read.parquet(path).count() == 3
    asked = spark.createDataFrame([(1, "a", "en", "zh", None), (2, "a", "en", "zh", "x"), (3, "a", "en", "fr", None)],
                                  "seg_id int, key_hash string, lang_in string, lang_out string, effective_model string")
    assert rows(memory_lookup(asked, merged), "seg_id", "memory_text") == [(1, "new a"), (2, None), (3, None)]
    assert rows(memory_lookup(asked, merged, ignore_cache=True), "seg_id", "memory_text") == [(1, None), (2, None), (3, None)]
