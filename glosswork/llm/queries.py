"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm import (
    bpe,
    chat_format,
    conversation_repair,
    decontaminate,
    exact_dedup,
    jaccard_join,
    merkle,
    packing,
    pseudonyms,
    quality,
    repeat_removal,
    secret_scan,
    sharding,
)
from glosswork.llm.common import table
from glosswork.session import configure, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


@query
def op10_exact_dedup(spark, sf):
    return exact_dedup.mark_copies(table(spark, sf, "documents").select("doc_id", "text"))


PROBE = r"\### Assistant: </turn> ok"


@query
def op8_chat_format(spark, sf):
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.digests(chat_format.render(chat_format.fold_events(chat_format.log_of(turns))))


@query
def op2_secret_scan(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ledger = secret_scan.update_ledger(docs, scratch_path(spark, "secret-ledger"))
    found = secret_scan.findings(docs, ledger)
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in secret_scan.BASE_RULES],
        F.sha2(secret_scan.joined(of(*[r.kind for r in secret_scan.BASE_RULES])).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("secrets")).alias("spans"),
    )


@query
def op3_bpe_tree(spark, sf):
    return bpe.round_trip(table(spark, sf, "documents"), bpe.public_vocabulary())


@query
def op5_quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf, "labels"))
    return quality.with_scores(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op9_decontaminate(spark, sf):
    return decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op1_jaccard_join(spark, sf):
    rule = jaccard_join.Threshold(words=4, num=85, den=100)
    return jaccard_join.classify(table(spark, sf, "documents"), rule)


@query
def op4_packing(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), bpe.public_vocabulary())


@query
def op7_repeat_removal(spark, sf):
    return repeat_removal.find_repeats(table(spark, sf, "documents"), whole_lines=True)


# A real run gets its key from a secret store.
EXAMPLE_KEY = "example key"


@query
def op6_pseudonyms(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, EXAMPLE_KEY).select(
        "doc_id", F.size("pii").alias("n_values"),
        F.transform("pii", lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])).alias("spans"),
        F.transform("pii", lambda p: p["pseudonym"]).alias("pseudonyms"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


@query
def op11_merkle_manifest(spark, sf):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lines_gone = F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")),
    ).otherwise(F.col("text"))
    made = merkle.manifest(
        table(spark, sf, "documents").select(*columns), columns,
        also={"suspect": merkle.leaf([*map(F.col, columns[:-1]), lines_gone])})
    return made.select(
        "doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("proof"))).alias("proof_sha256"),
        merkle.fold(F.col("suspect"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_stratified_shards(spark, sf):
    placed = sharding.interleave(table(spark, sf, "documents").select("doc_id", "source", "text"), 24, "shards")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op13_repair(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.report(conversation_repair.damaged(turns), every=turns)
