"""Translate a document collection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions.text import text_key
from glosswork.operators.batching import batch_by_count, build_payload
from glosswork.operators.inference import Translator, infer
from glosswork.operators.joins import HOT_ROWS, skew_join
from glosswork.operators.replies import audit_direct, audit_replies, job_answers
from glosswork.operators.results import assemble
from glosswork.operators.segments import gate, on_pages, page_lists, segment, select_listed_pages
from glosswork.options import DEFAULT_REQUEST_MODEL, RunOptions
from glosswork.session import configure, written
from glosswork.sources.files import spread
from glosswork.sources.ledger import ledger_of
from glosswork.sources.memory import MemoryStore, lookup_keys, memory_upsert
from glosswork.sources.requests import effective_model


@dataclass(frozen=True)
class CorpusRun:
    """Tables of a finished run. ``work`` and ``audited`` are written tables;
    the others are lazy and read from them."""

    work: DataFrame  # one row per distinct text to translate, answered or not
    audited: DataFrame  # one row per backend call
    segments: DataFrame  # every selected segment with result or error
    documents: DataFrame  # assembled outputs
    fresh: DataFrame  # what this run adds to the translation memory
    memory: DataFrame  # translation memory including this run


def translate_corpus(
    spark: SparkSession,
    documents: DataFrame,
    translator: Translator,
    options: RunOptions | None = None,
    memory: DataFrame | MemoryStore | None = None,
    memory_version: int = 1,
    hot_rows: int = HOT_ROWS,
    pages: DataFrame | None = None,
) -> CorpusRun:
    """Segment, gate, dedup, look up, batch, translate, validate, assemble.

    Two tables are written to the shared scratch folder: the distinct texts with
    what the memory knew about them, since four later steps read it, and the
    audited replies, so that no backend call is ever repeated by a re-read.
    Everything else stays one lazy plan. Segments whose call failed keep their
    source text and carry the error. A run with a ``MemoryStore`` reads the buckets it
    needs; whoever runs it adds ``fresh`` to the store. ``pages`` (``doc_id, pages``) selects pages
    document by document, beside ``options.pages`` for all.
    """
    options = options or RunOptions()
    configure(spark)
    wanted, passed = _split(spread(documents), options, pages)

    distinct = _lookup(_distinct_texts(wanted, options), memory, options)
    work = written(distinct, "texts")

    calls = _audited_calls(work.where(F.col("memory_text").isNull()), translator, options)
    # The texts of a good reply are in ``translations``; only bad ones keep ``raw``.
    audited = written(calls.withColumn("raw", F.when(F.col("defect").isNotNull(), F.col("raw"))), "replies")

    answers = (
        work.join(job_answers(audited), "job_id", "left")
        .select(
            "key_hash", "effective_model", "n_rows",
            F.coalesce("memory_text", "result").alias("result"),
            F.when(F.col("memory_text").isNull() & F.col("result").isNull(),
                   F.coalesce("error", F.lit("no translation was returned"))).alias("error"),
        )
    )
    translated = skew_join(
        wanted, answers, ["key_hash", "effective_model"], hot_rows=hot_rows, spread_by=["doc_id", "pos"], sizes=work,
    ).drop("key_hash", "effective_model")
    untouched = passed.withColumns(
        {"result": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}
    )
    segments = translated.unionByName(untouched)

    fresh = (
        work.where(F.col("memory_text").isNull())
        .join(job_answers(audited).where(F.col("result").isNotNull()), "job_id")
        .select("key_hash", "lang_in", "lang_out", "effective_model",
                F.col("result").alias("text"), F.lit(memory_version).alias("version"))
    )
    return CorpusRun(
        work=work,
        audited=audited,
        segments=segments,
        documents=assemble(segments, options.mode),
        fresh=fresh,
        memory=memory_upsert(_table(memory, fresh), fresh),
    )


def _split(documents: DataFrame, options: RunOptions, pages: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Segments to translate and segments that pass through.

    Two branches instead of one flag: only the first needs hashes, the memory
    and a join, and its language filter reaches the scan.
    """
    selected = segment(documents).where(on_pages(F.col("page_no"), options.pages))
    if pages is not None:
        selected = select_listed_pages(selected, page_lists(pages))
    gated = gate(
        selected,
        options.lang_in, options.min_text_length, options.translate_table_text,
    )
    wanted = gated.where(F.col("lang") == options.lang_in).where("translate").withColumns(
        {
            "key_hash": text_key(F.col("text")),
            "effective_model": effective_model(F.lit(DEFAULT_REQUEST_MODEL), options.model).cast("string"),
        }
    )
    return wanted, gated.where("NOT translate")


def _distinct_texts(wanted: DataFrame, options: RunOptions) -> DataFrame:
    """One row per text: repeats collapse inside each task before the shuffle, so
    the text itself travels once per task at most."""
    texts = wanted.groupBy("key_hash", "effective_model").agg(
        F.min(F.struct("doc_id", "pos")).alias("first"),
        F.count("*").alias("n_rows"),
        F.first("text").alias("text"),  # all rows of a group hold the same text
    )
    return texts.select(
        F.concat_ws("@", "key_hash", "effective_model").alias("job_id"),
        "key_hash",
        F.lit(options.lang_in).alias("lang_in"),
        F.lit(options.lang_out).alias("lang_out"),
        "effective_model",
        F.pmod(F.col("first.doc_id"), F.lit(options.workers)).cast("int").alias("shard"),
        "first.doc_id",
        "first.pos",
        "n_rows",
        "text",
    )


def _table(memory: DataFrame | MemoryStore | None, like: DataFrame) -> DataFrame:
    if memory is None:
        return like.where("false")
    return memory.table() if isinstance(memory, MemoryStore) else memory


def _lookup(texts: DataFrame, memory: DataFrame | MemoryStore | None, options: RunOptions) -> DataFrame:
    """Add ``memory_text`` and drop the source text of hits."""
    if memory is None or options.ignore_cache:
        return texts.withColumn("memory_text", F.lit(None).cast("string"))
    found = memory.lookup(texts) if isinstance(memory, MemoryStore) else lookup_keys(texts, memory)
    return found.withColumn(
        "text", F.when(F.col("memory_text").isNull(), F.col("text"))
    )


def _audited_calls(jobs: DataFrame, translator: Translator, options: RunOptions) -> DataFrame:
    if options.transport == "direct":
        # One call per text, so there is nothing to number, sort or group.
        calls = jobs.select(
            "shard", F.lit(None).cast("bigint").alias("batch_no"), "effective_model",
            F.array("job_id").alias("job_ids"), F.col("text").alias("payload"),
        )
        return audit_direct(infer(calls, translator, options.parallelism, options.timeout_s, ledger_of(options)))
    messages = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))
    queued = jobs.select("job_id", "shard", "doc_id", "pos", "effective_model", messages.alias("messages"))
    batches = build_payload(batch_by_count(queued, options.batch_limit))
    return audit_replies(infer(batches, translator, options.parallelism, options.timeout_s, ledger_of(options)))
