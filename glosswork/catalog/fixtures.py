"""Inputs derived from the test tables.

Each expression below is plain SQL that Spark and the checking engine read
alike, so the two sides start from the same rows. What the operators do with
them is written twice: as DataFrame code in the package and as SQL in
``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.operators.batching import batch_by_count, build_payload
from glosswork.operators.segments import gate, segment
from glosswork.functions.text import text_key
from glosswork.sources.files import spread
from glosswork.sources.requests import route_model

WORKERS = 8
MAX_BATCH = 4

# --- files -------------------------------------------------------------------

CANDIDATE_PATH = """'/corpus/' || source || '/' || doc_id || CASE doc_id % 8
  WHEN 0 THEN '.PDF' WHEN 1 THEN '.Pdf' WHEN 2 THEN '.txt' WHEN 3 THEN ''
  WHEN 4 THEN '.pdf.bak' WHEN 5 THEN '/.pdf' ELSE '.pdf' END"""
FILE_PRESENT = "doc_id % 7 <> 0"

# --- requests ----------------------------------------------------------------

REQUESTED_MODEL = """CASE (doc_id + pos) % 5 WHEN 0 THEN '' WHEN 1 THEN 'codex'
  WHEN 2 THEN ' default ' WHEN 3 THEN 'model-x' ELSE 'Model-Y' END"""

# `messages` is the JSON array of a conversation's turns.
REQUEST_BODY = """CASE conv_id % 12
  WHEN 0 THEN '' WHEN 1 THEN 'translate: ' || messages WHEN 2 THEN messages
  WHEN 3 THEN '{"model":"model-x"}' WHEN 4 THEN '{"messages":[]}'
  WHEN 5 THEN '{"messages":[{"role":"user"},7]}'
  WHEN 6 THEN '{"messages":' || messages || '}'
  WHEN 7 THEN '{"model":"","messages":' || messages || '}'
  WHEN 8 THEN '{"model":12,"messages":' || messages || '}'
  WHEN 9 THEN '{"messages":{"role":"user"}}'
  WHEN 10 THEN '{"messages":' || messages || '} trailing'
  ELSE '{"model":" model-x ","messages":' || messages || '}' END"""

PAGE_LIST = """CASE doc_id % 7 WHEN 0 THEN '1,2,4-6' WHEN 1 THEN (doc_id % 3 + 1) || '-' || (doc_id % 3 + 2)
  WHEN 2 THEN ' 2 , 2 - 3 ,9' WHEN 3 THEN '3-1' WHEN 4 THEN '1,x' WHEN 5 THEN '' || (doc_id % 4 + 1) END"""
HAS_PAGE_LIST = "doc_id % 5 <> 0"

# --- replies -----------------------------------------------------------------

SINGLE_REPLY = """CASE doc_id % 8
  WHEN 0 THEN '{"translation":"   "}' WHEN 1 THEN '{"translation":7}'
  WHEN 2 THEN '[' || quoted || ']' WHEN 3 THEN '{"translation":' || quoted
  WHEN 4 THEN '{"text":' || quoted || '}' WHEN 5 THEN '{"translation":' || quoted || '} done'
  WHEN 6 THEN '  {"translation":' || quoted || '}  ' ELSE '{"translation":' || quoted || '}' END"""

TOKENS = """CASE pos % 4 WHEN 0 THEN ' see http://x.org/a?b=1 and [12] [12]'
  WHEN 1 THEN ' TP53 {v1} PMID:12345 {v1}' WHEN 2 THEN ' <b>3.5</b> mg' ELSE '' END"""
TOKENS_OUT = """CASE pos % 12 WHEN 0 THEN ' http://x.org/a?b=1 [12]' WHEN 1 THEN ' TP53 {v1} PMID:1234'
  WHEN 2 THEN ' <b>3.5 mg' WHEN 3 THEN ' [7]' WHEN 4 THEN ' see http://x.org/a?b=1 and [12] [12]'
  WHEN 5 THEN ' TP53 {v1} PMID:12345 {v1}' WHEN 6 THEN ' <b>3.5</b> mg' ELSE '' END"""

# --- job events --------------------------------------------------------------

EVENT_BODY = """CASE event_type
  WHEN 'click' THEN '{"type":"progress","stage":"parse","overall_progress":' || ((event_id % 17) * 125) || 'e-3}'
  WHEN 'view' THEN '{"type":"progress","phase":"translate","progress":' || (event_id % 201) || '}'
  WHEN 'purchase' THEN '{"type":"progress","stage":"","name":"typeset","progress":{"current":' ||
       (event_id % 7) || ',"total":' || (event_id % 5) || '}}'
  WHEN 'signup' THEN CASE event_id % 8
    WHEN 0 THEN '{"type":"progress","overall_progress":null,"progress":0.5}'
    WHEN 1 THEN '{"type":"progress","stage":null,"phase":"layout","progress":"half"}'
    WHEN 2 THEN '{"type":"progress","stage":3,"progress":true}'
    WHEN 3 THEN '[{"type":"finish"}]' WHEN 4 THEN '{"type":"progress"'
    WHEN 5 THEN '{"type":"progress","stage":"save","progress":{"current":"1","total":2}}'
    WHEN 6 THEN '{"type":"progress","stage":"save","progress":-0.25}'
    ELSE '{"type":"progress","stage":false,"name":"load","progress":0.025}' END
  ELSE CASE WHEN user_id % 4 = 3 THEN '{"type":"log"}' ELSE CASE event_id % 10
    WHEN 0 THEN '{"type":"error","error":"failed at ' || event_id || '"}'
    WHEN 1 THEN '{"type":"error","error":""}' WHEN 2 THEN
         '{"type":"finish","translate_result":{"mono_pdf_path":"m/../' || event_id || '.pdf","dual_pdf_path":' ||
         CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '""' ELSE '"/vault/out/d' || event_id || '.pdf"' END || '}}'
    WHEN 3 THEN '{"type":"finish"}' WHEN 4 THEN '{"type":"finish","translate_result":null}'
    ELSE '{"type":"log"}' END END END"""

# --- logs and results --------------------------------------------------------

_RECORD = """'{"input_pdf":"/in/' || doc_id || '.pdf","mono_pdf":null,"dual_pdf":"/out/' || doc_id || '.pdf"}'"""
STDOUT = f"""CASE doc_id % 11
  WHEN 0 THEN {_RECORD} WHEN 1 THEN '\ufeff' || {_RECORD} || chr(10)
  WHEN 2 THEN text || chr(10) || '  ' || {_RECORD} WHEN 3 THEN {_RECORD} || chr(13) || chr(10) || text
  WHEN 4 THEN '{{"input_pdf":"old","mono_pdf":"old","dual_pdf":null}}' || chr(13) || {_RECORD} || chr(10) || text
  WHEN 5 THEN {_RECORD} || chr(10) || '{{"input_pdf":"","mono_pdf":"x","dual_pdf":"y"}}' || chr(10) || '{{broken}}'
  WHEN 6 THEN '{{"input_pdf":7,"mono_pdf":"x","dual_pdf":null}}'
  WHEN 7 THEN '{{"input_pdf":"a","mono_pdf":null,"dual_pdf":null}}'
  WHEN 8 THEN '{{"input_pdf":"a","dual_pdf":"x"}}' WHEN 9 THEN '[' || {_RECORD} || ']' ELSE text END"""
STDERR = """CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL
  WHEN 2 THEN '  error in ' || source || chr(10) ELSE text END"""

MONO_PDF = """CASE doc_id % 6 WHEN 0 THEN 'm/' || doc_id || '.pdf' WHEN 1 THEN '/vault/out/m' || doc_id || '.pdf'
  WHEN 2 THEN '/tmp/m' || doc_id || '.pdf' WHEN 3 THEN '../../escape/' || doc_id || '.pdf' WHEN 4 THEN '' END"""
DUAL_PDF = """CASE doc_id % 5 WHEN 0 THEN './d/../d' || doc_id || '.pdf'
  WHEN 1 THEN '/vault/outx/../out/d' || doc_id || '.pdf' WHEN 2 THEN NULL
  WHEN 3 THEN '/vaultother/d' || doc_id || '.pdf' ELSE '' END"""
OUTPUT_DIR, ROOT = "/vault/out", "/vault"

# --- library -----------------------------------------------------------------

ATTACHMENT_TITLE = """CASE WHEN doc_id % 11 = 0 THEN '[Translated] ' || doc_id
  WHEN doc_id % 13 = 0 THEN '' ELSE 'Paper ' || doc_id END"""
ATTACHMENT_ITEM = "CASE WHEN doc_id % 17 <> 0 THEN source END"
ATTACHMENT_FILE = "CASE WHEN doc_id % 26 <> 0 THEN doc_id || '.pdf' ELSE '' END"
ATTACHMENT_PATH = "'/library/' || doc_id || '.pdf'"
IS_PDF = "doc_id % 9 <> 1"
LIBRARY_ID = "CAST(doc_id % 3 AS INTEGER)"
ITEM_TITLE = "CASE WHEN length(source) = 4 THEN 'Item ' || source ELSE '' END"

# --- runs --------------------------------------------------------------------

N_CREATED = "CASE WHEN doc_id % 10 < 6 THEN 1 WHEN doc_id % 10 = 6 THEN 2 END"
RUN_ERROR = "CASE doc_id % 10 WHEN 7 THEN 'file is missing' WHEN 8 THEN 'exit code ' || (doc_id % 4) END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(spread(table(spark, sf_dir, "documents")))


def wanted_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate(segments(spark, sf_dir)).where("translate").withColumn(
        "requested_model", F.expr(REQUESTED_MODEL)
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = route_model(wanted_segments(spark, sf_dir))
    return routed.select(
        F.col("seg_id").alias("job_id"),
        F.expr(f"CAST(doc_id % {WORKERS} AS INTEGER)").alias("shard"),
        "doc_id",
        "pos",
        "effective_model",
        F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))).alias("messages"),
    )


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_by_count(jobs(spark, sf_dir), MAX_BATCH)


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_payload(batched(spark, sf_dir))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches paired with replies that carry one defect each, by batch number."""
    ids = F.col("job_ids")
    row = lambda i: F.concat(F.lit('{"id":"'), i, F.lit('","text":" T '), i, F.lit(' "}'))
    rows, first = F.transform(ids, row), F.get(ids, F.lit(0))
    one = lambda head, tail: F.array(F.concat(F.lit(head), first, F.lit(tail)))
    rest = F.slice(rows, F.lit(2), F.size(rows))
    wrap = lambda items: F.concat(F.lit('{"translations":['), F.array_join(items, ","), F.lit("]}"))
    cases = [
        wrap(rows),
        wrap(F.reverse(rows)),
        F.lit("I cannot do that"),
        F.lit('{"answers":[]}'),
        F.lit('{"translations":{"id":"1"}}'),
        wrap(rest),
        wrap(F.concat(rows, F.array(F.lit('{"id":"x","text":"y"}')))),
        wrap(F.concat(rows, F.array(row(first)))),
        wrap(F.concat(one('{"id":"', '","text":"  "}'), rest)),
        wrap(F.concat(F.array(F.lit('{"id":1,"text":"one"}')), rest)),
        wrap(F.concat(F.array(F.lit("7")), rows)),
        wrap(F.concat(rows, one('{"id":"', '","text":""}'))),
        F.concat(wrap(rows), F.lit(" done")),
        F.array_join(F.array(F.lit("["), F.array_join(rows, ","), F.lit("]")), ""),
        F.lit(None).cast("string"),
    ]
    raw = F.get(F.array(*cases), F.pmod(F.col("batch_no"), F.lit(len(cases))).cast("int"))
    return batches(spark, sf_dir).drop("payload").withColumn("raw", raw)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.to_json(
            F.transform(
                F.sort_array(F.collect_list(F.struct("turn", "role", "text"))),
                lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")),
            )
        ).alias("messages")
    )
    return turns.select(F.col("conv_id").alias("req_id"), F.expr(REQUEST_BODY).alias("body"))


# Replies of the backend in event time, in three arrivals; the last has late ones.
STATUS_DELAY_DAYS = 4
TIMED_REPLY = {
    "effective_model": "CASE event_type WHEN 'click' THEN 'model-x' WHEN 'view' THEN 'Model-Y' END",
    "n_jobs": "event_id % 4 + 1", "answered": "event_id % 7 <> 0", "failed": "event_id % 5 = 0", 
    "arrival": "CASE WHEN user_id % 3 = 0 THEN 2 ELSE event_id % 2 END",
}


def timed_replies(events: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    made = {name: F.expr(sql) for name, sql in TIMED_REPLY.items()}
    return events.select(
        ts.alias("at"), made["effective_model"].alias("effective_model"),
        F.expr(f"transform(sequence(1, {TIMED_REPLY['n_jobs']}), i -> CAST(i AS STRING))").alias("job_ids"),
        made["answered"].alias("answered"), F.when(made["failed"], "backend").alias("defect"), made["arrival"].alias("arrival"))


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a file stream (a stream reads folders or patterns)."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def document_requests(documents: DataFrame) -> DataFrame:
    quoted = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))
    rows = documents.select(F.col("doc_id").alias("conv_id"), quoted.alias("messages"))
    return rows.select(F.col("conv_id").alias("req_id"), F.expr(REQUEST_BODY).alias("body"))


def event_bodies(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.expr(EVENT_BODY).alias("body")
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bodies(spread(table(spark, sf_dir, "events")))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("job_id"), F.expr(STDOUT).alias("stdout"), F.expr(STDERR).alias("stderr")
    )


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    best = (
        documents.join(labels.where("quality = 1"), "doc_id")
        .groupBy("source").agg(F.min("doc_id").alias("best_id"))
    )
    return documents.join(best, "source", "left").select(
        F.col("doc_id").alias("attachment_id"),
        F.expr(ATTACHMENT_ITEM).alias("item_id"),
        F.expr(LIBRARY_ID).alias("library_id"),
        F.col("doc_id").alias("child_pos"),
        F.expr("coalesce(doc_id = best_id, false)").alias("is_best"),
        F.expr(IS_PDF).alias("is_pdf"),
        F.expr(ATTACHMENT_TITLE).alias("title"),
        F.expr(ATTACHMENT_FILE).alias("filename"),
        F.expr(ATTACHMENT_PATH).alias("path"),
    )


def library_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(FILE_PRESENT).select(F.expr(ATTACHMENT_PATH).alias("path"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    return sources.select(F.col("source").alias("item_id"), F.expr(ITEM_TITLE).alias("title"))


def libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(F.expr(LIBRARY_ID).alias("library_id")).distinct()
    return ids.withColumn("files_editable", F.expr("CASE library_id WHEN 0 THEN true WHEN 1 THEN false END"))


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document directly, and every item through its first document."""
    documents = table(spark, sf_dir, "documents")
    direct = documents.where("doc_id % 2 = 0").select(
        (F.col("doc_id") * 2).alias("sel_pos"), F.col("doc_id").alias("attachment_id"),
        F.lit(None).cast("string").alias("item_id"),
    )
    via_item = documents.groupBy("source").agg((F.min("doc_id") * 2 + 1).alias("sel_pos")).select(
        "sel_pos", F.lit(None).cast("bigint").alias("attachment_id"), F.col("source").alias("item_id")
    )
    return direct.unionByName(via_item)


def memory_rows(spark: SparkSession, sf_dir: str, first: bool) -> DataFrame:
    """Translations of all segments in five versions, by document: the first version,
    or the other four."""
    part = F.col("doc_id") % 5
    rows = wanted_segments(spark, sf_dir).where(part == 0 if first else part != 0)
    version = (part + 1).cast("int")
    return with_memory_key(rows).select(
        "key_hash", "lang_in", "lang_out", "effective_model",
        F.concat(F.lit("[v"), version, F.lit("] "), "text").alias("text"), version.alias("version"),
    )


def with_memory_key(rows: DataFrame) -> DataFrame:
    return route_model(rows).withColumns(
        {"key_hash": text_key(F.col("text")), "lang_in": F.lit("en"), "lang_out": F.lit("zh")}
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("job_id"),
        F.col("source").alias("title"),
        F.expr("'/in/' || source || '/é' || doc_id || '.pdf'").alias("input_pdf"),
        F.expr(MONO_PDF).alias("mono_pdf"),
        F.expr(DUAL_PDF).alias("dual_pdf"),
    )


def output_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").where(FILE_PRESENT)
    return documents.select(
        F.explode(F.array(*[
            F.expr(f"'/vault/out/{p}' || doc_id || '.pdf'") for p in ("m/", "m", "d")
        ])).alias("path")
    )


def run_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.expr("doc_id % 7").alias("run_id"), F.col("doc_id").alias("target_pos"),
        F.col("doc_id").alias("attachment_id"), F.expr("source || ' ' || doc_id").alias("display_title"),
    )


def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id % 10 <> 9").select(
        F.col("doc_id").alias("attachment_id"), F.expr(N_CREATED).alias("n_created"), F.expr(RUN_ERROR).alias("error")
    )
