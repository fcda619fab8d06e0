import json

import pytest
from pyspark.sql import functions as F

from glosswork import RunOptions
from glosswork import __main__ as job
from glosswork.operators.inference import OfflineTranslator
from glosswork.operators.segments import dedup_segments, gate, page_lists, parse_pages, segment, select_listed_pages
from glosswork.plans.corpus import translate_corpus
from glosswork.session import size_shuffles


@pytest.fixture(scope="module")
def documents(spark):
    """One text fills more than a third of all segments."""
    rows = [
        (d, "\n".join([f"Line {d} {n} of the text" for n in range(12)] + ["This line is everywhere."] * 8 + ["", "abc", " a | b | c "]),
         "en" if d % 4 else "fr", "s", 0)
        for d in range(20)
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_every_segment_ends_once_and_batches_stay_small(spark, documents):
    run = translate_corpus(spark, documents, OfflineTranslator(), RunOptions(workers=3, max_batch=5, mode="both"), hot_rows=50)
    segments = run.segments.cache()
    assert segments.count() == segment(documents).count()
    assert segments.groupBy("seg_id").count().where("count > 1").count() == 0
    assert segments.where("translate").where("result is null").count() == 0
    assert segments.where("NOT translate").where("result is not null or error is not null").count() == 0
    assert run.audited.agg(F.max(F.size("job_ids"))).first()[0] <= 5
    # 15 English documents: 12 own lines and a table row each, one shared line.
    assert run.work.count() == 15 * 12 + 1 + 1
    assert run.work.where("n_rows = 120").count() == 1
    mono = run.documents.where("kind = 'mono'").collect()
    source = {r.doc_id: r for r in documents.collect()}
    assert len(mono) == 20
    for r in mono:
        lines, original = r.text.split("\n"), source[r.doc_id].text.split("\n")
        assert len(lines) == len(original)
        if source[r.doc_id].lang == "fr":
            assert lines == original
        else:
            assert lines[:20] == [f"[zh] {line}" for line in original[:20]] and lines[20:22] == original[20:22]


def test_second_run_makes_no_calls(spark, documents):
    first = translate_corpus(spark, documents, OfflineTranslator())
    again = translate_corpus(spark, documents, OfflineTranslator(broken_models=[None]), memory=first.memory, memory_version=2)
    assert again.audited.count() == 0
    assert again.segments.where("translate").where("result is null").count() == 0
    assert again.memory.count() == first.memory.count()
    forced = translate_corpus(spark, documents, OfflineTranslator(), RunOptions(ignore_cache=True), memory=first.memory)
    assert forced.audited.count() == first.audited.count()


def test_failed_calls_keep_the_source_and_are_not_remembered(spark, documents):
    run = translate_corpus(spark, documents, OfflineTranslator(broken_models=["m"]), RunOptions(model="m", mode="mono"))
    failed = run.segments.where("translate")
    assert failed.where("error is null").count() == 0
    assert failed.select("error").distinct().first()[0] == "batch translation failed: model m is not available"
    assert run.memory.count() == 0
    texts = {r.doc_id: r.text for r in run.documents.collect()}
    assert texts == {r.doc_id: r.text for r in documents.collect()}


def test_direct_transport_calls_once_per_text(spark, documents):
    options = RunOptions(transport="direct", pages="1", translate_table_text=False, parallelism=3)
    run = translate_corpus(spark, documents, OfflineTranslator(direct=True), options)
    assert run.audited.count() == run.work.count() == 15 * 10
    assert run.segments.where("translate").where("result is null").count() == 0
    assert run.segments.agg(F.max("page_no")).first()[0] == 1


def test_calls_are_made_once(spark, documents, tmp_path):
    log = str(tmp_path / "calls")

    def counting(payload, model):
        with open(log, "a") as f:
            f.write("x")
        return OfflineTranslator()(payload, model)

    run = translate_corpus(spark, documents, counting)
    for frame in (run.segments, run.documents, run.memory, run.audited):
        frame.count()
    with open(log) as f:
        assert len(f.read()) == run.audited.count()


def test_page_expressions():
    assert parse_pages(None) is None
    assert parse_pages("1,2,4-6") == [(1, 2), (4, 6)]
    assert parse_pages("5, 3-4 ,1-1") == [(1, 1), (3, 5)]
    for bad in ("", "0", "a", "3-1", "1,,2", "-2", "2-", "1.5"):
        with pytest.raises(ValueError):
            parse_pages(bad)


def test_gate_and_dedup(spark, rows):
    frame = spark.createDataFrame(
        [(1, 0, "en", "text", "abcde"), (1, 1, "en", "text", " abcd　"), (1, 2, "fr", "text", "abcdef"), (1, 3, "en", "table", "a | b | c"),
         (1, 4, None, "text", "abcdef"), (2, 0, "en", "text", "abcde"), (2, 1, "en", "text", None)],
        "doc_id int, pos int, lang string, kind string, text string")
    assert rows(gate(frame).where("translate"), "doc_id", "pos") == [(1, 0), (1, 3), (2, 0)]
    assert rows(gate(frame, translate_table_text=False).where("translate"), "doc_id", "pos") == [(1, 0), (2, 0)]
    assert gate(frame, min_text_length=0).where("translate").where("length(trim(text)) = 0").count() == 0
    same = dedup_segments(frame.where("text = 'abcde'").withColumn("effective_model", F.lit(None).cast("string"))).collect()
    assert len(same) == 1 and same[0].n_rows == 2 and tuple(same[0]["first"]) == (1, 0)


def test_options():
    assert RunOptions().batch_limit == 4 and RunOptions(transport="direct").batch_limit == 1 and RunOptions().deadline_s == 330
    for bad in ({"mode": "x"}, {"transport": "x"}, {"timeout_s": 0}, {"transport": "direct", "timeout_s": 271}, {"max_batch": 0},
                {"max_batch": 65}, {"window_ms": -1}, {"window_ms": 5001}, {"workers": 0}, {"parallelism": 0}):
        with pytest.raises(ValueError):
            RunOptions(**bad)


def upper(payload, model):
    jobs = json.loads(payload)
    return json.dumps({"translations": [{"id": j["id"], "text": j["messages"][0]["content"].upper()} for j in jobs]})


def upper_direct(payload, model):
    return json.dumps({"translation": payload.upper()})


@pytest.mark.parametrize("extra, name", [([], "upper"), (["--transport", "direct"], "upper_direct")])
def test_job_writes_outputs_and_memory(spark, documents, tmp_path, extra, name):
    few = documents.where("doc_id in (1, 4)")
    few.write.parquet(str(tmp_path / "in"))
    job.run(spark, job.parse([str(tmp_path / "in"), str(tmp_path / "out"), "--translator", f"tests.test_corpus:{name}", "--mode", "mono", "--pages", "1", *extra]))
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "out/documents")).collect()}
    assert texts[1].split("\n")[0] == "LINE 1 0 OF THE TEXT" and texts[4].split("\n")[0] == "Line 4 0 of the text"
    assert spark.read.parquet(str(tmp_path / "out/failures")).count() == 0
    assert spark.read.parquet(str(tmp_path / "out/status")).first().failed_batches == 0
    again = job.run(spark, job.parse([str(tmp_path / "in"), str(tmp_path / "again"), "--memory", str(tmp_path / "out/memory/version=1"),
                                      "--version", "2", "--pages", "1", *extra]))
    assert again.audited.count() == 0


def test_null_texts_pass_through(spark):
    documents = spark.createDataFrame([(1, None, "en"), (2, "some text", "en")], "doc_id long, text string, lang string")
    run = translate_corpus(spark, documents, OfflineTranslator(), RunOptions(mode="mono"))
    assert {(r.doc_id, r.text) for r in run.documents.collect()} == {(1, ""), (2, "[zh] some text")}
    assert run.segments.where("doc_id = 1").first().text is None


def test_planning_runs_no_job(spark):
    from glosswork.sources.files import spread

    shuffled = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert spread(shuffled) is shuffled
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


def test_shuffle_sizing(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, 100 * 10**12) == 372_530
        assert size_shuffles(spark, 1) == 372_530
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_page_lists_by_document(spark):
    lists = {1: "1,2,4-6", 2: "3 - 1", 3: "x", 4: None, 5: " 2 ", 6: "0", 7: "99999999999999999999", 8: ""}
    table = spark.createDataFrame([*lists.items(), (5, "4-5"), (4, "1")], "doc_id bigint, pages string")
    got = {r.doc_id: r for r in page_lists(table).collect()}
    assert [(r.low, r.high) for r in got[1].ranges] == [(1, 1), (2, 2), (4, 6)] and got[4].ranges is None and got[4].error is None
    assert {d: r.error for d, r in got.items() if r.error} == {
        2: "page range runs backwards: 3 - 1", **{d: f"not a page or page range: {lists[d]}" for d in (3, 6, 7, 8)}}
    rows = spark.range(1, 10).selectExpr("id AS doc_id", "explode(sequence(1, 7)) AS page_no")
    kept = {}
    for r in select_listed_pages(rows, page_lists(table)).collect():
        kept.setdefault(r.doc_id, []).append(r.page_no)
    assert {d: sorted(p) for d, p in kept.items()} == {1: [1, 2, 4, 5, 6], 4: list(range(1, 8)), 5: [2, 4, 5], 9: list(range(1, 8))}


def test_a_run_selects_pages_document_by_document(spark, documents):
    pages = spark.createDataFrame([(1, "2"), (2, "1-2"), (3, "9")], "doc_id bigint, pages string")
    run = translate_corpus(spark, documents, OfflineTranslator(), RunOptions(), pages=pages)
    seen = {(r.doc_id, r.page_no) for r in run.segments.where("doc_id IN (1, 2, 3)").collect()}
    assert seen == {(1, 2), (2, 1), (2, 2)}
