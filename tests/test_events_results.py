import json
import random

import pytest
from pyspark.sql import functions as F

from glosswork.functions import json_values
from glosswork.operators.events import job_outcome, progress
from glosswork.operators.library import best_attachment, collect_targets
from glosswork.operators.reports import error_text, failure_counts, failure_report, first_failures, run_summary
from glosswork.operators.results import assemble, output_manifest, result_records, salvage_results, write_manifest, write_outputs
from glosswork.sources.files import gate_inputs, read_inputs, read_text

P = '{"type":"progress",'
LABELS = {
    P + '"stage":"s","progress":0.125}': "s: 12%", P + '"stage":"s","progress":0.025}': "s: 2%",
    P + '"stage":"s","progress":1}': "s: 100%", P + '"stage":"s","progress":2.5}': "s: 2%",
    P + '"stage":"s","progress":0}': "s: 0%", P + '"stage":"s","progress":-0.25}': "s: -0%",
    P + '"phase":"p","progress":"x"}': "p", P + '"name":"n"}': "n", P + '"stage":0,"name":""}': "working",
    P + '"stage":true}': "True", P + '"stage":"s","progress":true}': "s: 100%",
    P + '"stage":"s","progress":{"current":1,"total":3}}': "s: 33%", P + '"stage":"s","progress":{"current":1,"total":0}}': "s",
    P + '"stage":"s","progress":{"current":"1","total":2}}': "s", P + '"stage":"s","progress":{"current":7,"total":5}}': "s: 1%",
    P + '"stage":"s","overall_progress":null,"progress":0.5}': "s", P + '"stage":"s","overall_progress":55,"progress":1}': "s: 55%",
    P + '"stage":"s","progress":1e30}': "s: 1000000000000000019884624838656%",
}


def test_progress_labels(spark):
    frame = spark.createDataFrame([(1, n, b) for n, b in enumerate(LABELS)] + [(1, 99, "[]"), (1, 98, "x"), (1, 97, '{"type":"log"}')],
                                  "job_id bigint, seq bigint, body string")
    got = {r.seq: r.label for r in progress(frame).collect()}
    want = dict(enumerate(LABELS.values()))
    want[len(LABELS) - 1] = got[len(LABELS) - 1]  # digits of huge doubles are not compared
    assert got == want and want[len(LABELS) - 1].startswith("s: 1000000000000000")


@pytest.mark.parametrize("blocks", [(2, 4), (1, 2), (4096, 4096 * 4096)])
def test_first_terminal_event_decides(spark, blocks):
    step = lambda n: P + f'"stage":"s","progress":{n}}}'
    events = [
        (1, 1, step(10)), (1, 2, step(20)), (1, 3, '{"type":"finish","translate_result":{}}'), (1, 4, '{"type":"error","error":"late"}'), (1, 5, step(30)),
        (2, 1, '{"type":"error"}'), (2, 2, '{"type":"finish","translate_result":1}'), (3, 1, '{"type":"finish"}'),
        (4, 1, '{"type":"finish","translate_result":null}'), (5, 2, step(5)), (5, 1, "[]"), (6, 1, "junk"),
        (7, 1, '{"type":["error"]}'), (7, 2, '{"type":"error","error":"boom"}'),
    ]
    frame = spark.createDataFrame(events, "job_id bigint, seq bigint, body string")
    got = {r.job_id: (r.outcome, r.error, r.n_progress, r.last_label) for r in job_outcome(frame, blocks).collect()}
    assert got == {
        1: ("finish", None, 2, "s: 20%"), 2: ("error", "translation failed", 0, None), 3: ("empty_result", None, 0, None),
        4: ("empty_result", None, 0, None), 5: ("no_result", None, 1, "s: 5%"), 6: ("no_result", None, 0, None),
        7: ("error", "boom", 0, None),
    }


def test_busy_job_matches_a_plain_walk(spark):
    rng = random.Random(5)
    events = []
    for job, n, first_end in ((1, 700, 650), (2, 300, None), (3, 40, 0)):
        for i, seq in enumerate(sorted(rng.sample(range(5000), n))):
            if first_end is not None and (i == first_end or (i > first_end and rng.random() < 0.1)):
                events.append((job, seq, '{"type":"error","error":"e%d"}' % seq))
            else:
                events.append((job, seq, P + '"stage":"s%d","progress":%d}' % (seq, seq)))
    rng.shuffle(events)
    want = {}
    for job, seq, body in sorted(events):
        outcome, error, count, label = want.get(job, ("no_result", None, 0, None))
        if outcome == "no_result":
            if "error" in body:
                outcome, error = "error", f"e{seq}"
            else:
                count, label = count + 1, f"s{seq}: {100 if seq == 1 else seq}%"
        want[job] = (outcome, error, count, label)
    frame = spark.createDataFrame(events, "job_id bigint, seq bigint, body string")
    for blocks in ((16, 256), (4096, 4096 * 4096)):
        got = {r.job_id: (r.outcome, r.error, r.n_progress, r.last_label) for r in job_outcome(frame, blocks).collect()}
        assert got == want


def rec(**fields):
    return json.dumps(fields)


GOOD = rec(input_pdf="i", mono_pdf=None, dual_pdf="d")
LOGS = [
    (GOOD, None, "d", False), ("﻿ " + GOOD + "\n", None, "d", False), ("noise\n" + GOOD, None, "d", True),
    (GOOD + "\r\nnoise", None, "d", True), (GOOD + "\r" + rec(input_pdf="i", mono_pdf="m", dual_pdf="d2"), None, "d2", True),
    (GOOD + "\n" + rec(input_pdf="", mono_pdf="m", dual_pdf=None) + "\n{x}", None, "d", True),
    (rec(input_pdf="", mono_pdf="m", dual_pdf="d"), "input_pdf", None, False), (rec(input_pdf="i", dual_pdf="d"), "mono_pdf", None, False),
    (rec(input_pdf="i", mono_pdf="m", dual_pdf=""), "dual_pdf", None, False), ("[1]", "object", None, False), ("", "parse", None, False),
    (rec(input_pdf="i", mono_pdf=None, dual_pdf=None), "both_null", None, False), ("x {}", "parse", None, False),
    (GOOD + " trailing", "parse", None, False), ("a\n" + rec(input_pdf=1, mono_pdf="m", dual_pdf=None), "parse", None, False),
    (GOOD + "\n" + GOOD, None, "d", True), ("null", "object", None, False),
]


@pytest.mark.parametrize("limit", [json_values.VARIANT_BYTES, -1, 60])
def test_salvage_matrix(spark, monkeypatch, limit):
    """Outputs over the limit of one parsed value give what they give below it."""
    monkeypatch.setattr(json_values, "VARIANT_BYTES", limit)
    frame = spark.createDataFrame([(n, log[0]) for n, log in enumerate(LOGS)], "job_id int, stdout string")
    got = {r.job_id: (r.problem, r.dual_pdf, r.recovered) for r in salvage_results(frame).collect()}
    assert got == {n: log[1:] for n, log in enumerate(LOGS)}


def test_values_over_the_limit_are_read_whole_or_not_at_all(spark, monkeypatch):
    texts = ['{"a":"x","b":null,"z":[1,{"a":5}]}', '{"a":5,"b":{"k":1}}', "[1,2]", '"s"', "12", '{"a":1} x', '{"a":1},{"a":2}', '{"a":1}], [3',
             "{", '{"a":tru}', '{"a":"\\u00e9\\n"}', '{"a":01}', "{'a':1}", '{"a":1,}', '{"z":NaN}', "", "[1], [2", '[1],{"_mark":1}', "[NaN]", "{}"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    shown = lambda v: frame.select(json_values.kind(v).alias("kind"), v.cast("string").alias("value")).collect()
    small = shown(json_values.strict_json(F.col("t")))
    monkeypatch.setattr(json_values, "VARIANT_BYTES", -1)
    large = shown(json_values.record_json(F.col("t"), ["a", "b"]))
    for text, whole, members in zip(texts, small, large, strict=True):
        if whole.kind is None:
            assert members.kind is None, text
        elif text.startswith("{"):
            assert json.loads(members.value) == {k: v for k, v in json.loads(text).items() if k in "ab"}
        else:
            assert members.kind == "VOID", text


def test_logs_over_the_limit(spark):
    size = f"CAST(id + {json_values.VARIANT_BYTES} AS int)"  # not a constant, which plans would spell out
    frame = spark.range(4).selectExpr("CAST(id AS int) AS job_id", f"""CASE id
        WHEN 0 THEN concat('{GOOD[:-1]}, "log": "', repeat('x', {size}), '"}}')
        WHEN 1 THEN concat(repeat('noise and more\n', CAST({size} / 15 + 1 AS int)), '{GOOD}', '\nend')
        WHEN 2 THEN concat('start\n', '{GOOD[:-1]}, "log": "', repeat('x', {size}), '"}}')
        ELSE concat('{GOOD[:-1]}, "log": "', repeat('x', {size}), '"') END AS stdout""")
    got = {r.job_id: (r.problem, r.dual_pdf, r.recovered) for r in salvage_results(frame).drop("stdout").collect()}
    assert got == {0: (None, "d", False), 1: (None, "d", True), 2: (None, "d", True), 3: ("parse", None, False)}


def test_manifest_and_records(spark, rows, tmp_path):
    results = spark.createDataFrame(
        [(1, "é", "i", "m.pdf", "/v/d.pdf"), (2, "t", "i", "../../x", None), (3, "t", "i", None, ""), (4, "t", "i", "gone.pdf", "/vv/d")],
        "job_id int, title string, input_pdf string, mono_pdf string, dual_pdf string")
    files = spark.createDataFrame([("/v/o/m.pdf",), ("/v/d.pdf",), ("/v/d.pdf",)], "path string")
    got = rows(output_manifest(results, files, "/v/o", "/v"), "job_id", "kind", "rel_path", "label", "status")
    assert got == sorted([
        (1, "dual", "d.pdf", "[双语] é", "ok"), (1, "mono", "o/m.pdf", "[中文] é", "ok"), (2, None, None, None, "outside_root"),
        (3, None, None, None, "no_output"), (4, "mono", "o/gone.pdf", "[中文] t", "missing_file")], key=repr)
    assert rows(output_manifest(results, files, "/v/o", "/v", "dual").where("job_id = 1"), "kind", "status") == [("dual", "ok")]
    write_manifest(results, str(tmp_path / "records"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "records")).collect()]
    assert {"input_pdf": "i", "mono_pdf": None, "dual_pdf": ""} in lines and len(lines) == 4
    assert result_records(results).where("job_id = 2").first().record == '{"input_pdf":"i","mono_pdf":"../../x","dual_pdf":null}'


def test_assemble_modes(spark, rows, tmp_path):
    frame = spark.createDataFrame([(1, 1, "b", None), (1, 0, "a", "A"), (1, 2, "", None), (2, 0, "x", "X")],
                                  "doc_id int, pos int, text string, result string")
    assert rows(assemble(frame, "mono"), "doc_id", "text", "n_translated") == [(1, "A\nb\n", 1), (2, "X", 1)]
    assert rows(assemble(frame, "dual"), "doc_id", "text") == [(1, "a\nA\nb\n"), (2, "x\nX")]
    write_outputs(assemble(frame, "both"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back.groupBy("kind").count()) == [("dual", 2), ("mono", 2)]
    with pytest.raises(ValueError):
        assemble(frame, "all")


def library(spark):
    attachments = spark.createDataFrame([
        (1, "i1", 1, 2, True, True, "best", "1.pdf", "p1"), (2, "i1", 1, 1, False, True, "first", "2.pdf", "p2"),
        (3, "i2", 1, 0, True, True, "gone", "3.pdf", "p3"), (4, "i2", 1, 2, False, True, "second", "4.pdf", "p4"),
        (5, "i2", 1, 1, False, False, "web page", "5.html", "p5"), (6, "i3", 1, 0, True, True, "[Translated] x", "6.pdf", "p6"),
        (7, "i3", 1, 1, False, True, "original", "7.pdf", "p7"), (8, None, 2, 0, False, True, "", "8.pdf", "p8"),
        (9, None, 3, 0, False, True, "", "", "p9"), (10, None, 4, 0, False, True, "read-only", "10.pdf", "p10"),
    ], "attachment_id bigint, item_id string, library_id int, child_pos int, is_best boolean, is_pdf boolean, title string, filename string, path string")
    files = spark.createDataFrame([(f"p{i}",) for i in range(1, 11) if i != 3], "path string")
    items = spark.createDataFrame([("i1", "Parent"), ("i2", ""), ("i3", "T")], "item_id string, title string")
    libraries = spark.createDataFrame([(1, True), (2, None), (4, False)], "library_id int, files_editable boolean")
    return attachments, items, libraries, files


def test_best_attachment_and_targets(spark, rows):
    attachments, items, libraries, files = library(spark)
    assert rows(best_attachment(attachments, files)) == [("i1", 1), ("i2", 4), ("i3", 6)]
    selection = spark.createDataFrame(
        [(0, "i1", None), (1, None, 1), (2, None, 2), (3, "i2", None), (4, "i3", None), (5, None, 8), (6, None, 9), (7, None, 10),
         (8, None, 3), (9, None, 5), (10, "i9", None), (11, None, 8)], "sel_pos int, item_id string, attachment_id bigint")
    got = collect_targets(selection, attachments, items, libraries, files)
    assert rows(got.orderBy("target_pos"), "target_pos", "attachment_id", "display_title") == sorted(
        [(0, 1, "Parent"), (2, 2, "Parent"), (3, 4, "second"), (5, 8, "8.pdf"), (6, 9, "PDF")], key=repr)


def test_run_reports(spark, rows):
    targets = spark.createDataFrame([(1, p, p, f"t{p}") for p in range(9)] + [(2, 100, 100, "u")],
                                    "run_id int, target_pos int, attachment_id int, display_title string")
    outcomes = spark.createDataFrame([(p, None, "bad") for p in range(1, 8)] + [(0, 2, None)],
                                     "attachment_id int, n_created int, error string")
    assert rows(run_summary(targets, outcomes)) == [(1, 9, 2, 7, 89), (2, 1, 0, 0, 0)]
    assert rows(first_failures(targets, outcomes)) == [(1, n, f"t{n}: bad") for n in range(1, 6)]


def test_failure_texts(spark, rows):
    logs = spark.createDataFrame([(1, "out", "  err \n"), (2, " out ", ""), (3, None, None), (4, "x" * 5000, None)],
                                 "job_id int, stdout string, stderr string")
    report = {r.job_id: r for r in failure_report(logs).collect()}
    assert [report[i].detail for i in (1, 2, 3)] == ["err", "out", ""] and len(report[4].detail) == 2000
    assert report[1].stdout_note == 'stdout (3 bytes): "out"' and report[3].stderr_note == "stderr (0 bytes): <empty>"
    assert report[4].stdout_note == 'stdout (5000 bytes): "…' + "x" * 1200 + '"'
    assert len(logs.select(error_text(F.col("stderr"), F.col("stdout"), 2500).alias("d")).where("length(d) = 2500").collect()) == 1
    assert failure_counts(failure_report(logs)).count() == 4


def test_files(spark, rows, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt", "d.pdf.bak"):
        (tmp_path / name).write_text(" \n" if name == "c.txt" else f"text {name}")
    found = read_inputs(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.pdf", "b.PDF"]
    assert found.columns == ["path", "length", "modificationTime"]
    assert read_text(spark, str(tmp_path)).count() == 3
    files = spark.createDataFrame([("x/a.pdf",), ("x/b.txt",), ("x/a.pdf",)], "path string")
    asked = spark.createDataFrame([("x/a.pdf",), ("x/b.txt",), ("x/c.pdf",)], "path string")
    assert rows(gate_inputs(asked, files), "path", "reason") == [("x/a.pdf", None), ("x/b.txt", "not_pdf"), ("x/c.pdf", "missing")]
