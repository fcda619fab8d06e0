import json

import pytest
from pyspark.sql import functions as F

from glosswork.functions import json_values as jv
from glosswork.functions import paths
from glosswork.functions.text import JS_SPACE, PY_SPACE, json_quote, js_strip, py_strip

JSON_TEXTS = [
    "{}", '{"a":1}', ' {"a":1}\n', "[1,2]", '"x"', "null", "12", "1 2", '{"a":1} done', "1,2", "1],[2", '{"a":1}}',
    "", " ", "nope", "{'a':1}", '{"a":01}', '{"a":1', '{"a":"b\nc"}', "[", "]", '{"a":{"b":[1,{"c":null}]}}', "[],[]",
]


def valid(text):
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def test_strict_json_accepts_what_a_json_parser_accepts(spark):
    frame = spark.createDataFrame([(t,) for t in JSON_TEXTS], "t string")
    got = {r.t: r.ok for r in frame.select("t", jv.strict_json(F.col("t")).isNotNull().alias("ok")).collect()}
    assert got == {t: valid(t) for t in JSON_TEXTS}


def test_repeated_key_keeps_last_value(spark):
    frame = spark.createDataFrame([('{"a":"x","a":"y"}',)], "t string")
    assert frame.select(jv.string_only(jv.child(jv.strict_json(F.col("t")), "$.a"))).first()[0] == "y"


def test_strip_matches_python(spark):
    every = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["﻿", "​"]
    texts = [f"{c} a{c}b {c}" for c in every]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(py_strip(F.col("t"))).collect()]
    assert got == [t.strip() for t in texts]
    assert set(PY_SPACE) == {c for c in every if c.isspace()}
    assert "﻿" in JS_SPACE and "\x85" not in JS_SPACE
    assert spark.range(1).select(js_strip(F.lit("﻿ x  "))).first()[0] == "x"


def test_json_quote(spark):
    texts = ['a"b', "é\n\t\\", "", "{v1}"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(json_quote(F.col("t"))).collect()]
    assert [json.loads(g) for g in got] == texts


@pytest.mark.parametrize(
    "path, inside",
    [
        ("a.pdf", "out/a.pdf"), ("./x/../a.pdf", "out/a.pdf"), ("/v/out/a.pdf", "out/a.pdf"), ("../a.pdf", "a.pdf"),
        ("../../a.pdf", None), ("/vault/a.pdf", None), ("/v", ""), ("/v/../w/a", None), ("../../../../v/b", "b"),
    ],
)
def test_paths(spark, path, inside):
    full = paths.resolve(F.lit(path), F.lit("/v/out"))
    assert spark.range(1).select(paths.relative_inside(full, F.lit("/v"))).first()[0] == inside


def test_pdf_suffix(spark):
    names = {"a.pdf": True, "a.PDF": True, "x/.pdf": False, ".pdf": False, "a.pdf.bak": False, "a": False, "a.b.Pdf": True}
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.ok for r in frame.select("n", paths.has_pdf_suffix(F.col("n")).alias("ok")).collect()} == names


def test_suffix_is_at_the_very_end(spark):
    rows = spark.createDataFrame([("/a/x.pdf",), ("/a/x.pdf\n",), ("/a/x.PDF",), ("/a/.pdf",)], "path string")
    from glosswork.functions.paths import has_pdf_suffix
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(has_pdf_suffix(F.col("path"))).collect()] == [True, False, True, False]


def test_folders_and_inputs_are_confined(spark):
    from glosswork.functions.paths import confined_folder
    from glosswork.sources.files import gate_inputs
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("out",), (" ",), ("/etc",), ("a/../../x",), ("a/../b",), (None,)], "f string")
    got = [r[0] for r in rows.select(confined_folder(F.col("f"), F.lit("/vault"), "Default")).collect()]
    assert got == ["/vault/out", "/vault/Default", None, None, "/vault/b", "/vault/Default"]
    paths = spark.createDataFrame([("/vault/a.pdf",), ("/other/a.pdf",), ("/vault/../x.pdf",)], "path string")
    reasons = {r.path: r.reason for r in gate_inputs(paths, paths, "/vault").collect()}
    assert reasons == {"/vault/a.pdf": None, "/other/a.pdf": "outside_root", "/vault/../x.pdf": "outside_root"}


def test_reporters_pick_and_trim_in_their_own_order(spark):
    from glosswork.operators.reports import failure_report

    logs = spark.createDataFrame([(1, "out", "\ufeff  "), (2, "", None), (3, "x" * 4000, ""), (4, " ", None)], "job_id long, stdout string, stderr string")
    got = {r.job_id: (r.library_detail, r.notes_detail) for r in failure_report(logs).collect()}
    assert got == {1: ("exit code unknown", ""), 2: ("exit code unknown", "exit code unknown"),
                   3: ("x" * 2500, "x" * 3000), 4: ("exit code unknown", "")}
