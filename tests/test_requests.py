import json

import pytest

from glosswork.sources.requests import route_model, triage_requests

GOOD = '{"role":"user","content":"é {v1}","name":"n"}'
CASES = {
    "": "size", "x" * 5: "json", "[1]": "object", "{}": "messages", '{"messages":null}': "messages",
    '{"messages":{}}': "messages", '{"messages":[]}': "messages", '{"messages":[{},1]}': "element",
    f'{{"messages":[{GOOD}]}}': None, f'{{"messages":[{GOOD}]}} x': "json", '{"messages":[{}]}': None,
}


def test_reject_classes(spark):
    frame = spark.createDataFrame([(i, b) for i, b in enumerate(CASES)], "req_id int, body string")
    got = {r.body: r.reject for r in triage_requests(frame).collect()}
    assert got == CASES


def test_size_limit_counts_bytes(spark):
    body = '{"messages":[{"content":"' + "é" * 40 + '"}]}'
    frame = spark.createDataFrame([(1, body)], "req_id int, body string")
    n = len(body.encode())
    assert triage_requests(frame, n).first().reject is None
    assert triage_requests(frame, n - 1).first().reject == "size"
    big = spark.createDataFrame([(1, '{"messages":[{"content":"' + "x" * 4 * 1024 * 1024 + '"}]}')], "req_id int, body string")
    assert triage_requests(big).first().reject == "size"


def test_messages_stay_as_sent(spark):
    frame = spark.createDataFrame([(1, f'{{"messages":[{GOOD}]}}')], "req_id int, body string")
    assert json.loads(triage_requests(frame).first().messages) == [json.loads(GOOD)]
    assert triage_requests(frame).first().messages == f"[{GOOD}]"


def test_model_of_request(spark):
    models = {"null": "codex-cli", '""': "codex-cli", "0": "codex-cli", '" m "': " m ", "7": "7", "true": "True", "[]": "codex-cli"}
    frame = spark.createDataFrame([(m, f'{{"model":{m},"messages":[{{}}]}}') for m in models], "req_id string, body string")
    assert {r.req_id: r.requested_model for r in triage_requests(frame).collect()} == models


def test_routing(spark):
    wanted = {"": None, "codex": None, " default ": None, "codex-cli": None, "Codex": "Codex", " m-1 ": "m-1"}
    frame = spark.createDataFrame([(m,) for m in wanted], "requested_model string")
    assert {r.requested_model: r.effective_model for r in route_model(frame).collect()} == wanted
    assert {r.effective_model for r in route_model(frame, " forced").collect()} == {" forced"}
    assert {r.requested_model: r.effective_model for r in route_model(frame, "").collect()} == wanted


@pytest.mark.parametrize("body", [
    '{"messages":[7],"messages":[{"role":"user","content":"x"}]}',
    '{"messages":[{"role":"user"}],"messages":[7]}',
    '{"model":"a","messages":[{"role":"user","role":"system","n":1.50}],"model":"b"}',
    '{"model":3.0,"messages":[{"z":1,"a":[2,{"k":1,"k":2}]}]}',
    '{"model":1.50,"messages":[{}]}', '{"model":3,"messages":[{}]}', '{"model":0.0,"messages":[{}]}',
])
def test_what_was_checked_is_what_is_passed_on(spark, body):
    """As a parser that keeps the last of repeated keys."""
    got = triage_requests(spark.createDataFrame([(1, body)], "req_id long, body string")).first()
    want = json.loads(body)
    good = all(isinstance(m, dict) for m in want["messages"])
    assert (got.reject is None) == good
    if good:
        assert json.loads(got.messages) == want["messages"]
        assert got.requested_model == (str(want["model"]) if want.get("model") else "codex-cli")
