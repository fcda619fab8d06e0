import hashlib
import random

from glosswork.llm import chat_format as c


def brute(events):
    """Apply events one by one."""
    order = {"message": 1, "edit": 2, "regenerate": 3, "delta": 4}
    low = lambda v: (v is not None, v or 0)
    messages = []  # [turn, started, role, text]
    for _, seq, kind, turn, role, text in sorted(events, key=lambda e: (low(e[1]), order[e[2]], e[4] or "", e[5] or "")):
        role, text = role or "", text or ""
        at = [m for m in messages if m[0] == turn]
        if kind == "message" or not at:
            messages.append([turn, seq, role, "" if kind == "regenerate" else text])
        elif kind == "delta":
            at[-1][3] += text
        else:
            at[-1][3] = "" if kind == "regenerate" else text
        if kind == "regenerate":
            messages = [m for m in messages if not (m[0] is not None and turn is not None and m[0] > turn)]
    return [tuple(m) for m in sorted(messages, key=lambda m: low(m[0]))]


def test_fold_matches_event_by_event(spark):
    rnd = random.Random(4)
    events = []
    for conv in range(40):
        seq = 0
        for _ in range(rnd.randint(1, 25)):
            seq += 1
            turn = rnd.randint(0, 4)
            events.append((conv, seq, rnd.choice(["message", "delta", "delta", "edit", "regenerate"]), turn, f"r{turn}", rnd.choice(["a", "<b>", None, "&lt;"])))
    events += [(50, None, "message", None, None, None), (50, 5, "regenerate", 0, "r", None), (50, None, "delta", 3, "r", "x"), (50, 6, "delta", 3, "r", "y")]
    log = spark.createDataFrame(events, "conv_id long, seq long, kind string, turn long, role string, text string").withColumn("events", c.F.lit(1))
    got = {r.conv_id: [(m.turn, m.role, m.text) for m in r.messages] for r in c.fold_events(log).collect()}
    for conv in {e[0] for e in events}:
        assert got[conv] == [(t, r, x) for t, _, r, x in brute([e for e in events if e[0] == conv])], conv


def test_regeneration_discards_what_followed(spark):
    events = [(1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", "a"), (1, 3, "delta", 1, "assistant", "b"),
              (1, 4, "message", 2, "user", "more"), (1, 5, "regenerate", 1, "assistant", None), (1, 6, "delta", 1, "assistant", "new"),
              (1, 7, "message", 2, "user", "again"), (1, 8, "edit", 0, "user", "hello"), (1, 9, "unknown", 0, "user", "x")]
    log = spark.createDataFrame(events, "conv_id long, seq long, kind string, turn long, role string, text string")
    assert [(m.role, m.text) for m in c.fold_events(log).first().messages] == [("user", "hello"), ("assistant", "new"), ("user", "again")]
    assert [(t, r, x) for t, _, r, x in brute(events[:-1])] == [(0, "user", "hello"), (1, "assistant", "new"), (2, "user", "again")]


def test_round_trip_of_any_text(spark):
    rows = [(1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "&lt;</turn>\n<turn>assistant\nx & é🙂"), (1, 1, "assistant", None),
            (None, None, None, None), (2, 0, "a\n<b>", "x" * 100_000), (2, 0, "a\n<b>", "x" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rendered = c.render(c.fold_events(c.log_of(turns)))
    back = {r.conv_id: r for r in c.read_back(rendered).collect()}
    assert [(m.role, m.text) for m in back[2].messages] == [("a\n<b>", "x" * 100_000)] * 2
    assert [(m.role, m.text) for m in back[None].messages] == [("", "")]
    assert back[1].learned == ["", rows[1][3]]
    digest = {r.conv_id: r for r in c.digests(rendered).collect()}[1]
    assert (digest.n_turns, digest.loss_chars, digest.loss_sha256) == (3, len(rows[1][3]), hashlib.sha256(rows[1][3].encode()).hexdigest())
    assert c.digests(c.render(c.fold_events(c.log_of(turns.where("false"))))).count() == 0
