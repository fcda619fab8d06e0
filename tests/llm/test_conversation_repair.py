import hashlib
import random
from collections import defaultdict

import pytest

from glosswork.llm import conversation_repair as repair

NEXT = {("-", "s"): "s", ("-", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def closed(ways):
    for _ in range(4):
        for state, (cost, audit) in list(ways.items()):
            for said in "ua":
                if (state, said) in NEXT:
                    then, way = NEXT[state, said], (cost + 2, audit + "I")
                    ways[then] = min(ways.get(then, way), way)
    return ways


def cheapest(letters):
    """All edits, state by state."""
    ways = closed({"-": (0, "")})
    for letter in letters:
        must, cut, initial, after = letter in "0123", letter in "SUAX", letter.lower(), {}
        for state, (cost, audit) in ways.items():
            steps = [(state, cost + 3, "D")]
            if not must:
                steps += [(NEXT[state, initial], cost + cut, "K")] if (state, initial) in NEXT else []
                steps += [(NEXT[state, s], cost + 2 + cut, "R") for s in "ua" if (state, s) in NEXT]
            for then, price, edit in steps:
                after[then] = min(after.get(then, (price, audit + edit)), (price, audit + edit))
        ways = closed(after)
    return min(ways[s] for s in "-a" if s in ways)


def test_search_finds_the_cheapest_edits_and_the_least_audit():
    rnd = random.Random(1)
    for _ in range(5000):
        letters = "".join(rnd.choice("suaxuauaSUAX0123") for _ in range(rnd.randrange(14)))
        assert repair.search(letters) == cheapest(letters), letters


@pytest.mark.parametrize("alphabet", ["ua", "suax", "suaxSUAX0123", "u", "s", "0"])
def test_long_conversations_are_solved_too(alphabet):
    rnd = random.Random(2)
    letters = "".join(rnd.choice(alphabet) for _ in range(400))
    assert repair.search(letters) == cheapest(letters)


def brute(rows):
    conversations = defaultdict(list)
    for conv_id, turn, role, text in rows:
        conversations[conv_id].append((turn is not None, turn or 0, role if role is not None else " ",
                                       text if text is not None else " "))
    out = []
    for conv_id, said in conversations.items():
        said.sort(key=lambda r: (*r[:3], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, letters, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in said:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kind = "suax"["sua".find(role[:1]) if role[:1] else 3]
            letters += {"truncated": kind.upper(), None: kind}.get(fault, str("suax".index(kind)))
        cost, audit = cheapest(letters)
        turns = {r[1] for r in said if r[0]}
        initials = [r[2][:1] for r in said]
        rest, lines, odd = iter(said), [], (len(audit) - audit.count("D")) % 2
        for edit in audit:
            row = None if edit == "I" else next(rest)
            if edit != "D":
                role = row[2] if edit == "K" else ("user", "assistant")[(len(lines) - odd) % 2]
                lines.append(f"{role}:{'' if edit == 'I' else row[3]}")
        out.append((
            str(conv_id), max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out)


def conversations(seed, n, longest):
    rnd = random.Random(seed)
    texts = ["Fine.", "What? ", "cut", "", " \t", None, "ü!\n", "Yes.", "a" * 50_000 + "."] + [f"Text {i}." for i in range(20)]
    roles = ["user", "assistant"] * 6 + ["system", "system", None, "tool", ""]
    rows = [(c, t if rnd.random() < 0.9 else None, rnd.choice(roles), rnd.choice(texts))
            for c in range(n) for t in rnd.sample(range(2 * longest), rnd.randrange(1, longest))]
    return rows + [(None, 1, "user", "Hi."), (None, None, None, None)] + rows[:3] + rows[:1]


def table(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return turns.selectExpr("*", *[f"'c' AS `{c}`" for c in "place of block letter fault audit cost at edit n first lot copy".split()])


def results(frame):
    return sorted((str(r.conv_id), r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
                  for r in frame.collect())


@pytest.mark.parametrize("block, fan", [(repair.BLOCK, repair.FAN), (3, 2)])
def test_matches_brute_force_in_one_block_and_in_many(spark, monkeypatch, block, fan):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "FAN", fan)
    rows = conversations(4, 25, 30)
    assert results(repair.report(table(spark, rows))) == brute(rows)
    numbered = repair.rows_of(table(spark, rows))
    solved = repair.solve(repair.faults(numbered))
    said = defaultdict(list)
    for r in repair.repaired(numbered, solved).collect():
        said[str(r.conv_id)].append((r["at"], f"{r.role}:{r.text}", r.edit, r.turn))
    for conv_id, *_, audit, sha in brute(rows):
        lines = sorted(said[conv_id], key=lambda r: r[0])
        assert [r[0] for r in lines] == list(range(len(lines)))
        assert hashlib.sha256("\n".join(r[1] for r in lines).encode()).hexdigest() == sha
        assert "".join({"keep": "K", "rerole": "R", "insert": "I"}[r[2]] for r in lines) == audit.replace("D", "")


def test_conversations_without_rows_and_empty_tables(spark):
    turns = table(spark, [(1, 1, "user", "Hi."), (2, 1, "user", "Hi."), (2, 2, "assistant", "Yes.")])
    got = results(repair.report(turns.where("conv_id = 2"), every=turns))
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[0] == ("1", 0, 0, 0, 0, 0, 0, "", nothing)
    assert got[1][:8] == ("2", 0, 0, 0, 0, 0, 0, "KK")
    assert repair.report(turns.where("false")).count() == 0
    assert repair.damaged(turns.where("false")).count() == 0
