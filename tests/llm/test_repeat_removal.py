import random

from glosswork.llm import repeat_removal as r
from tests.llm.fixtures import awkward, frame, prose


def brute(rows, least):
    first, out = {}, []
    texts = {}
    for doc_id, text in rows:
        texts[doc_id] = text or ""
    for doc_id in sorted(texts, key=lambda d: (d is None, d)):
        run = []
        for k, (start, end, words, digest) in [*enumerate(r.units(texts[doc_id])), (None, (0, 0, 0, None))]:
            repeat = digest in first and first[digest] != (doc_id, k)
            if digest is not None:
                first.setdefault(digest, (doc_id, k))
            if repeat:
                run.append((start, end, words, first[digest][0]))
                continue
            if run and sum(x[2] for x in run) >= least:
                out.append((doc_id, run[0][0], run[-1][1], sum(x[2] for x in run), sorted({x[3] for x in run if x[3] is not None})))
            run = []
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    rnd = random.Random(2)
    passage = ". ".join(prose(rnd, 9) for _ in range(6)) + "."
    line = prose(rnd, 8) + "."
    rows = [(i, prose(rnd, 30) + f".\n{line}\n" + (prose(rnd, 5) + " " + passage + " " if i % 3 else "") + prose(rnd, 10)) for i in range(60)]
    rows += [(100 + d, t) for d, t in awkward() if d not in (None, 6)] + [(106, "a b c.")]
    got = sorted(((x.doc_id, x.start, x.end, x.words, x.kept_in) for x in r.find_repeats(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rows, r.LEAST_WORDS) and len(got) > 35
    cut = {x.doc_id: x.text for x in r.remove_repeats(frame(spark, rows)).collect()}
    middle = passage.split(". ")[2]
    assert sum(middle in (t or "") for t in cut.values()) == 1
    assert sum(line in (t or "") for d, t in cut.items() if d < 60 and d % 3 == 0) > 10  # short lines stay
    texts = dict(rows)
    for doc_id, start, end, *_ in got:
        assert texts[doc_id][start:end] not in cut[doc_id]
    assert cut[101] is None


def test_ids_that_are_null_or_repeated(spark):
    text = prose(random.Random(1), 40) + "."
    rows = [(1, text), (1, text), (None, text), (None, "")]
    got = r.find_repeats(frame(spark, rows)).collect()
    assert [(x.doc_id, x.start, x.end, x.kept_in) for x in got] == [(None, 0, len(text), [1])]
    assert r.remove_repeats(frame(spark, rows)).count() == 4
    assert r.find_repeats(frame(spark, rows).where("false")).count() == 0


def test_texts_that_share_an_id_are_cut_on_their_own(spark):
    rnd = random.Random(3)
    text, *others = (prose(rnd, 40) + "." for _ in range(5))
    rows = [(1, text), (None, text), (None, others[0]), (7, others[1]), (7, text), (8, others[2]), (8, others[3])]
    got = r.find_repeats(frame(spark, rows)).collect()
    assert sorted(((x.doc_id, x.start, x.end, x.kept_in) for x in got), key=repr) == [(7, 0, len(text), [1]), (None, 0, len(text), [1])]
    left = sorted(((x.doc_id, x.text) for x in r.remove_repeats(frame(spark, rows)).collect()), key=repr)
    assert left == sorted(((d, "" if t == text and d != 1 else t) for d, t in rows), key=repr)
    # A repeat between texts without an id.
    rows = [(None, others[0] + "\n" + text), (None, text + "\n" + others[1])]
    assert len(r.find_repeats(frame(spark, rows)).collect()) == 1


def test_short_whole_lines(spark):
    rnd = random.Random(4)
    line, unique = "All rights reserved. See LICENSE.", [prose(rnd, 12) for _ in range(6)]
    rows = [(1, f"{unique[0]}. {line} {unique[1]}"),  # inside a line: neither kept as one nor removed
            (2, f"{unique[2]}\n{line}\n{line.upper()}"), (3, f"{line}\n{unique[3]}"), (4, f"{unique[4]}\n{line} {unique[5]}"), (5, line)]
    got = sorted((x.doc_id, dict(rows)[x.doc_id][x.start: x.end].strip().lower(), x.words, x.kept_in)
                 for x in r.find_repeats(frame(spark, rows), whole_lines=True).collect())
    assert got == [(d, line.lower(), 5, [2]) for d in (2, 3, 5)]
    left = {x.doc_id: x.text for x in r.remove_repeats(frame(spark, rows), whole_lines=True).collect()}
    assert left == dict(rows) | {2: f"{unique[2]}\n{line}\n", 3: f"\n{unique[3]}", 5: ""}
