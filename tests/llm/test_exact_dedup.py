import re
from collections import defaultdict

import pytest

from glosswork.llm import exact_dedup
from tests.llm.fixtures import awkward, frame


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0))
    return {norm: (min(g)[2] if not min(g)[1] else None, len(g)) for norm, g in groups.items()}


@pytest.mark.parametrize("hot_share", [exact_dedup.HOT_SHARE, 0, 4])
def test_matches_brute_force_with_and_without_hot_texts(spark, monkeypatch, hot_share):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", hot_share)
    rows = awkward() + [(100 + i, "same  text" + " " * (i % 3)) for i in range(40)]
    want = brute(rows)
    got = exact_dedup.mark_copies(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for doc_id, text in rows:
        texts[doc_id].append(want[re.sub(r"[\x20\x09-\x0D]", "", text or "")])
    assert all((r.keep_id, r.group_size) in texts[r.doc_id] for r in got)
    assert sum(r.kept for r in got) == len(want)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_keeps_whole_rows_and_bears_empty_tables(spark):
    docs = frame(spark, awkward())
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(brute(awkward()))
    assert {r.kept for r in kept.where("doc_id = 6").collect()} == {"c6"}
    assert exact_dedup.mark_copies(docs.where("false")).count() == 0
