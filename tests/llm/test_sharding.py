import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from glosswork.llm import sharding
from tests.llm.fixtures import CLASHING, awkward, frame


def rows_of(n_hot=200):
    rows = [(i, t, "s%d" % (k % 3)) for k, (i, t) in enumerate(awkward())]
    rows += [(1000 + i, f"text {i}", "hot") for i in range(n_hot)]
    return rows + [(2000 + i, "é", None) for i in range(30)] + [(5, "twice", "s0"), (5, "twice", "s0")]


def brute(rows, shards, seed):
    strata = defaultdict(list)
    for i, text, source in rows:
        raw = (text or "").encode()
        shuffled = hashlib.md5(f"{seed}:{'-' if i is None else i}".encode()).hexdigest()
        strata[source].append((shuffled, i is not None, i or 0, zlib.crc32(raw), len(raw) + 8))
    mixed = sorted(((k + 0.5) / len(rs), s is not None, s or "", r) for s, rs in strata.items() for k, r in enumerate(sorted(rs)))
    out, used = [], Counter()
    for place, (_, _, _, (_, there, i, crc, size)) in enumerate(mixed):
        shard = place * shards // len(mixed)
        out.append((str(i if there else None), size, crc, shard, used[shard]))
        used[shard] += 1
    return sorted(out)


def table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.selectExpr("*", *[f"'c' AS `{c}`" for c in [*CLASHING, "shard", "slot", "place", "of", "stratum", "fraction"]])


@pytest.mark.parametrize("shards", [1, 24, 1000])
def test_matches_brute_force(spark, shards):
    rows = rows_of()
    got = sharding.interleave(table(spark, rows), shards, "seed").collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in got) == brute(rows, shards, "seed")


def test_shards_are_equal_and_match_the_mixture(spark):
    rows = [(i, "x" * (i % 50), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(3000)]
    got = sharding.interleave(table(spark, rows), 8, "a", keep=["source"]).collect()
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for source, whole in Counter(r[2] for r in rows).items():
        for shard in range(8):
            here = sum(r.shard == shard and r.kept.source == source for r in got)
            assert abs(here - whole / 8) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in range(8))
    other = sharding.interleave(table(spark, rows), 8, "b").collect()
    assert {(r.doc_id, r.shard) for r in other} != {(r.doc_id, r.shard) for r in got}


def test_written_shards_hold_whole_rows_in_order(spark, tmp_path):
    rows = rows_of(40)
    path = str(tmp_path / "shards")
    docs = table(spark, rows)
    sharding.write_shards(docs, 5, "seed", path)
    back = spark.read.parquet(path)
    assert sorted(back.columns) == sorted(docs.columns)
    assert sorted(map(repr, back.select("doc_id", "text", "source").collect())) == sorted(map(repr, docs.select("doc_id", "text", "source").collect()))
    assert back.select("shard").distinct().count() == 5


def test_empty_table(spark):
    assert sharding.interleave(table(spark, rows_of()).where("false"), 4, "seed").count() == 0
    assert sharding.interleave(frame(spark, [(1, None)]).selectExpr("doc_id", "text", "'s' AS source"), 4, "s").first().size == 8
