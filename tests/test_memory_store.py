"""A memory that grows in place."""

import glob
import os

import pytest

from glosswork import RunOptions
from glosswork import __main__ as job
from glosswork.operators.inference import OfflineTranslator
from glosswork.plans.corpus import translate_corpus
from glosswork.sources.memory import KEY, MemoryStore, lookup_keys, memory_upsert

KEYED = "key_hash string, lang_in string, lang_out string, effective_model string, text string, version int"


def replies(spark, ids, version, text="v{v} {i}"):
    return spark.createDataFrame(
        [(f"k{i}", "en", "zh", None if i % 3 else "m", text.format(v=version, i=i), version) for i in ids], KEYED)


def files(store):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{store.root}/parts/**/*.parquet", recursive=True)}


def written_rows(spark, store, part):
    return spark.read.parquet(f"{store.root}/parts/part={part}").count()


def test_grows_like_an_upsert_and_writes_only_what_is_new(spark, rows, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "memory"), buckets=16, most_parts=3)
    assert store.table().count() == 0
    store.add(replies(spark, range(1000), 1))
    before = files(store)
    part = store.add(replies(spark, [5, 5, 77, 500, 2000], 2))  # a hundredth of the keys
    assert written_rows(spark, store, part) == 4
    assert {f: t for f, t in files(store).items() if f in before} == before
    store.add(replies(spark, [5, 77], 1, "older {i}"))
    store.add(replies(spark, [9], 3, ""))  # blank: a failure
    want = memory_upsert(replies(spark, range(1000), 1), replies(spark, [5, 77, 500, 2000], 2))
    assert rows(store.table(), *KEY, "text", "version") == rows(want, *KEY, "text", "version")
    asked = replies(spark, [5, 9, 500, 4000], 0).select(*KEY)
    assert rows(store.lookup(asked)) == rows(lookup_keys(asked, want).select(*KEY, "memory_text"))


def test_merge_rewrites_only_buckets_with_many_parts(spark, rows, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "memory"), buckets=16, most_parts=2)
    store.add(replies(spark, range(300), 1))
    for version in (2, 3, 4):
        store.add(replies(spark, [7], version))
    before, want = files(store), rows(store.table())
    merged = store.merge()
    assert len(merged) == 1 and store.merge() == []
    assert rows(store.table()) == want and set(before) <= set(files(store))
    added = set(files(store)) - set(before)
    assert len(added) == 1 and f"bucket={merged[0]}/" in added.pop()


def test_an_addition_that_stops_leaves_the_store_as_it_was(spark, rows, tmp_path, monkeypatch):
    store = MemoryStore(spark, str(tmp_path / "memory"), buckets=4)
    store.add(replies(spark, range(20), 1))
    want = rows(store.table())
    with monkeypatch.context() as m:
        m.setattr(spark.__class__, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
        fresh = memory_upsert(store.table().where("false"), store.table().selectExpr(*KEY, "'x' AS text", "9 AS version"))
        newest, pairs = store._listed()
        with pytest.raises(RuntimeError):
            store._write(fresh, newest + 1, pairs)
    again = MemoryStore(spark, store.root, buckets=4)
    assert rows(again.table()) == want
    again.add(replies(spark, [1], 2))
    assert again.table().where("version = 2").count() == 1 and again.table().count() == 20


def test_runs_share_a_store(spark, tmp_path):
    docs = spark.createDataFrame([(d, f"A line of text {d}\nThe same line", "en", "s", 0) for d in range(6)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    store = MemoryStore(spark, str(tmp_path / "memory"), buckets=4)
    first = translate_corpus(spark, docs, OfflineTranslator(), RunOptions(), memory=store)
    assert first.audited.count() == 2
    store.add(first.fresh)
    again = translate_corpus(spark, docs, OfflineTranslator(broken_models=[None]), RunOptions(), memory=store, memory_version=2)
    assert again.audited.count() == 0 and again.fresh.count() == 0
    assert again.segments.where("translate AND result IS NULL").count() == 0
    docs.write.parquet(str(tmp_path / "in"))
    for out in ("a", "b"):
        done = job.run(spark, job.parse([str(tmp_path / "in"), str(tmp_path / out), "--memory-store", str(tmp_path / "job-memory")]))
        assert done.audited.count() == (2 if out == "a" else 0)
