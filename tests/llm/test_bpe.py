import hashlib
import random

import numpy as np
import pytest

from glosswork.llm import bpe
from tests.llm.fixtures import awkward, frame

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def test_tree_is_exact_for_any_leaf_size(reference):
    rnd = random.Random(1)
    atoms = ["a", "aa", "the", "ing", " ", "  ", "\n", "'s", "'", "0", "12", "!", "...", "é", "ß", "漢", "🙂", "<|endoftext|>", "\t", "=", " ", "　"]
    for _ in range(800):
        chosen = rnd.sample(atoms, rnd.randint(1, 6))
        text = "".join(rnd.choice(chosen) for _ in range(rnd.randint(0, 300)))
        want = reference.encode(text, add_special_tokens=False).ids
        for leaf in (3, 17, 40):
            assert bpe.encode_tree(bpe.public_vocabulary(), text, leaf) == want, (text, leaf)


def test_every_code_point_splits_as_in_the_other_library(reference):
    enc = bpe.encoding(bpe.public_vocabulary())
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}1 {chr(c)}b \n{chr(c)} {chr(c)}!{chr(c)}'" for c in points[at: at + 20_000]]
        assert [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)] == enc.encode_ordinary_batch(texts, num_threads=2)


def test_round_trip_of_awkward_rows(spark, reference):
    rows = awkward()
    got = bpe.round_trip(frame(spark, rows), bpe.public_vocabulary()).collect()
    want = []
    for doc_id, text in rows:
        ids = reference.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(frame(spark, rows).where("false"), bpe.public_vocabulary()).count() == 0


def test_long_texts_and_repeats_go_through_leaves(spark, reference):
    rows = [(1, "ab" * 400), (1, "ab" * 400), (2, "one two " * 90), (None, "ab" * 400), (3, "short")]
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in bpe.encode(frame(spark, rows), bpe.public_vocabulary(), leaf=50).collect()), key=repr)
    assert got == sorted(((d, reference.encode(t, add_special_tokens=False).ids) for d, t in rows), key=repr)


def test_decode_keeps_other_columns(spark):
    rows = spark.createDataFrame([(1, "x", bytearray(np.array([64, 50256], "<u4").tobytes())), (2, "y", None)], "doc_id long, decoded string, ids binary")
    assert [tuple(r) for r in bpe.decode(rows, bpe.public_vocabulary()).orderBy("doc_id").collect()] == [(1, "a<|endoftext|>"), (2, "")]
