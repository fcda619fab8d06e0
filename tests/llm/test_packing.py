import random
from collections import defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from glosswork.llm import bpe, packing
from tests.llm.fixtures import awkward, frame


@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_decreasing_matches_a_plain_search(sizes):
    rooms: list[int] = []
    order: list[int] = []  # when a row reached its room
    for clock, size in enumerate(sorted(sizes, reverse=True)):
        fits = [(room, order[k], k) for k, room in enumerate(rooms) if room >= size]
        if fits:
            k = min(fits)[2]
            rooms[k] -= size
            order[k] = clock
        else:
            rooms.append(30 - size)
            order.append(clock)
    got = packing.best_fit_decreasing(sizes, 30)
    assert [30 - sum(sizes[p] for p in row) for row in got] == rooms
    assert sorted(p for row in got for p in row) == list(range(len(sizes)))


def test_room_tree_finds_the_tightest_room():
    rnd = random.Random(3)
    tree, rooms = packing.RoomTree(20), []
    for _ in range(300):
        if rooms and rnd.random() < 0.4:
            room = rooms.pop(rnd.randrange(len(rooms)))
            tree.add(room, -1)
        else:
            rooms.append(rnd.randint(0, 20))
            tree.add(rooms[-1])
        least = rnd.randint(0, 20)
        assert tree.smallest(least) == min((r for r in rooms if r >= least), default=None)


def test_rows_hold_every_token_once(spark, tmp_path):
    vocabulary, rows = bpe.public_vocabulary(), awkward()
    packed = packing.pack_documents(frame(spark, rows), vocabulary, row_tokens=64, block_tokens=5_000)
    back = defaultdict(list)
    for r in packed.collect():
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == len(ids) == r.n_tokens <= 64
        for doc, piece, start, a, b in zip(r.doc_ids, r.pieces, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert positions[a:b].tolist() == list(range(b - a)) and start == 64 * piece
            back[doc].append((start, ids[a:b].tolist()))
    for doc in {d for d, _ in rows}:
        texts = [t for d, t in rows if d == doc]
        want = sorted(x for t in texts for x in bpe.encode_tree(vocabulary, t or ""))
        assert sorted(x for _, part in back[doc] for x in part) == want
    whole = [x for _, part in sorted(back[10]) for x in part]
    assert whole == bpe.encode_tree(vocabulary, dict(rows)[10])
    packing.write_matrices(packed, str(tmp_path / "out"), 64)
    assert {len(r.ids) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {256}
    assert packing.pack_documents(frame(spark, rows).where("false"), vocabulary).count() == 0
