"""Token-id output: documents packed into rows of a fixed length.

Best-fit-decreasing: pieces are placed from the longest to the shortest, each into the
row with the least room that still takes it. A segment tree over the room left finds
that row in logarithmic time. Overlong documents are split into full rows and a rest,
and nothing is lost. Each task packs blocks of what it reads, so ids are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.bpe import Vocabulary, encode_tree
from glosswork.llm.common import text_of

ROW_TOKENS = 2048
# Tokens that a task packs together; bounds its memory.
BLOCK_TOKENS = 4_000_000
SCHEMA = ("pack_id string, n_tokens int, doc_ids array<{id}>, pieces array<int>, starts array<bigint>, "
          "cu_seqlens array<int>, ids binary, position_ids binary")


class RoomTree:
    """A segment tree over the rooms 0 .. capacity: how many open rows have each room."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, room: int, by: int = 1) -> None:
        node = room + self.width
        while node:
            self.count[node] += by
            node >>= 1

    def smallest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that a row has."""
        node = least + self.width
        if self.count[node]:
            return least
        # Up until a right neighbour has rows, then down to its leftmost.
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.width:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.width


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers. Ties go to the piece that came first and to the row that
    reached its room first."""
    tree, by_room = RoomTree(capacity), [[] for _ in range(capacity + 1)]
    rows: list[list[int]] = []
    for piece in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[piece]
        room = tree.smallest(size)
        if room is None:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row = by_room[room].pop(0)
            tree.add(room, -1)
        rows[row].append(piece)
        if room > size:
            by_room[room - size].append(row)
            tree.add(room - size)
    return rows


def pack_documents(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
                   row_tokens: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Packed rows: ``ids`` (little-endian unsigned 32-bit, unpadded), ``position_ids``
    (the same form, from 0 in each segment), ``cu_seqlens`` (cumulative segment lengths
    from 0) and, for each segment, ``doc_ids``, ``pieces`` (number of the piece in its
    document) and ``starts`` (its first token's place in the document).

    Null and empty texts have no tokens and are in no row; repeated documents are
    packed as often as they come, null ids kept. ``pack_id`` names task, block and row;
    it depends on how the input is split, the set of segments does not.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"), F.spark_partition_id().alias("part"))
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tokens, total, part, block = [], [], 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            pieces = [(d, p, at, ids[at: at + row_tokens])
                      for d, ids in enumerate(tokens) for p, at in enumerate(range(0, len(ids), row_tokens))]
            packed = best_fit_decreasing([len(x[3]) for x in pieces], row_tokens)
            for first in range(0, len(packed), 512):
                out = [[pieces[k] for k in row] for row in packed[first: first + 512]]
                lengths = [[len(x[3]) for x in row] for row in out]
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{part}-{block}-{first + k}" for k in range(len(out))]),
                    pa.array([sum(row) for row in lengths], pa.int32()),
                    pa.array([[names[x[0]].as_py() for x in row] for row in out], pa.list_(names[0].type)),
                    pa.array([[x[1] for x in row] for row in out], pa.list_(pa.int32())),
                    pa.array([[x[2] for x in row] for row in out], pa.list_(pa.int64())),
                    pa.array([np.cumsum([0, *row]).tolist() for row in lengths], pa.list_(pa.int32())),
                    pa.array([np.concatenate([x[3] for x in row]).tobytes() for row in out], pa.binary()),
                    pa.array([np.concatenate([np.arange(n, dtype="<u4") for n in row]).tobytes() for row in lengths], pa.binary()),
                ], ["pack_id", "n_tokens", "doc_ids", "pieces", "starts", "cu_seqlens", "ids", "position_ids"])

        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.asarray(encode_tree(vocabulary, batch.column("text")[k].as_py()), dtype="<u4")
                part = batch.column("part")[k].as_py()
                if len(ids):
                    names.append(batch.column("id")[k])
                    tokens.append(ids)
                    total += len(ids)
                if total >= block_tokens:
                    yield from flush()
                    names, tokens, total, block = [], [], 0, block + 1
        if total:
            yield from flush()

    return rows.mapInArrow(pack, SCHEMA.format(id=kind))


def write_matrices(packed: DataFrame, path: str, row_tokens: int = ROW_TOKENS, padding: int = 50256) -> None:
    """The packed rows as Parquet, with ids and positions padded to ``row_tokens`` so that
    each file's column is a matrix of ids. Padding positions are 0."""
    def padded(column: str, value: int):
        word = F.lit(bytearray(int(value).to_bytes(4, "little")))
        missing = row_tokens - F.col("n_tokens")
        return F.concat(F.col(column), F.unhex(F.repeat(F.hex(word), missing)))

    packed.withColumn("ids", padded("ids", padding)).withColumn("position_ids", padded("position_ids", 0)).write.parquet(path)
