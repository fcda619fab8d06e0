"""BPE encoding and decoding with tree concatenation.

A text is halved until its parts are short; the parts are encoded independently, in
different tasks where the text is long, and joined pairwise up the tree. At a join a
window of tokens on both sides is encoded anew and grows until it agrees with the
left part's tokens at its left end and with the right part's at its right end. Pairs
of neighbouring tokens that the encoder itself produced stay valid next to each other,
so an agreed window makes the joined sequence the encoding of the joined text. A cut
before a single space between two ASCII letters or digits is a boundary of the
pre-tokenizer at any rate and needs no window.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import text_of

# Longer texts are cut into leaves that are encoded by different tasks.
LEAF = 16_384
WINDOW = 8
SAFE_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


@dataclass(frozen=True)
class Vocabulary:
    """Where the ranks are, and how texts split before BPE. ``special`` strings in a
    text become their id, as the tokenizers library does by default."""

    ranks_path: str
    pattern: str
    special: tuple[tuple[str, int], ...] = ()


def public_vocabulary() -> Vocabulary:
    import public_tokenizers as public

    return Vocabulary(public.path("byte_bpe_50k.tiktoken"), public.PATTERN, (("<|endoftext|>", 50256),))


@functools.cache
def encoding(vocabulary: Vocabulary) -> tiktoken.Encoding:
    with open(vocabulary.ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bpe", pat_str=vocabulary.pattern, mergeable_ranks=ranks,
                             special_tokens=dict(vocabulary.special))


def encode_plain(enc: tiktoken.Encoding, text: str) -> list[int]:
    return enc.encode(text, allowed_special="all")


def cut_near(text: str, at: int, special: tuple[str, ...]) -> tuple[int, bool]:
    """Where to cut near ``at``, and whether the pre-tokenizer cuts there at any rate.
    Never inside the string of a special token."""
    found = SAFE_CUT.search(text, at, min(len(text), at + 2048))
    if found:
        return found.start(), True
    for token in special:
        inside = text.find(token, max(0, at - len(token) + 1), at + len(token) - 1)
        if 0 <= inside < at:
            at = inside + len(token)
    return at, False


def leaves(text: str, size: int, special: tuple[str, ...]) -> list[tuple[str, bool]]:
    """The text in parts of about ``size`` code points; each with whether the cut
    before it is safe."""
    parts, start, safe = [], 0, True
    while len(text) - start > 2 * size:
        end, next_safe = cut_near(text, start + size, special)
        parts.append((text[start:end], safe))
        start, safe = end, next_safe
    return [*parts, (text[start:], safe)]


def window_text(enc: tiktoken.Encoding, left: list[int], right: list[int]) -> str | None:
    """The window's text, or None where its ends split a character."""
    try:
        return (enc.decode_bytes(left) + enc.decode_bytes(right)).decode()
    except UnicodeDecodeError:
        return None


def join(enc: tiktoken.Encoding, left: list[int], right: list[int]) -> list[int]:
    """The encoding of two neighbouring texts from their encodings."""
    width = WINDOW
    while True:
        n, m = min(width, len(left)), min(width, len(right))
        whole_left, whole_right = n == len(left), m == len(right)
        text = window_text(enc, left[len(left) - n:], right[:m])
        if text is not None:
            new = encode_plain(enc, text)
            agreed = width // 2
            if (whole_left or new[:agreed] == left[len(left) - n:][:agreed]) and (
                whole_right or new[-agreed:] == right[:m][-agreed:]
            ):
                return left[: len(left) - n] + new + right[m:]
        width *= 2


def concatenate(enc: tiktoken.Encoding, parts: list[tuple[list[int], bool]]) -> list[int]:
    """Join parts pairwise, level by level, up the tree."""
    while len(parts) > 1:
        above = []
        for k in range(0, len(parts) - 1, 2):
            (a, safe), (b, certain) = parts[k], parts[k + 1]
            above.append((a + b if certain else join(enc, a, b), safe))
        parts = above + parts[len(parts) - len(parts) % 2:]
    return parts[0][0] if parts else []


def encode_tree(vocabulary: Vocabulary, text: str, leaf: int = LEAF) -> list[int]:
    """The whole work on one text."""
    enc = encoding(vocabulary)
    special = tuple(token for token, _ in vocabulary.special)
    return concatenate(enc, [(encode_plain(enc, part), safe) for part, safe in leaves(text, leaf, special)])


def packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """``id_col`` and ``ids`` (little-endian unsigned 32-bit) of every row of ``docs``.

    Null texts are empty and have no ids. Texts of up to twice ``leaf`` code points are
    encoded where they are read. Longer ones become rows of leaves, spread over the
    tasks whatever document they come from, and only their ids meet again; the same
    text under the same id is encoded once and returned as often as it came. Null ids
    are kept, other columns are not read.
    """
    special = tuple(token for token, _ in vocabulary.special)
    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    id_type = rows.schema[id_col].dataType.simpleString()

    def encode_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            ids = [packed(encode_plain(enc, text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py()
                parts = leaves(text, leaf, special)
                n = len(parts)
                key = hashlib.sha256(text.encode()).digest()
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([batch.column(0).slice(k, 1)] * n), pa.array([key] * n, pa.binary()),
                     pa.array(range(n), pa.int32()), pa.array([safe for _, safe in parts], pa.bool_()),
                     pa.array([part for part, _ in parts], pa.string())],
                    [id_col, "key", "leaf", "safe", "text"])

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            ids = [packed(encode_plain(enc, text)) for text in batch.column("text").to_pylist()]
            yield batch.drop_columns(["text"]).append_column("ids", pa.array(ids, pa.binary()))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            whole = []
            for parts in batch.column("leaves").to_pylist():
                whole.append(packed(concatenate(enc, [(np.frombuffer(p["ids"], "<u4").tolist(), p["safe"]) for p in parts])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("copies"), pa.array(whole, pa.binary())],
                                             [id_col, "copies", "ids"])

    short = rows.where(F.length("text") <= 2 * leaf).mapInArrow(encode_short, f"`{id_col}` {id_type}, ids binary")
    encoded = (
        rows.where(F.length("text") > 2 * leaf)
        .mapInArrow(cut, f"`{id_col}` {id_type}, key binary, leaf int, safe boolean, text string")
        .groupBy(id_col, "key", "leaf")
        .agg(F.first("safe").alias("safe"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        .mapInArrow(encode_leaves, f"`{id_col}` {id_type}, key binary, leaf int, safe boolean, copies bigint, ids binary")
    )
    long = (
        encoded.groupBy(id_col, "key")
        # The leaves of one text: as bounded as the text itself.
        .agg(F.array_sort(F.collect_list(F.struct("leaf", "safe", "ids"))).alias("leaves"), F.first("copies").alias("copies"))
        .select(id_col, F.col("copies"), "leaves")
        .mapInArrow(assemble, f"`{id_col}` {id_type}, copies bigint, ids binary")
        .select(id_col, "ids", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
        .select(id_col, "ids")
    )
    return short.unionByName(long)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids in ``out_col`` (replaced where it exists)
    instead of the ids; special ids become their strings, null ids an empty text."""
    kept = [c for c in encoded.columns if c not in (ids_col, out_col)]
    fields = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            out = [enc.decode(np.frombuffer(ids or b"", "<u4").tolist()) for ids in batch.column(ids_col).to_pylist()]
            yield batch.select(kept).append_column(out_col, pa.array(out, pa.string()))

    return encoded.select(*kept, ids_col).mapInArrow(texts, f"{fields}, {out_col} string")


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row."""
    ids = encode(docs, vocabulary, id_col, text_col).select(
        id_col, F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(ids, vocabulary).select(
        id_col, "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
