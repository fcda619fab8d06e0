"""Substring dedup by hashing units of text.

Lines, cut further at sentence ends, are the units. They are normalised and hashed
where the text is read; digests are grouped globally, the earliest ranked occurrence
(smallest id, then place) of each stays, and all others are repeats. A repeat is
removed when it stands in a run of neighbouring repeats of at least ``least_words``
words, so common short phrases stay, and passages are found whole whether they fill
lines or stand inside one. With ``whole_lines``, lines are units too, and a repeated
line is removed whatever its length. Offsets are those of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import text_of
from glosswork.session import written

LEAST_WORDS = 25
_UNIT = re.compile(r"[^\n.!?。]*(?:[.!?。]+(?=\s|$)|[.!?。]+|\n|$)")


def units(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit that has words, in order. Digests are
    128 bits of the words in lower case, so white space and case don't count."""
    out = []
    for found in _UNIT.finditer(text):
        words = found.group().lower().split()
        if words:
            out.append((found.start(), found.end(), len(words), xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "replace"))))
    return out


def lines(text: str, found: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int, int, int, bytes]]:
    """(first unit, last unit, start, end, words, digest) of each line that has words.
    Digests are those of the line's units, in a domain of their own."""
    out, first = [], 0
    for k, (start, end, _, _) in enumerate(found):
        if k + 1 == len(found) or "\n" in text[end - 1: found[k + 1][0]]:
            of = found[first: k + 1]
            digest = xxhash.xxh3_128_digest(b"\n" + b"".join(u[3] for u in of))
            out.append((first, k, of[0][0], end, sum(u[2] for u in of), digest))
            first = k + 1
    return out


def text_digest(text: Column) -> Column:
    """128 bits that, with its id, name a document: null ids and repeated ids may stand
    for several texts."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def explode_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_lines: bool = False) -> DataFrame:
    """``id``, ``doc`` (digest of the whole text), ``unit`` (place in the document),
    ``upto`` (a line's last unit, null for sentences), ``start``, ``end``, ``words``,
    ``digest``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("doc", text_digest(F.col("text")))
    kind = rows.schema["id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, flat = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                found = units(text)
                place += [(k, unit, None) for unit in range(len(found))]
                flat += found
                if whole_lines:
                    whole = lines(text, found)
                    place += [(k, *x[:2]) for x in whole]
                    flat += [x[2:] for x in whole]
            owner = pa.array([x[0] for x in place], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(owner), batch.column("doc").take(owner),
                 *[pa.array([x[c] for x in place], pa.int32()) for c in (1, 2)],
                 *[pa.array([x[c] for x in flat], pa.int32()) for c in range(3)],
                 pa.array([x[3] for x in flat], pa.binary())],
                ["id", "doc", "unit", "upto", "start", "end", "words", "digest"])

    return rows.mapInArrow(split, f"id {kind}, doc binary, unit int, upto int, start int, end int, words int, digest binary")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS,
                 whole_lines: bool = False) -> DataFrame:
    """``id_col``, ``start``, ``end`` (code points), ``words``, ``kept_in`` (ids whose
    occurrence stays) and ``doc_digest`` (hexadecimal, see ``text_digest``) of every
    stretch to remove.

    Null and empty texts and texts without words have none. A document is an id with a
    text: rows that repeat both are one, rows that repeat an id with another text are
    several, as are the texts without an id, which rank behind all others. Empty tables
    give no rows.
    """
    found = explode_units(docs, id_col, text_col, whole_lines)
    # The rank of an occurrence; combined in the tasks, so a unit that a third of all
    # rows hold is a few rows here.
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "doc", "unit")
    firsts = written(
        found.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
        .where("first <> last").select("digest", F.col("first.id").alias("first_id"), F.col("first.doc").alias("first_doc"), F.col("first.unit").alias("first_unit")),
        "first-occurrences")
    repeats = found.join(firsts, "digest").where(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("doc") == F.col("first_doc")) & (F.col("unit") == F.col("first_unit"))))
    kind = repeats.schema["id"].dataType.simpleString()
    # The units of one document: as bounded as the document.
    by_document = repeats.groupBy("id", "doc").agg(
        F.array_sort(F.collect_set(F.struct("unit", "start", "end", "words", "first_id", "upto"))).alias("units"))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, out = [], []
            for k, listed in enumerate(batch.column("units").to_pylist()):
                # A repeated line's units are repeats as well.
                line_of = {u: x["first_id"] for x in listed if x["upto"] is not None for u in range(x["unit"], x["upto"] + 1)}
                run: list[dict] = []
                for unit in [*(x for x in listed if x["upto"] is None), None]:
                    if run and (unit is None or unit["unit"] > run[-1]["unit"] + 1):
                        if sum(u["words"] for u in run) >= least_words:
                            parts = [run]
                        else:
                            parts = [list(part) for whole, part in groupby(run, lambda u: u["unit"] in line_of) if whole]
                        for part in parts:
                            kept = {u["first_id"] if parts[0] is run else line_of[u["unit"]] for u in part}
                            owner.append(k)
                            out.append((part[0]["start"], part[-1]["end"], sum(u["words"] for u in part), sorted(kept - {None})))
                        run = []
                    if unit is not None and not (run and unit["unit"] == run[-1]["unit"]):
                        run.append(unit)
            ids, docs_of = batch.column("id"), batch.column("doc").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owner, pa.int64())), *[pa.array([x[c] for x in out], pa.int64()) for c in range(3)],
                 pa.array([x[3] for x in out], pa.list_(ids.type)), pa.array([docs_of[k].hex() for k in owner], pa.string())],
                [id_col, "start", "end", "words", "kept_in", "doc_digest"])

    return by_document.mapInArrow(stretches, f"`{id_col}` {kind}, start bigint, end bigint, words bigint, kept_in array<{kind}>, doc_digest string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS,
                   whole_lines: bool = False) -> DataFrame:
    """``docs`` with the repeats cut out of their texts. Null texts stay null."""
    spans = written(
        find_repeats(docs, id_col, text_col, least_words, whole_lines).groupBy(F.col(f"`{id_col}`").alias("_id"), F.unhex("doc_digest").alias("_doc"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts")),
        "repeats")
    # Pieces between the cuts, by original offsets.
    ends = F.concat(F.transform("_cuts", lambda c: c["start"]), F.array(F.length(text_col).cast("bigint")))
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_cuts", lambda c: c["end"]))
    text = F.col(f"`{text_col}`")
    pieces = F.zip_with(begins, ends, lambda b, e: F.substring(text, (b + 1).cast("int"), F.greatest(e - b, F.lit(0)).cast("int")))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (text_digest(text.cast("string")) == F.col("_doc"))
    cut = docs.join(spans, same, "left").withColumn(
        text_col, F.when(F.col("_cuts").isNull(), text).otherwise(F.array_join(pieces, "")))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])
