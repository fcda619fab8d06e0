"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters that occurs in a document with at most k edits shares at least
m - q + 1 - k*q of its q-grams with it, on diagonals that lie within k of each other.
Shared q-grams are counted in overlapping bands of diagonals; bands that reach the
bound are verified by banded alignment. Documents are only scanned: nothing is
shuffled, and the benchmark travels to them in blocks of bounded size, one pass each.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import text_of

Q = 8
EDIT_RATE = 0.1
# Items that are shorter once normalised are no evidence and match nothing.
LEAST_CHARS = 32
# Characters of the benchmark that one pass carries.
BLOCK_CHARS = 8_000_000
# Longer texts are searched in overlapping segments.
SEGMENT = 1 << 18
# Places where a text and the items share a q-gram that are looked at together.
LOOK_AT = 1 << 20
_MIX, _BITS = np.uint64(0xD6E8FEB86659FD93), 22


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case (Latin letters) with runs of white space as one space,
    and where each was in the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = (points >= 65) & (points <= 90) | (points >= 0xC0) & (points <= 0xDE) & (points != 0xD7)
    points = points + (upper.astype(np.uint32) << 5)
    space = (points == 32) | (points >= 9) & (points <= 13) | (points == 0xA0)
    kept = np.flatnonzero(~space | ~np.append([False], space[:-1]) if len(space) else space)
    return np.where(space, np.uint32(32), points)[kept], kept


def q_grams(points: np.ndarray) -> np.ndarray:
    """Eight characters as the eight bytes of a number. Characters past Latin-1 keep
    their low byte: a clash costs a verification, never a match."""
    n = len(points) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    low, out = points.astype(np.uint8), np.empty(n, np.uint64)
    for k in range(min(Q, n)):
        whole = (n - k + Q - 1) // Q
        out[k::Q] = np.frombuffer(low[k: k + whole * Q].tobytes(), np.uint64)
    return out


@dataclass(frozen=True)
class Index:
    """The q-grams of a block of items: sorted, with item and place of each."""

    ids: list
    items: list[np.ndarray]
    budget: np.ndarray  # edits
    bound: np.ndarray  # q-grams that an occurrence shares at least
    grams: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    filter: np.ndarray


def slot(grams: np.ndarray) -> np.ndarray:
    return ((grams * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)


def index_items(ids: list, texts: list[str]) -> Index:
    usable = [(i, p) for i, t in zip(ids, texts, strict=True) if len(p := normalise(t.strip())[0]) >= LEAST_CHARS]
    items = [p for _, p in usable]
    # The bound has to stay above zero.
    budget = np.array([min(int(len(p) * EDIT_RATE), (len(p) - Q) // Q) for p in items], np.int64)
    bound = np.array([len(p) for p in items], np.int64) - Q + 1 - budget * Q
    grams = [q_grams(p) for p in items]
    owner = np.repeat(np.arange(len(items)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
    flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    marks = np.zeros(1 << _BITS, bool)
    marks[slot(flat)] = True
    return Index([i for i, _ in usable], items, budget, bound, flat[order], owner[order], place[order], marks)


def bands(index: Index, points: np.ndarray) -> list[tuple[int, int, int]]:
    """(item, first diagonal, width) of the bands that reach the bound of their item;
    those of an item that overlap are one.

    Places of a q-gram that are no further apart than the least step of all items are one
    stretch: it meets every strip between its ends, so a rule of dashes is not looked at
    dash by dash. Shared places are counted LOOK_AT at a time.
    """
    grams = q_grams(points)
    at = np.flatnonzero(index.filter[slot(grams)]) if len(index.grams) and len(grams) else np.zeros(0, np.int64)
    if not len(at):
        return []
    order = np.argsort(grams[at], kind="stable")
    at, grams = at[order], grams[at][order]
    least = int(index.budget.min()) + 1
    breaks = np.flatnonzero((grams[1:] != grams[:-1]) | (at[1:] - at[:-1] > least)) + 1
    low, high = at[np.append(0, breaks)], at[np.append(breaks, len(at)) - 1]
    grams = grams[np.append(0, breaks)]
    first = np.searchsorted(index.grams, grams, "left")
    count = np.searchsorted(index.grams, grams, "right") - first

    def postings(chosen: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(stretch, posting) by parts, of the chosen items."""
        until = np.cumsum(count)
        cuts = np.unique(np.append(np.searchsorted(until, np.arange(LOOK_AT, until[-1], LOOK_AT)), len(count)))
        for a, b in zip(np.append(0, cuts[:-1]), cuts, strict=True):
            n = count[a:b]
            stretch = np.repeat(np.arange(a, b), n)
            posting = np.repeat(first[a:b] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            if chosen is not None:
                keep = chosen[index.owner[posting]]
                stretch, posting = stretch[keep], posting[keep]
            yield stretch, posting

    # Chance hits: an item with too few shared q-grams in the whole text is out at once.
    # A stretch may lie in both strips of a band.
    shared, looks = np.zeros(len(index.items), np.int64), np.zeros(len(index.items), np.int64)
    for stretch, posting in postings():
        shared += np.bincount(index.owner[posting], 1 + (high > low)[stretch], minlength=len(shared)).astype(np.int64)
        # What the stretches will become, strip by strip.
        looks += np.bincount(index.owner[posting], 1 + ((high - low)[stretch] // (index.budget + 1)[index.owner[posting]]),
                             minlength=len(shared)).astype(np.int64)
    candidates = np.flatnonzero(shared >= index.bound)
    full = []
    group = np.cumsum(looks[candidates]) // LOOK_AT
    for g in np.unique(group):
        chosen = np.zeros(len(index.items), bool)
        chosen[candidates[group == g]] = True
        full += _full_bands(index, postings(chosen), low, high)
    return full


def _full_bands(index: Index, postings: Iterator[tuple[np.ndarray, np.ndarray]], low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int]]:
    cells = [np.zeros(0, np.int64)] * 3  # item, strip, place
    for stretch, posting in postings:
        item, place = index.owner[posting], index.place[posting]
        step = index.budget[item] + 1
        begin = (low[stretch] - place) // step
        n = (high[stretch] - place) // step - begin + 1
        more = np.repeat(item, n), np.repeat(begin - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()), np.repeat(place, n)
        item, strip, place = (np.concatenate(pair) for pair in zip(cells, more, strict=True))
        # Each place of the item counts once in a strip.
        order = np.lexsort((place, strip, item))
        item, strip, place = item[order], strip[order], place[order]
        new = np.append(True, (np.diff(place) != 0) | (np.diff(strip) != 0) | (np.diff(item) != 0))[: len(item)]
        cells = [item[new], strip[new], place[new]]
    item, strip, _ = cells
    if not len(item):
        return []
    heads = np.flatnonzero(np.append(True, (np.diff(strip) != 0) | (np.diff(item) != 0)))
    shared, item, strip = np.diff(np.append(heads, len(item))), item[heads], strip[heads]
    # Two neighbouring strips are a band; bands overlap by one strip.
    follows = np.append((item[1:] == item[:-1]) & (strip[1:] == strip[:-1] + 1), False)
    in_band = shared + np.where(follows, np.append(shared[1:], 0), 0)
    reached = in_band >= index.bound[item]
    item, strip = item[reached], strip[reached]
    if not len(item):
        return []
    starts = np.append(True, (np.diff(item) != 0) | (np.diff(strip) > 1))[: len(item)]
    out = []
    for a, b in zip(np.flatnonzero(starts), np.append(np.flatnonzero(starts)[1:], len(item)), strict=True):
        step = int(index.budget[item[a]]) + 1
        out.append((int(item[a]), int(strip[a]) * step, int(strip[b - 1] - strip[a] + 2) * step))
    return out


def align(item: np.ndarray, points: np.ndarray, diagonal: int, width: int, budget: int) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the occurrences of the item within the budget whose paths stay
    within ``width`` diagonals from ``diagonal`` on: the best for each end."""
    # Unchanged text runs along one diagonal; that needs no table. In a band too
    # narrow for a second occurrence, the first is the best.
    if width < len(item):
        for start in range(max(0, diagonal), min(len(points) - len(item), diagonal + width) + 1):
            if points[start] == item[0] and np.array_equal(points[start: start + len(item)], item):
                return [(0, start, start + len(item))]
    # Column j of a row i stands for position i + diagonal + j of the document.
    lane = np.arange(width + 1)
    cost = np.where((diagonal + lane >= 0) & (diagonal + lane <= len(points)), 0, 1 << 20).astype(np.int64)
    # Cost and start travel together in one number, so the minimum keeps both.
    base = 1 << 32
    state = cost * base + np.clip(diagonal + lane, 0, len(points))
    padded = np.append(points, np.uint32(0xFFFFFFFF))
    for i, point in enumerate(item):
        at = i + diagonal + lane
        inside = (at >= 0) & (at < len(points))
        differs = np.where(inside, padded[np.clip(at, 0, len(points))] != point, True)
        step = state + np.where(inside, differs * base, base << 20)  # both advance
        skip = np.append(state[1:], base << 20) + base  # the item's character is missing
        best = np.minimum(step, skip)
        # Extra characters of the document: a running minimum along the row.
        best = np.minimum.accumulate(best - lane * base) + lane * base
        state = best
    good = np.flatnonzero(state >> 32 <= budget)
    return [(int(state[j] >> 32), int(state[j] & (base - 1)), min(len(points), len(item) + diagonal + int(j))) for j in good]


def occurrences(index: Index, text: str) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) in code points of the text; of occurrences of one item
    that overlap, the one with the fewest edits, then the leftmost."""
    points, where = normalise(text)
    found: dict[int, list[tuple[int, int, int]]] = {}
    overlap = 2 * max(map(len, index.items), default=0)
    for at in range(0, max(1, len(points) - overlap), SEGMENT):
        part = points[at: at + SEGMENT + overlap]
        for i, diagonal, width in bands(index, part):
            # The ends of a path may hold no q-gram and leave the band by the budget.
            margin = int(index.budget[i])
            for edits, start, end in align(index.items[i], part, diagonal - margin, width + 2 * margin, margin):
                if end > start:
                    found.setdefault(i, []).append((edits, at + start, at + end))
    out = []
    for i, spans in sorted(found.items()):
        taken: list[tuple[int, int]] = []  # in order, none overlap
        for edits, start, end in sorted(set(spans)):
            k = bisect.bisect(taken, (start, end))
            if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or taken[k][0] >= end):
                taken.insert(k, (start, end))
                out.append((i, int(where[start]), int(where[end - 1]) + 1, edits))
    return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    """The benchmark as indexes of about BLOCK_CHARS characters each."""
    items = benchmark.select(F.col(item_col).alias("id"), text_of(text_col).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()
        rows = sorted(rows, key=lambda r: (r.id is None, r.id, r.text))
        yield index_items([r.id for r in rows], [r.text for r in rows])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each occurrence of a benchmark item in a document: ``id_col``,
    ``item_col``, ``start`` and ``end`` (code points of the text), ``edits``.

    Null texts are empty and match nothing, items under LEAST_CHARS match nothing,
    repeated items are each reported, repeated documents too. Empty tables give no rows.
    """
    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    id_type, item_type = (t.schema[c].dataType.simpleString() for t, c in ((docs, id_col), (benchmark, item_col)))
    item_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_type]

    def scan(index: Index):
        def leaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                picked, out = [], []
                for k in range(batch.num_rows):
                    for hit in occurrences(index, batch.column("text")[k].as_py()):
                        picked.append(k)
                        out.append(hit)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(picked, pa.int64())),
                     pa.array([index.ids[i] for i, *_ in out], item_arrow),
                     *[pa.array([hit[c] for hit in out], pa.int64()) for c in (1, 2, 3)]],
                    [id_col, item_col, "start", "end", "edits"])

        return rows.mapInArrow(leaks, f"`{id_col}` {id_type}, `{item_col}` {item_type}, start bigint, end bigint, edits bigint")

    found = None
    for index in blocks(benchmark, item_col, item_text_col):
        found = scan(index) if found is None else found.unionByName(scan(index))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without an occurrence of any item, with their own columns."""
    schema = docs.schema

    def keep(index: Index):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(text_col)
                yield batch.filter(pa.array([not occurrences(index, texts[k].as_py() or "") for k in range(batch.num_rows)], pa.bool_()))

        return rows

    for index in blocks(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(keep(index), schema)
    return docs
