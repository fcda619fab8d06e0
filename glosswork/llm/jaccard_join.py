"""Exact n-gram Jaccard join, and the classes of linked documents.

A size-aware heavy-light join over sets of distinct word shingles. Two sets link when
their Jaccard similarity reaches ``num / den``.

* Equal sets are one set from the start; only distinct sets are compared.
* Light sets list, for each size of partner, all their subsets of the size that such a
  link needs; sets of these two sizes with a common subset (128-bit keys) link.
* Heavy sets scan inverted lists: a link needs a common shingle among the first few of
  both sets in one order of all shingles, so only those are listed. The order is that of
  hashes, but for the MOST_FREQUENT shingles, which come last, the most frequent one at the
  very end: a line that a third of the texts share is listed for texts of little else.
* The boundary is the size up to which listing subsets costs less than scanning, by
  the corpus's own size histogram.

Most texts share little, so shingles are counted first, in two passes: one over the
head of each set, one over the whole sets that are left. A shingle of one set only is
useless to that set, and a set with too many of them links with nothing. Their number
also bounds every overlap.

Lists are never expanded into pairs. Each list compares its members with one of them,
the set with the fewest own shingles; members that are already in one class need no
further comparison, and only those of different classes are compared after that.
Nodes of the graph are sets, named by a hash that is checked to be theirs alone; a document
is an id with a text. Ids may be null (such rows stand alone).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import small_side, text_of
from glosswork.llm.components import components
from glosswork.session import written

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# What one entry of an inverted list costs against one listed subset.
LIST_COST = 4
# 64-bit words of a set's signature.
SIGNATURE = 16
# Beyond this size no set is light, whatever the histogram.
MOST_LIGHT = 24
# Shingles of so many compared texts or more may be put last in the order, and how many
# are: half a megabyte of hashes that go to every task. Any number gives the same links.
FREQUENT_FROM = 64
MOST_FREQUENT = 1 << 16


@dataclass(frozen=True)
class Threshold:
    """Link when den * overlap >= num * union, over shingles of ``words`` words."""

    words: int = 5
    num: int = 80
    den: int = 100

    def required(self, n: int, m: int) -> int:
        """Smallest overlap that links sets of n and m shingles."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def least(self, n: int) -> int:
        """Smallest overlap with any set; also the smallest partner."""
        return -(-self.num * n // self.den)

    def spare(self, n: int) -> int:
        """How many of its shingles a linked set can miss in its partner, at most."""
        return n - self.least(n)

    def partners(self, n: int) -> range:
        return range(self.least(n), self.den * n // self.num + 1)

    def head(self, n: int) -> int:
        """Length of the head that the first pass counts: a linked set finds
        ``common(n)`` of its own shingles in its partner's head too."""
        return min(n, self.spare(n) + n // 20 + 1)

    def common(self, n: int) -> int:
        m = self.least(n)
        return min(m // 20 + 1, n - self.spare(n))


# A-Z as a-z, byte by byte; other bytes of UTF-8 stay. `bytes.split` then cuts at exactly
# the six white space characters of ASCII.
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CACHED_WORDS, _CACHED_LENGTH = 1 << 18, 64


class _WordHashes(dict):
    """64-bit hashes of words, computed once for a word as long as it is remembered."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= _CACHED_LENGTH:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[word] = found
        return found


_HASHES = _WordHashes()


def _shingles_of(hashes: np.ndarray, words: int) -> np.ndarray:
    if not len(hashes):
        return hashes
    k = min(words, len(hashes))
    n = len(hashes) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i: n + i]) * _A
        out ^= out >> np.uint64(29)
    out *= _B
    out ^= out >> np.uint64(32)
    return np.unique(out)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text of a column, the sorted distinct 64-bit hashes of its word
    shingles. Words are separated by ASCII white space, A-Z count as a-z. Fewer words
    than a shingle are one shingle; no words, none."""
    for text in texts.cast(pa.large_binary()):
        found = text.as_py().translate(_LOWER).split()
        yield _shingles_of(np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found)), words)


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(np.concatenate([np.zeros(0, np.uint64), *arrays]))))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text`` and ``digest``, which tells texts of one id apart."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).withColumn("digest", F.xxhash64("text"))


def _kind(frame: DataFrame, column: str) -> str:
    return frame.schema[column].dataType.simpleString()


@dataclass(frozen=True)
class Names:
    """How sets are named: by a 64-bit hash, and those that share it with another set
    (``clashes``) by a second one. ``bits`` is smaller in tests only."""

    clashes: frozenset = frozenset()
    bits: int = 64

    def of(self, found: list[np.ndarray]) -> np.ndarray:
        raw = [one.tobytes() for one in found]
        names = [xxhash.xxh3_64_intdigest(one) >> (64 - self.bits) for one in raw]
        return np.array([xxhash.xxh3_64_intdigest(one, seed=2) if name in self.clashes else name
                         for one, name in zip(raw, names, strict=True)], np.uint64)


def measure(texts: DataFrame, rule: Threshold, names: Names = Names()) -> DataFrame:
    """``id``, ``digest``, ``n`` (set size), ``name`` and ``check``, another hash of the set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column("text"), rule.words))
            check = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), seed=1) for s in found], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("digest"), pa.array([len(s) for s in found], pa.int64()),
                 pa.array(_signed(names.of(found))), pa.array(_signed(check))], ["id", "digest", "n", "name", "check"])

    return texts.mapInArrow(sets, f"id {_kind(texts, 'id')}, digest bigint, n bigint, name bigint, check bigint")


def _measured(texts: DataFrame, rule: Threshold, names: Names) -> tuple[DataFrame, Names]:
    """Sizes and names, once names are unique: 2**-65 times the square of the number of sets
    share theirs, 17 at 25 billion. Those few come to the driver and are named anew."""
    measured = written(measure(texts, rule, names), "set-sizes")
    shared = (
        measured.where("n > 0").groupBy("name").agg(F.min("check").alias("low"), F.max("check").alias("high"))
        .where("low <> high").select("name").collect())
    if not shared:
        return measured, names
    names = Names(frozenset(r["name"] % (1 << 64) for r in shared), names.bits)
    return written(measure(texts, rule, names), "set-sizes"), names


def _listed(texts: DataFrame, rule: Threshold, names: Names, pick) -> DataFrame:
    """``id``, the name of a text's set, and as ``keys`` the shingles that ``pick(set)`` chooses."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column("text"), rule.words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(names.of(found))), _lists([pick(s) for s in found])], ["id", "keys"])

    return texts.select("text").mapInArrow(rows, "id bigint, keys array<bigint>")


@dataclass(frozen=True)
class Order:
    """An order of all shingles: by hash, but ``frequent`` ones (sorted) after all others,
    by ``turns``."""

    frequent: np.ndarray
    turns: np.ndarray

    @staticmethod
    def of(rarest_first: np.ndarray) -> Order:
        turns = np.argsort(rarest_first, kind="stable")
        return Order(rarest_first[turns], turns)

    def sort(self, found: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return found
        at = np.minimum(np.searchsorted(self.frequent, found), len(self.frequent) - 1)
        return found[np.argsort(np.where(self.frequent[at] == found, self.turns[at], -1), kind="stable")]


def _heavy_sets(texts: DataFrame, rule: Threshold, order: Order) -> DataFrame:
    """``keys``, the shingles under which a set is listed, and ``bits``, its signature:
    each shingle flips one of its bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bits = [], []
            for found in shingle_sets(batch.column("text"), rule.words):
                keys.append(order.sort(found)[: rule.spare(len(found)) + 1])
                flips = np.bincount((found >> np.uint64(32)).astype(np.int64) % (64 * SIGNATURE), minlength=64 * SIGNATURE) & 1
                bits.append(np.packbits(flips.astype(np.uint8)).view(np.uint64))
            yield (batch.select(["id", "n", "own"]).append_column("keys", _lists(keys)).append_column("bits", _lists(bits)))

    return texts.mapInArrow(rows, "id bigint, n bigint, own bigint, keys array<bigint>, bits array<bigint>")


def _counted(keys: DataFrame) -> DataFrame:
    """For each ``name`` of a set ``own``, how many of its listed shingles no other set has; and
    in rows without a name each shingle ``key`` that is listed FREQUENT_FROM times or more, with
    its ``size``. Counted per shingle by its smallest and largest name, so a common shingle is
    combined in the tasks before the shuffle."""
    only = F.col("name") == F.col("last")
    return (
        keys.select("id", F.explode("keys").alias("key"))
        .groupBy("key").agg(F.min("id").alias("name"), F.max("id").alias("last"), F.count(F.lit(1)).alias("size"))
        .where(only | (F.col("size") >= FREQUENT_FROM))
        .groupBy(F.when(only, F.col("name")).alias("name"), F.when(~only, F.col("key")).alias("key"))
        .agg(F.count(F.lit(1)).alias("own"), F.max("size").alias("size"))
    )


def _own(counted: DataFrame) -> DataFrame:
    return counted.where("name IS NOT NULL").select("name", "own")


def _order(counted: DataFrame) -> Order:
    """The order that puts the MOST_FREQUENT shingles last."""
    top = counted.where("name IS NULL").orderBy(F.desc("size"), "key").limit(MOST_FREQUENT).select("key").toArrow()
    return Order.of(top["key"].to_numpy().view(np.uint64)[::-1])


def light_boundary(histogram: dict[int, int], rule: Threshold) -> int:
    """The largest size whose sets are light: up to it, listing subsets costs less than
    listing heads and scanning them."""
    best, best_cost, cost = 0, 0, 0
    for n in range(1, MOST_LIGHT + 1):
        subsets = sum(math.comb(n, rule.required(n, m)) for m in rule.partners(n))
        cost += histogram.get(n, 0) * (subsets - LIST_COST * (rule.spare(n) + 1))
        if cost <= best_cost:
            best, best_cost = n, cost
    return best


def _subsets(found: np.ndarray, rule: Threshold, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set's subsets (128 bits), each with the two set sizes it links, and whether the set
    is the smaller (-1), the larger (1) or of the same size (0)."""
    n = len(found)
    keys, sides = [], []
    for m in rule.partners(n) if 0 < n <= boundary else ():
        if m <= boundary:
            sizes = np.array([min(n, m), max(n, m)], np.uint64)
            chosen = combinations(range(n), rule.required(n, m))
            keys += [xxhash.xxh3_128_digest(np.append(found[list(c)], sizes).tobytes()) for c in chosen]
            sides += [(n > m) - (n < m)] * (len(keys) - len(sides))
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2), np.array(sides, np.int8)


def _light_sets(texts: DataFrame, rule: Threshold, boundary: int) -> DataFrame:
    """``id``, ``key``, ``key2`` and ``side`` of every listed subset."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_subsets(s, rule, boundary) for s in shingle_sets(batch.column("text"), rule.words)]
            lengths = [len(keys) for keys, _ in found]
            owner = np.repeat(np.arange(len(found)), lengths)
            keys, sides = (np.concatenate([none, *part]) for none, part in zip(
                (np.zeros((0, 2), np.uint64), np.zeros(0, np.int8)), ([f[c] for f in found] for c in (0, 1)), strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(owner, pa.int64())), *(pa.array(_signed(keys[:, c])) for c in (0, 1)),
                 pa.array(sides)], ["id", "key", "key2", "side"])

    return texts.mapInArrow(rows, "id bigint, key bigint, key2 bigint, side tinyint")


def _overlaps(pairs: DataFrame, texts: DataFrame, rule: Threshold) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(*(shingle_sets(batch.column(c), rule.words) for c in ("text_a", "text_b")), strict=True):
                overlap = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(rule.den * overlap >= rule.num * (len(left) + len(right) - overlap))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(verified, "a bigint, b bigint")


def links(docs: DataFrame, rule: Threshold, id_col: str = "doc_id", text_col: str = "text",
          names: Names = Names()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, sets, classes): ``id``, ``digest``, ``n`` and ``name`` (of its set, null for an
    empty one or without an id) of each row; ``name``, ``n`` and one row of each set, the smallest
    ``id`` and its ``digest``; ``id`` and ``component``, names of the sets that link with another one."""
    texts = _texts(docs, id_col, text_col)
    measured, names = _measured(texts, rule, names)
    members = measured.withColumn("name", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("name"))).drop("check")
    # Tables that are joined to rows with hot keys are written first: a join of two plain
    # shuffles is one that Spark can split where a key is large.
    sets = written(
        members.where("name IS NOT NULL").groupBy("name").agg(
            F.max("n").alias("n"), F.min("id").alias("id"), F.min_by("digest", "id").alias("digest")),
        "set-representatives")
    texts = texts.where(F.col("id").isNotNull())

    histogram = {r["n"]: r["count"] for r in sets.where(F.col("n").between(1, MOST_LIGHT)).groupBy("n").count().collect()}
    boundary = light_boundary(histogram, rule)
    light = _light_links(texts, sets, boundary, rule)

    known, order = _comparable(texts, sets, rule.least(boundary + 1), rule, names)
    # The few texts that are compared, written so that a join to them can be split
    # where many pairs share a text.
    chosen = written(_bodies(texts, known, "n", "own").dropDuplicates(["id"]), "compared-texts")
    bodies = chosen.select("id", "text")
    heavy = written(_heavy_sets(chosen, rule, order), "heavy-sets")
    listed = heavy.select("id", "n", "own", F.explode("keys").alias("key"))
    # Each list against its member with the fewest own shingles, by bands of set size.
    banded = listed.withColumn("band", F.floor(F.log(1.25, "n")))
    pivots = written(
        banded.groupBy("key", "band").agg(F.min(F.struct("own", "id", "n")).alias("pivot"), F.count(F.lit(1)).alias("size"))
        .where("size > 1").select("key", "band", F.col("pivot.id").alias("p_id"), F.col("pivot.n").alias("p_n"), F.col("pivot.own").alias("p_own")),
        "list-pivots")
    first = written(
        banded.join(pivots, ["key", "band"]).where("id <> p_id")
        .where(_possible(rule, "n", "own", "p_n", "p_own"))
        .select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b"), F.col("p_id").alias("pivot")).distinct(),
        "first-pairs")
    to_pivot = first.select(F.when(F.col("pivot") == F.col("b"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("pivot").alias("b"))
    classes = components(_overlaps(to_pivot, bodies, rule).unionByName(light))

    # Lists that still hold several classes: pairs of different classes, but for those
    # that were compared already.
    placed = listed.join(classes, "id", "left").select("key", "id", "n", "own", F.coalesce("component", "id").alias("class"))
    mixed = written(
        placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key"),
        "mixed-keys")
    still = written(placed.join(mixed, "key", "left_semi").join(heavy.select("id", "bits"), "id"), "mixed-lists")
    one, other = (still.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "own", "class", "bits")]) for side in "ab")
    differ = sum(F.bit_count(F.get("bits_a", F.lit(k)).bitwiseXOR(F.get("bits_b", F.lit(k)))) for k in range(SIGNATURE))
    later_pairs = (
        one.join(other, "key").where("id_a < id_b AND class_a <> class_b")
        .where(_possible(rule, "n_a", "own_a", "n_b", "own_b"))
        # Sets differ in at least as many shingles as their signatures in bits.
        .where(differ <= F.col("n_a") + F.col("n_b") - 2 * _required(rule, F.col("n_a"), F.col("n_b")))
        .select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    later = written(_overlaps(later_pairs, bodies, rule), "later-links")
    if not later.isEmpty():
        classes = components(later.unionByName(classes.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    return members, sets, classes


def _bodies(texts: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """``id`` (the name of the set), ``text`` and ``columns`` of each set, from its own row;
    rows that are repeated in ``texts`` come as often."""
    picked = written(sets.select("name", "id", "digest", *columns), "picked-sets")
    return texts.join(small_side(picked), ["id", "digest"]).select(F.col("name").alias("id"), *columns, "text")


def _least(rule: Threshold, n: Column) -> Column:
    return F.ceil(n * rule.num / rule.den)


def _required(rule: Threshold, n: Column, m: Column) -> Column:
    return F.ceil((n + m) * rule.num / (rule.num + rule.den))


def _possible(rule: Threshold, n_a: str, own_a: str, n_b: str, own_b: str) -> Column:
    """Whether two sets can reach the overlap that links them."""
    n_a, own_a, n_b, own_b = map(F.col, (n_a, own_a, n_b, own_b))
    return F.least(n_a - own_a, n_b - own_b) >= _required(rule, n_a, n_b)


def _light_links(texts: DataFrame, sets: DataFrame, boundary: int, rule: Threshold) -> DataFrame:
    """Light sets with a common subset of a size that links them: those of one size with
    the first of the other, and those of equal sizes with the first."""
    subsets = _light_sets(_bodies(texts, sets.where(F.col("n").between(1, boundary))), rule, boundary)
    firsts = written(
        subsets.groupBy("key", "key2").agg(
            F.min(F.when(F.col("side") <= 0, F.col("id"))).alias("small"), F.min(F.when(F.col("side") >= 0, F.col("id"))).alias("large"),
            F.max("id").alias("last"))
        .where("small <> large OR (small = large AND small <> last)").drop("last"),
        "light-subsets")
    return (
        subsets.join(firsts, ["key", "key2"])
        .select(F.col("id").alias("a"), F.when(F.col("side") > 0, F.col("small")).otherwise(F.col("large")).alias("b"))
        .where("a <> b").distinct()
    )


def _comparable(texts: DataFrame, sets: DataFrame, from_size: int, rule: Threshold, names: Names) -> tuple[DataFrame, Order]:
    """Rows of ``sets`` with ``own`` that can still link, by their own shingles; and the order
    in which such sets are listed."""
    n = F.col("n")
    least = _least(rule, n)
    spare = n - least
    # First pass, over heads; the two formulas are Threshold.head and Threshold.common.
    head = F.least(n, spare + F.floor(n / 20) + 1)
    common = F.least(F.floor(least / 20) + 1, least)
    heads = _listed(texts, rule, names, lambda s: s[: rule.head(len(s))] if len(s) >= from_size else s[:0])
    alive = written(
        sets.where(n >= from_size).join(_own(_counted(heads)), "name", "left")
        .where(F.coalesce("own", F.lit(0)) <= head - common).drop("own"),
        "sets-that-share")
    # Second pass, over the whole sets of what is left.
    counted = written(_counted(_listed(_bodies(texts, alive), rule, names, lambda s: s)), "shingle-counts")
    left = alive.join(_own(counted), "name", "left").withColumn("own", F.coalesce("own", F.lit(0))).where(F.col("own") <= spare)
    return written(left, "sets-to-compare"), _order(counted)


def _classes(docs: DataFrame, rule: Threshold, id_col: str, text_col: str, names: Names = Names()) -> tuple[DataFrame, DataFrame]:
    """(members, sets): the rows, and each set by ``name`` with the smallest ``id`` of its class
    and that row's ``digest``."""
    members, sets, classes = links(docs, rule, id_col, text_col, names)
    placed = sets.join(classes.select(F.col("id").alias("name"), "component"), "name", "left").select(
        "name", "id", "digest", F.coalesce("component", "name").alias("component"))
    first = written(placed.groupBy("component").agg(F.min("id").alias("id"), F.min_by("digest", "id").alias("digest")), "class-firsts")
    return members, written(placed.select("name", "component").join(first, "component").drop("component"), "set-classes")


def classify(docs: DataFrame, rule: Threshold, id_col: str = "doc_id", text_col: str = "text", names: Names = Names()) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` (the smallest id that links reach,
    itself included) of every row of ``docs``.

    Null and empty texts and texts of white space have no shingles and stand alone, as
    do rows without an id, whose class is null. Repeated rows share a class; rows that
    repeat an id with another text are documents of their own. Empty tables give no rows.
    """
    members, sets = _classes(docs, rule, id_col, text_col, names)
    return members.alias("m").join(sets.select("name", F.col("id").alias("low")), "name", "left").select(
        F.col("m.id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("low", "m.id").alias("component_id"))


def drop_near_copies(docs: DataFrame, rule: Threshold, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document of each class, by the smallest id, with its own columns. A document
    is an id with a text: rows that repeat both stay together, and a text that an id has beside
    another one goes or stays with its own class. Rows without an id and without words stay."""
    members, sets = _classes(docs, rule, id_col, text_col)
    kept = sets.select("name", F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    gone = written(
        members.join(kept, "name").where((F.col("id") != F.col("_id")) | (F.col("digest") != F.col("_digest")))
        .select(F.col("id").alias("_gone"), F.col("digest").alias("_text")).distinct(),
        "near-copies")
    same_text = F.xxhash64(text_of(text_col)) == F.col("_text")
    return docs.join(small_side(gone), (F.col(f"`{id_col}`") == F.col("_gone")) & same_text, "left_anti")
