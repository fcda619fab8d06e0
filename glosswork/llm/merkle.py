"""Merkle dataset manifest with upper proofs by butterfly exchange.

A table is a tree of trees: the rows of a group, in the order of their ids, are the
leaves of the group's tree, and the groups' roots are the leaves of the tree above.
While a level has several nodes, each run of ``fanout`` neighbours becomes its hash.

Leaves are dealt into partitions of ``fanout ** HEIGHT`` neighbours, aligned to the
runs. Each partition hashes its own subtree. Then the partitions swap: in round r, the
partitions at the same offset of ``fanout`` aligned blocks of ``fanout ** r`` partitions
form a group, give each other the roots of their blocks, and each of them hashes the
parent. All of them learn the siblings on the way, so when the roots are reached, every
partition holds the upper part of its leaves' proofs and nothing is passed down. A
round shuffles one row a partition, by groups of at most ``fanout``; the rounds grow
with the logarithm of the number of partitions. In a ragged last block the partitions
stand in for the offsets that it lacks.

Digests are lowercase hex of sha256 over the inputs, digests as hex text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.llm.numbering import numbered, same
from glosswork.session import written

HEIGHT = 7  # levels inside a partition: 2187 leaves at a fanout of three
_LEVEL = pa.struct([("before", pa.string()), ("after", pa.string())])
_PROOF = T.ArrayType(T.StructType().add("before", "string").add("after", "string"))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(values: Sequence[Column]) -> Column:
    """Hash of a row: each value as its length in bytes, a colon and itself; null as ``-``."""
    return digest(F.concat(*[
        F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
        for v in values]))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf digest and a proof lead to."""
    return F.aggregate(proof, start, lambda node, level: digest(F.concat(level["before"], node, level["after"])))


def siblings(proof: Column) -> Column:
    """All sibling digests of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda level: F.concat(level["before"], level["after"])), "")


def manifest(
    docs: DataFrame, columns: Sequence[str], id_col: str = "doc_id", group_col: str = "source",
    fanout: int = 3, also: dict[str, Column] | None = None, height: int = HEIGHT,
) -> DataFrame:
    """One row for each row of ``docs``: the id, the group, ``leaf`` (over ``columns`` in the
    given order), ``subroot``, ``root``, ``proof`` and the columns ``also``, which are
    computed from the row and carried along (digests of another copy, say).

    ``proof`` has the levels from the leaf to the root: the siblings ``before`` and
    ``after`` the node, as joined digests, both empty where a node is alone in its run.
    Nulls come first and null groups are a group; rows that repeat an id are ordered by
    their digests. A lone leaf is its subroot, a lone subroot the root. An empty table
    has no rows and no root.
    """
    also = also or {}
    rows = docs.select(
        F.col(f"`{group_col}`").alias("group"), F.col(f"`{id_col}`").alias("id"),
        leaf([F.col(f"`{c}`") for c in columns]).alias("node"),
        F.struct(F.lit(0).alias("none"), *[c.alias(n) for n, c in also.items()]).alias("also"),
    )
    placed = written(numbered(rows, ["group"], ["id", "node"]), "leaves")
    groups = written(numbered(placed.select("group").distinct(), [], ["group"]), "groups")
    trees = groups.select("group", F.col("place").alias("tree"), F.col("of").alias("trees"))
    # Groups are joined to partitions, not to leaves.
    parts = written(
        _subroots(placed.select("group", "place", "of", "node"), ["group"], fanout, height).alias("p")
        .join(trees.alias("t"), same(["group"], "p", "t")).select("p.*", "tree", "trees"), "partitions")
    forest = written(_butterfly(parts, fanout, height), "forest")
    tops = forest.where("block = 0").select("group", F.col("tree").alias("place"), F.col("trees").alias("of"), "node")
    top_parts = _subroots(tops.select(F.lit(0).alias("tree"), "place", "of", "node"), ["tree"], fanout, height)
    top_forest = written(_butterfly(top_parts, fanout, height), "top-forest")
    top = _expand(tops.select(F.lit(0).alias("tree"), "place", "of", "node", F.struct("group").alias("also")),
                  top_forest.select("tree", "block", F.lit(None).cast("string").alias("subroot"),
                                    F.col("node").alias("root"), "proof"), ["tree"], fanout, height)
    upper = forest.join(
        top.select(F.col("place").alias("tree"), "root", F.col("proof").alias("top")), "tree",
    ).select("group", "block", F.col("node").alias("subroot"), "root", F.concat("proof", "top").alias("proof"))
    leaves = placed.select("group", "place", "of", "node", F.struct("id", "also").alias("also"))
    return _expand(leaves, upper, ["group"], fanout, height).select(
        F.col("also.id").alias(id_col), F.col("group").alias(group_col), F.col("node").alias("leaf"),
        "subroot", "root", "proof", *[F.col(f"also.also.`{n}`").alias(n) for n in also],
    )


def _levels(nodes: list[str], height: int, fanout: int) -> list[list[str]]:
    levels = [nodes]
    for _ in range(height):
        nodes = [hashlib.sha256("".join(nodes[i: i + fanout]).encode()).hexdigest()
                 for i in range(0, len(nodes), fanout)]
        levels.append(nodes)
    return levels


def _height(of: int, height: int, fanout: int) -> int:
    """Levels of a tree of ``of`` leaves, as far as they lie inside a partition."""
    levels, width = 0, 1
    while width < of and levels < height:
        levels, width = levels + 1, width * fanout
    return levels


def _in_partitions(leaves: DataFrame, tree: Sequence[str], size: int) -> DataFrame:
    """Leaves by partition and place: each task reads its partitions one after the other."""
    key = [F.col(f"`{t}`") for t in tree]
    return (
        leaves.withColumn("block", F.expr(f"place div {size}L"))
        .repartition(*key, "block").sortWithinPartitions(*key, "block", "place")
    )


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda row: tuple(row[k] for k in keys))


def _subroots(leaves: DataFrame, tree: list[str], fanout: int, height: int) -> DataFrame:
    """One row a partition: the key of its tree, ``block``, ``blocks`` and ``node``."""
    size = fanout**height
    keys = [*tree, "block"]
    fields = [leaves.schema[t] for t in tree]
    schema = T.StructType(fields).add("block", "long").add("blocks", "long").add("node", "string")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for types, runs in _with_types(batches):
            names = pa.schema([*[(t, types[t]) for t in tree], ("block", pa.int64()), ("blocks", pa.int64()),
                               ("node", pa.string())])
            made = []
            for key, rows in _runs(runs, keys):
                rows = list(rows)
                top = _levels([r["node"] for r in rows], _height(rows[0]["of"], height, fanout), fanout)[-1]
                made.append(dict(zip(keys, key)) | {"blocks": -(-rows[0]["of"] // size), "node": top[0]})
                if len(made) == 1000:
                    yield pa.RecordBatch.from_pylist(made, schema=names)
                    made = []
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=names)

    return _in_partitions(leaves, tree, size).mapInArrow(roots, schema)


def _with_types(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[pa.RecordBatch]]]:
    """The column types with the whole stream, or nothing where the stream is empty."""
    first = next(batches, None)
    if first is not None:
        def stream():
            yield first
            yield from batches
        yield {f.name: f.type for f in first.schema}, stream()


def _butterfly(parts: DataFrame, fanout: int, height: int) -> DataFrame:
    """``parts`` with ``node`` now the root of the partition's tree, and ``proof``, the
    levels between the partition's subtree and that root."""
    tree = [c for c in parts.columns if c not in ("block", "blocks", "node")]
    state = parts.withColumn("proof", F.array().cast(_PROOF))
    blocks, width = parts.agg(F.max("blocks")).first()[0] or 1, 1
    while width < blocks:
        state = _swap(state, tree, width, fanout)
        width *= fanout
    return state


def _swap(state: DataFrame, tree: list[str], width: int, fanout: int) -> DataFrame:
    """One round: every partition gets the roots of the blocks beside its own.

    A message goes to an offset within the blocks of a parent. A full block has one
    partition for each offset; a ragged last one stands in for those it lacks, and a
    parent with one ragged child only has that child's offsets.
    """
    w, pw = f"{width}L", f"{width * fanout}L"
    sent = state.select(
        *[F.col(f"`{t}`") for t in tree], "block", "blocks", "node", "proof",
        F.expr(f"blocks > {w}").alias("busy"),
        F.expr(f"if(blocks > {w}, block div {pw}, block)").alias("parent"),
        F.expr(f"(block div {w}) % {fanout}").alias("child"),
        F.expr(f"if(blocks > {w}, sequence(block % {w}, least({w}, blocks - (block div {pw}) * {pw}) - 1,"
               f" least({w}, blocks - (block div {w}) * {w})), array(-1L))").alias("offsets"),
    ).withColumn("offset", F.explode("offsets"))
    mine = F.expr(f"offset = if(busy, block % {w}, -1L)")
    met = sent.groupBy(*[F.col(f"`{t}`") for t in tree], "busy", "parent", "offset").agg(
        F.sort_array(F.collect_list(F.struct(
            "child", "node", F.when(mine, F.struct("block", "blocks", "proof")).alias("self")))).alias("members"))
    told = met.select(*[F.col(f"`{t}`") for t in tree], "busy", "members", F.explode("members").alias("me")).where("me.self IS NOT NULL")
    nodes = lambda test: F.expr(f"array_join(transform(filter(members, m -> m.child {test}), m -> m.node), '')")
    return told.select(
        *[F.col(f"`{t}`") for t in tree], "me.self.block", "me.self.blocks",
        F.when(F.col("busy"), digest(nodes("IS NOT NULL"))).otherwise(F.col("me.node")).alias("node"),
        F.when(F.col("busy"), F.concat("me.self.proof", F.array(F.struct(
            nodes("< me.child").alias("before"), nodes("> me.child").alias("after")))))
        .otherwise(F.col("me.self.proof")).alias("proof"),
    )


def _expand(leaves: DataFrame, upper: DataFrame, tree: list[str], fanout: int, height: int) -> DataFrame:
    """Leaves (key of the tree, ``place``, ``of``, ``node``, ``also``) with whole proofs.

    What a partition learned (``subroot``, ``root``, ``proof`` of ``upper``) is sorted before its
    leaves; the task that reads them hashes the subtree again and holds one partition.
    """
    size = fanout**height
    keys = [*tree, "block"]
    heads = upper.select(
        *[F.col(f"`{t}`") for t in tree], F.expr(f"block * {size}L - 1").alias("place"), "block",
        F.struct("subroot", "root", "proof").alias("upper"))
    fields = [leaves.schema[t] for t in tree]
    schema = T.StructType([*fields, leaves.schema["node"], leaves.schema["also"]]).add("place", "long").add(
        "subroot", "string").add("root", "string").add("proof", _PROOF)
    key = [F.col(f"`{t}`") for t in tree]
    mixed = (
        leaves.withColumn("block", F.expr(f"place div {size}L"))
        .unionByName(heads, allowMissingColumns=True)
        .repartition(*key, "block").sortWithinPartitions(*key, "block", "place")
    )

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for types, runs in _with_types(batches):
            names = pa.schema([*[(c, types[c]) for c in (*tree, "node", "also")], ("place", pa.int64()),
                               ("subroot", pa.string()), ("root", pa.string()), ("proof", pa.list_(_LEVEL))])
            made = []
            for found, rows in _runs(runs, keys):
                head, rows = next(rows)["upper"], list(rows)
                local = _height(rows[0]["of"], height, fanout)
                levels = _levels([r["node"] for r in rows], local, fanout)
                for i, row in enumerate(rows):
                    proof, at = [], i
                    for level in levels[:-1]:
                        first = at - at % fanout
                        proof.append({"before": "".join(level[first:at]), "after": "".join(level[at + 1: first + fanout])})
                        at //= fanout
                    made.append(dict(zip(tree, found)) | {
                        "node": row["node"], "also": row["also"], "place": row["place"], "subroot": head["subroot"],
                        "root": head["root"], "proof": proof + head["proof"]})
                if len(made) >= 1000:
                    yield pa.RecordBatch.from_pylist(made, schema=names)
                    made = []
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=names)

    return mixed.mapInArrow(prove, schema)
