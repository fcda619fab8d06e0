import hashlib
import random

import pytest
from pyspark.sql import functions as F

from glosswork.llm import merkle

COLUMNS = ["doc_id", "source", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """The root and the siblings of each leaf, level by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i - i % fanout
            proofs[k].append(("".join(nodes[first:i]), "".join(nodes[i + 1: first + fanout])))
        nodes = [sha("".join(nodes[i: i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], proofs


def brute(rows, fanout):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([n[2] for n in sorted(groups[g])], fanout) for g in order}
    root, tops = climb([trees[g][0] for g in order], fanout)
    return sorted(
        (str(i if there else None), str(g), node, trees[g][0], root, tuple(trees[g][1][k] + tops[order.index(g)]))
        for g in order for k, (there, i, node) in enumerate(sorted(groups[g])))


def results(frame):
    return sorted((str(r.doc_id), str(r.source), r.leaf, r.subroot, r.root, tuple((p.before, p.after) for p in r.proof))
                  for r in frame.collect())


def table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    clashing = "place of block node tree proof root group id also upper leaf subroot".split()
    return docs.selectExpr("*", *[f"'c' AS `{c}`" for c in clashing])


def corpus():
    rnd = random.Random(3)
    sizes = {"hot": 100, "é": 28, "z": 27, "B": 9, "": 10, None: 4, "one": 1, "two": 2, **{f"s{i}": 1 + i % 5 for i in range(25)}}
    rows = [(1000 * k + rnd.randrange(500), s, rnd.choice(["", "a\nb", "ü" * 9, None])) for k, (s, n) in enumerate(sizes.items()) for _ in range(n)]
    return rows + [(None, "hot", "x"), (None, "hot", "x"), (7, "hot", "y" * 300_000), rows[0], rows[0]]


@pytest.mark.parametrize("fanout, height", [(3, 2), (2, 1), (3, 7)])
def test_matches_a_tree_built_in_one_place(spark, fanout, height):
    rows = corpus()
    got = merkle.manifest(table(spark, rows), COLUMNS, fanout=fanout, height=height)
    assert results(got) == brute(rows, fanout)
    assert got.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_every_ragged_size(spark):
    rows = [(i, f"g{n}", str(i)) for n in range(1, 84) for i in range(n)]
    assert results(merkle.manifest(table(spark, rows), COLUMNS, height=1)) == brute(rows, 3)


def test_empty_table_and_a_changed_copy(spark):
    docs = table(spark, [(1, "a", "x\n"), (2, "a", "y"), (3, None, None)])
    assert merkle.manifest(docs.where("false"), COLUMNS).count() == 0
    suspect = merkle.leaf([F.col("doc_id"), F.col("source"), F.replace("text", F.lit("\n"), F.lit(""))])
    made = merkle.manifest(docs, COLUMNS, also={"suspect": suspect})
    bad = made.where(merkle.fold(F.col("suspect"), F.col("proof")) != F.col("root"))
    assert [r.doc_id for r in bad.collect()] == [1]
