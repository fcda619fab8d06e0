"""Small tables with what every operator has to bear, and brute-force helpers."""

from __future__ import annotations

import random
import re

WORDS = "the of and tion er ing re st le de que ción enver schau nd ble".split()
CLASHING = "row id norm salt text_sha256 kept keep_id n secrets score pii part key component decoded ids".split()


def prose(rnd: random.Random, words: int) -> str:
    return " ".join(rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(words))


def awkward() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and very long texts, ties, repeated rows."""
    rnd = random.Random(5)
    base = prose(rnd, 60)
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, base), (5, base.upper()), (6, base + " \n"), (6, base + " \n"),
        (7, "x" * 200_000), (8, "é🙂\x0b" * 3), (None, base), (None, None), (9, prose(rnd, 3)), (10, prose(rnd, 20_000)),
        (11, base.replace("the", "THE")), (12, " ".join(base.split()[:-1])),
    ]


def frame(spark, rows, extra: bool = True):
    """``doc_id, text`` and columns named as the operators name theirs."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.selectExpr("*", *[f"concat('c', doc_id) AS `{c}`" for c in CLASHING]) if extra else docs


def shingle_set(text: str | None, words: int) -> frozenset:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    k = min(words, len(found))
    return frozenset(tuple(found[i: i + k]) for i in range(len(found) - k + 1)) if k else frozenset()
