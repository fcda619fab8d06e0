import re
from datetime import date

from glosswork.llm import pseudonyms as p
from tests.llm.fixtures import awkward, frame

TEXTS = [
    "call +1 (947) 555-7668 or (123) 456-7890, 4207051279108084 bad 4207051279108085; ip 49.37.233.206. bad 299.1.1.1",
    "4207 0512 7910 8084 and 2024-02-29 no 2023-02-29 29.02.2024 12/31/1999 31/12/1999",
    "a@b.co fakol.33@mail7.example.com 123-45-6789 000-12-3456 666-12-3456", "x" * 60_000 + "@" + "1" * 30_000, "", None,
]


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_values_change_within_their_form_and_back(spark):
    docs = frame(spark, list(enumerate(TEXTS)))
    out = p.pseudonymise(docs, "key")
    assert out.columns == [c for c in docs.columns if c != "pii"] + ["pii"]
    rows = {r.doc_id: r for r in out.collect()}
    shape = lambda t: re.sub("[0-9]", "0", t)
    for i, text in enumerate(TEXTS):
        for v in rows[i].pii:
            value = text[v.start: v.end]
            assert v.pseudonym != value
            if v.kind != "ipv4":
                assert shape(v.pseudonym.lower() if v.kind != "email" else "") == shape(value.lower() if v.kind != "email" else "")
            if v.kind == "card":
                assert luhn(re.sub(r"\D", "", v.pseudonym)) and v.pseudonym[0] == value[0]
            if v.kind == "ipv4":
                assert all(int(o) < 256 for o in v.pseudonym.split("."))
    kinds = [[v.kind for v in rows[i].pii] for i in range(4)]
    assert kinds == [["phone", "phone", "card", "ipv4"], ["card", "date", "date", "date"], ["email", "email", "ssn"], []]
    assert "4207051279108085" in rows[0].text and "2023-02-29" in rows[1].text and "000-12-3456" in rows[2].text
    # Equal values are linked across documents and forms.
    assert rows[0].pii[2].pseudonym == rows[1].pii[0].pseudonym.replace(" ", "")
    assert date.fromisoformat(rows[1].pii[1].pseudonym).strftime("%d.%m.%Y") == rows[1].pii[2].pseudonym
    back = p.pseudonymise(out, "key", back=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(TEXTS))


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    lit = lambda n: F.lit(n).cast("bigint")
    rows = spark.range(7 * 11).select("id", p.feistel(F.col("id"), lit(7), lit(11), "k", F.lit("t")).alias("to"))
    back = rows.select("id", "to", p.feistel(F.col("to"), lit(7), lit(11), "k", F.lit("t"), back=True).alias("again")).collect()
    assert sorted(r.to for r in back) == list(range(77)) and all(r.id == r.again for r in back)


def test_awkward_rows(spark):
    docs = frame(spark, awkward())
    out = p.pseudonymise(docs, "key")
    assert sorted((r.text or "" for r in out.collect())) == sorted(t or "" for _, t in awkward())
    assert out.where("doc_id = 1").first().text is None
    assert p.pseudonymise(docs.where("false"), "key").count() == 0


def test_cards_beside_other_numbers(spark):
    cards = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005"]
    texts = [(f"{card} {more}", ["card", *kinds]) for card in cards for more, kinds in (
        ("12/27", []), ("123", []), ("2 items", []), ("190.137.223.204", ["ipv4"]), ("555-123-4567", ["phone"]), ("5500005555555559", ["card"]))]
    texts += [("order 12 4111111111111111", ["card"]), ("4111111111111112 190.137.223.204", ["ipv4"]), ("4111111111111112 123", [])]
    docs = frame(spark, list(enumerate(t for t, _ in texts)))
    out = p.pseudonymise(docs, "key")
    rows = {r.doc_id: r for r in out.collect()}
    for k, (text, kinds) in enumerate(texts):
        assert [v.kind for v in rows[k].pii] == kinds, text
        assert not any(card in rows[k].text for card in cards)
    back = p.pseudonymise(out, "key", back=True)
    assert {r.doc_id: r.text for r in back.collect()} == {k: t for k, (t, _) in enumerate(texts)}
