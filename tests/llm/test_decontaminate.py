import random
import time
import tracemalloc

from glosswork.llm import decontaminate as d
from tests.llm.fixtures import awkward, frame, prose


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edited_passages_are_found_within_the_budget():
    rnd = random.Random(7)
    items = [prose(rnd, rnd.randint(8, 40)) for _ in range(20)]
    index = d.index_items(list(range(20)), items)
    for _ in range(150):
        k = rnd.randrange(20)
        z = list(items[k].lower())
        for _ in range(rnd.randint(0, int(index.budget[k]))):
            at = rnd.randrange(len(z))
            z[at: at + 1] = rnd.choice([[], ["q"], [z[at], "q"]])
        before = prose(rnd, 50)
        text = before + " " + "".join(z) + " " + prose(rnd, 50)
        hits = [h for h in d.occurrences(index, text) if h[0] == k]
        assert hits
        _, start, end, cost = hits[0]
        assert edits(items[k].lower(), text[start:end].lower()) == cost <= index.budget[k]


def test_segments_and_white_space(monkeypatch):
    rnd = random.Random(8)
    item = prose(rnd, 20)
    index = d.index_items([1], [item])
    text = prose(rnd, 400) + "\n\n" + item.upper().replace(" ", "\n  ") + " " + prose(rnd, 400)
    whole = d.occurrences(index, text)
    monkeypatch.setattr(d, "SEGMENT", 256)
    assert d.occurrences(index, text) == whole
    assert [text[a:b].split() for _, a, b, _ in whole] == [item.upper().split()]


def test_tables(spark, monkeypatch):
    rnd = random.Random(3)
    items = [(i, prose(rnd, 20)) for i in range(6)] + [(6, None), (7, "short"), (8, ""), (None, prose(rnd, 20))]
    rows = awkward() + [(50, prose(rnd, 30) + " " + items[0][1] + " x"), (51, items[1][1]), (51, items[1][1]), (52, prose(rnd, 90))]
    docs = frame(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS start", "2 AS doc_id")
    want = [(50, 0), (51, 1), (51, 1)]
    assert sorted((r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()) == want
    monkeypatch.setattr(d, "BLOCK_CHARS", 200)  # several passes
    assert sorted((r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()) == want
    kept = d.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1 for r in kept.collect())) == sorted(x[0] or -1 for x in rows if x[0] not in (50, 51))
    assert d.find_leaks(docs, bench.where("false")).count() == 0 and d.clean(docs.where("false"), bench).count() == 0


def approximate(item, text, budget):
    """Whether the item occurs within the budget anywhere: Sellers' table, whole."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, x in enumerate(item, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best <= budget


def test_no_occurrence_is_missed():
    """Every item against every text: found where a whole table finds it, and only there."""
    rnd = random.Random(17)
    alphabet = "ab "
    items = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(34, 60))) for _ in range(6)]
    items += ["".join(rnd.choice(alphabet) for _ in range(40)) for _ in range(3)] + ["-" * 45, "ab" * 20, "abcde" * 8, "_" * 33 + "x"]
    items = [" ".join(i.split()) or "x" * 40 for i in items]
    items = [i for i in items if len(i) >= d.LEAST_CHARS]
    texts = ["-" * 200, "ab" * 90, "abcde" * 30 + "abcdx" * 8, "_" * 150 + "x" + "_" * 20]
    for _ in range(60):
        z = list(rnd.choice(items))
        for _ in range(rnd.randint(0, 7)):
            at = rnd.randrange(len(z))
            z[at: at + 1] = rnd.choice([[], ["q"], [z[at], "b"]])
        noise = lambda: "".join(rnd.choice(alphabet + "cdefgh") for _ in range(rnd.randint(0, 80)))
        texts.append(noise() + "".join(z) + noise())
    index = d.index_items(list(range(len(items))), items)
    for text in texts:
        plain = " ".join(text.split())
        found = {i for i, *_ in d.occurrences(index, plain)}
        assert found == {k for k in range(len(items)) if approximate(items[k], plain, int(index.budget[k]))}, plain


def test_rules_and_blanks_stay_small():
    """A rule of dashes in an item and in a text: neither memory nor time run away."""
    rnd = random.Random(5)
    items = ["-" * 2000 + prose(rnd, 9), prose(rnd, 5) + " " + "_" * 40, "=-" * 100, prose(rnd, 30)]
    index = d.index_items(list(range(4)), items)
    for text in ("-" * 80_000, "_" * 32_000, "=-" * 20_000, "- " * 20_000):
        tracemalloc.start()
        began = time.perf_counter()
        d.occurrences(index, text + items[3])
        seconds, (_, peak) = time.perf_counter() - began, tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert peak < 500_000_000 and seconds < 30, (text[:4], peak, seconds)


def test_a_very_long_item_hides_no_other():
    rnd = random.Random(6)
    letters = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    short, long = letters(36), letters(1_200_000)
    text = letters(2_400_000) + " " + short + " " + letters(50)
    alone = d.occurrences(d.index_items([0], [short]), text)
    both = d.occurrences(d.index_items([0, 1], [short, long]), text)
    assert alone and [h for h in both if h[0] == 0] == alone


def test_all_occurrences_in_a_repetition():
    rnd = random.Random(9)
    item = prose(rnd, 12)
    index = d.index_items([0], [item])
    text = "start " + (item + " ") * 50 + "end"
    assert len(d.occurrences(index, text)) == 50
