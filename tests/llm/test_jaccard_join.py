import random
from itertools import combinations

import numpy as np
import pytest

from glosswork.llm import jaccard_join as j
from glosswork.llm.components import components
from tests.llm.fixtures import awkward, frame, prose, shingle_set


def brute(rows, rule):
    """Rows are nodes; a class goes by its smallest id."""
    sets = [shingle_set(t, rule.words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations([k for k, (d, _) in enumerate(rows) if d is not None and sets[k]], 2):
        o = len(sets[a] & sets[b])
        if rule.den * o >= rule.num * (len(sets[a]) + len(sets[b]) - o):
            parent[find(b)] = find(a)
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            low[find(k)] = min(low.get(find(k), d), d)
    return sorted(((d, len(sets[k]), None if d is None else low[find(k)]) for k, (d, _) in enumerate(rows)), key=repr)


def near(rnd, base, edits):
    words = base.split()
    for _ in range(edits):
        at = rnd.randrange(len(words))
        words[at: at + 1] = rnd.choice([[], [rnd.choice("xyz")], [words[at], rnd.choice("xyz")]])
    return " ".join(words)


@pytest.mark.parametrize("rule", [j.Threshold(4, 85, 100), j.Threshold()])
def test_classes_match_brute_force(spark, rule):
    rnd = random.Random(11)
    rows = []
    for _ in range(12):
        base = prose(rnd, rnd.choice([5, 7, 9, 12, 16, 25, 60, 150]))
        rows += [(len(rows) + k, near(rnd, base, rnd.choice([0, 0, 1, 1, 2, 3, 5]))) for k in range(14)]
    line = prose(rnd, 12)
    rows += [(1000 + k, line + "\n" + prose(rnd, rnd.choice([4, 40]))) for k in range(40)]
    rows += [(2000 + (d or 0) if d is not None else None, t if len(t or "") < 9_000 or k == 7 else t) for k, (d, t) in enumerate(awkward())]
    # Ids that have several texts, near and far.
    rows += [(3, rows[40][1]), (3, prose(rnd, 50)), (5, rows[5][1] + " z"), (0, "a b"), (7, rows[7][1])]
    got = sorted(map(tuple, j.classify(frame(spark, rows), rule).collect()), key=repr)
    assert got == brute(rows, rule)


@pytest.mark.parametrize("most", [0, 5, 40, j.MOST_FREQUENT])
def test_frequent_shingles_only_change_the_order(spark, monkeypatch, most):
    """Texts with lines that many share, from next to nothing else to little of them."""
    monkeypatch.setattr(j, "FREQUENT_FROM", 3)
    monkeypatch.setattr(j, "MOST_FREQUENT", most)
    rnd = random.Random(21)
    lines = [prose(rnd, 14) for _ in range(3)]
    rows = [(k, "\n".join([*rnd.sample(lines, rnd.randint(1, 3)), prose(rnd, rnd.choice([2, 6, 12, 40, 90]))])) for k in range(60)]
    rows += [(60 + k, near(rnd, rows[k][1], rnd.choice([0, 1, 2, 4]))) for k in range(60)]
    rule = j.Threshold()
    assert sorted(map(tuple, j.classify(frame(spark, rows), rule).collect()), key=repr) == brute(rows, rule)


def test_a_line_in_a_third_of_the_texts_makes_no_long_list(spark, monkeypatch):
    """The lists of texts that share a line do not grow with their number."""
    rnd = random.Random(22)
    line, tables, real = prose(rnd, 20), {}, j.written
    monkeypatch.setattr(j, "written", lambda frame, name: tables.update({name: real(frame, name)}) or tables[name])
    rows = [(k, prose(rnd, 90) + ("\n" + line if k % 3 == 0 else "")) for k in range(450)]
    # A copy with one other word each, so that no set falls out before lists are made.
    rows += [(1000 + k, near(rnd, text, 1)) for k, text in rows]
    rule = j.Threshold()
    got = {r.doc_id: r.component_id for r in j.classify(frame(spark, rows), rule).collect()}
    assert got == {k: k % 1000 for k, _ in rows}
    lists = tables["heavy-sets"].selectExpr("explode(keys) AS key").groupBy("key").count()
    # A few texts have the same change inside the line.
    assert tables["heavy-sets"].count() == 900 and lists.selectExpr("max(count)").first()[0] <= 8


def test_order_is_one_of_all_shingles():
    rnd = random.Random(23)
    every = [rnd.getrandbits(64) for _ in range(300)]
    frequent = rnd.sample(every, 60)
    order = j.Order.of(np.array(frequent, np.uint64))
    want = sorted(set(every) - set(frequent)) + frequent
    for _ in range(20):
        some = rnd.sample(every, rnd.randint(0, 50))
        assert order.sort(np.array(sorted(some), np.uint64)).tolist() == [x for x in want if x in some]


def test_sets_that_share_a_name_are_told_apart(spark):
    rnd = random.Random(4)
    rows = [(k, prose(rnd, 8)) for k in range(60)] + [(60 + k, prose(rnd, 70)) for k in range(30)]
    rows += [(90 + k, near(rnd, rows[60 + k][1], 1)) for k in range(30)]
    rule = j.Threshold()
    got = sorted(map(tuple, j.classify(frame(spark, rows), rule, names=j.Names(bits=5)).collect()), key=repr)
    assert got == brute(rows, rule)


def test_words_that_a_polynomial_takes_for_one_do_not_link(spark):
    thue = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    rows = [(1, thue), (2, thue.translate(str.maketrans("ab", "ba"))), (3, "É" + thue), (4, "é" + thue), (5, thue.upper())]
    assert sorted(map(tuple, j.classify(frame(spark, rows), j.Threshold()).collect())) == brute(rows, j.Threshold())


@pytest.mark.parametrize("rule", [j.Threshold(4, 85, 100), j.Threshold()])
@pytest.mark.parametrize("words", [9, 10, 11])
def test_short_texts_that_differ_in_one_end_word(spark, rule, words):
    rnd = random.Random(words)
    rows = []
    for k in range(20):
        base = prose(rnd, words).split()
        for at in (None, 0, -1):
            text = list(base)
            if at is not None:
                text[at] = f"other{k}"
            rows.append((len(rows), " ".join(text)))
        # Longer by one and two words: sets of other sizes, some of which do link.
        rows += [(len(rows), " ".join([*base, "more"])), (len(rows) + 1, " ".join([*base, "more", "still"]))]
    got = sorted(map(tuple, j.classify(frame(spark, rows), rule).collect()), key=repr)
    assert got == brute(rows, rule)


def test_light_sets_take_part_up_to_the_boundary():
    rule = j.Threshold(4, 85, 100)
    assert j.light_boundary({}, rule) == j.MOST_LIGHT  # nothing to lose
    assert 5 <= j.light_boundary({n: 10 for n in range(1, 25)}, rule) < 24
    for n in range(1, 60):
        for m in range(1, 60):
            linkable = m in rule.partners(n)
            assert linkable == (rule.required(n, m) <= min(n, m))


def test_keeps_one_of_a_class(spark):
    rnd = random.Random(1)
    base = prose(rnd, 80)
    rows = [(3, base), (1, near(rnd, base, 1)), (2, base + " z"), (9, prose(rnd, 80)), (None, base), (4, "")]
    docs = frame(spark, rows)
    kept = j.drop_near_copies(docs, j.Threshold())
    assert kept.columns == docs.columns and sorted((r.doc_id or 0 for r in kept.collect())) == [0, 1, 4, 9]
    assert j.classify(docs.where("false"), j.Threshold()).count() == 0


def test_a_text_goes_with_its_own_class_whatever_else_its_id_has(spark):
    rnd = random.Random(7)
    a, b, c = (prose(rnd, 60) for _ in range(3))
    rows = [(1, a), (5, a + " z"), (5, b), (5, b), (6, c), (7, near(rnd, c, 1)), (7, b + " y"), (None, a), (8, None), (8, "")]
    kept = j.drop_near_copies(frame(spark, rows), j.Threshold())
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(1, a), (5, b), (5, b), (6, c), (None, a), (8, None), (8, "")], key=repr)


def test_components_of_a_path_and_a_star(spark):
    rnd = random.Random(2)
    path = list(range(100, 140))
    rnd.shuffle(path)
    edges = list(zip(path, path[1:], strict=False)) + [(7, k) for k in range(8, 20)] + [(7, 7), (8, 7), (1, 2)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in path}, **{k: 7 for k in range(7, 20)}, 1: 1, 2: 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
