import random

import numpy as np
import pytest

from tessera.llm import leakage

rng = random.Random(8)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(150)]


def passage(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def holds_by_force(text, item, span, share):
    """Approximate matching of every stretch of the item anywhere in the text."""
    for i in range(len(item)):
        for j in range(i + span, len(item) + 1):
            row = [0] * (len(text) + 1)
            for k, x in enumerate(item[i:j], 1):
                last, row = row, [k]
                for m, y in enumerate(text, 1):
                    row.append(min(last[m] + 1, row[m - 1] + 1, last[m - 1] + (x != y)))
            if min(row) <= share * (j - i) + 1e-9:
                return True
    return False


def edited(words, edits, r):
    out = list(words)
    for _ in range(edits):
        k = r.randrange(len(out))
        kind = r.randrange(3)
        out[k : k + (kind != 2)] = ["changed"] if kind != 1 else []
    return out


def test_alignment_equals_brute_force():
    r = random.Random(3)
    agree = {True: 0, False: 0}
    for t in range(150):
        item = passage(32, t)
        a = r.randrange(0, 10)
        part = edited(item[a : a + r.randrange(14, 24)], r.randrange(0, 4), r)
        text = passage(6, t + 1000) + part + passage(6, t + 2000)
        number = {w: i for i, w in enumerate({*item, *text})}
        code = lambda ws: np.array([number[w] for w in ws])  # noqa: E731, B023
        force = holds_by_force(text, item, 20, 0.1)
        assert leakage.holds(code(text), code(item), 20, 0.1) == force
        agree[force] += 1
    assert min(agree.values()) > 20


def test_planted_passages_come_out(spark):
    r = random.Random(5)
    items = {i: passage(r.randrange(25, 90), 100 + i) for i in range(40)}
    items[41] = passage(5, 1) + items[3][2:30] + passage(5, 2)  # shares a passage
    items[42] = passage(12, 77)  # too short to be found
    docs, expected = {}, set()
    for d in range(160):
        i = r.randrange(40)
        at = r.randrange(0, len(items[i]) - 22)
        kind = d % 4
        part = items[i][at : at + 22]
        if kind == 0:
            part = edited(part, 2, r)
        elif kind == 1:
            part = part[:9]
        elif kind == 2:
            r.shuffle(part)
        docs[d] = passage(r.randrange(0, 150), 5000 + d) + part + passage(r.randrange(0, 60), 9000 + d)
    for d, w in docs.items():
        for i, item in items.items():
            number = {x: k for k, x in enumerate({*item, *w})}
            if leakage.holds(np.array([number[x] for x in w]), np.array([number[x] for x in item])):
                expected.add((d, i))
    write = lambda ws: " ".join(ws).replace("a", "á").title() + "."
    corpus = spark.createDataFrame([(d, write(w), 1) for d, w in docs.items()] + [(900, None, 1), (901, "", 1), (902, "x", 1)], "doc_id long, text string, item_id int").drop("item_id")
    held = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(99, None), (98, "")], "item_id long, text string")
    found = [tuple(x) for x in leakage.leaked(corpus, held).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) >= 60
    assert leakage.leaked(corpus.limit(0), held).collect() == [] == leakage.leaked(corpus, held.limit(0)).collect()
    assert sum(r["documents"] for r in leakage.leak_report(leakage.leaked(corpus, held)).collect()) == len(expected)


def test_items_joined_by_shuffle_are_the_same(spark, monkeypatch):
    items = [(i, " ".join(passage(30, i))) for i in range(6)]
    docs = spark.createDataFrame([(d, t) for d, t in items], "doc_id long, text string")
    held = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(leakage, "BROADCAST_ITEMS", 0)
    monkeypatch.setattr(leakage, "FILTER_BITS", 10)  # a filter so full that it lets nearly everything through
    assert sorted(map(tuple, leakage.leaked(docs, held).collect())) == [(i, i) for i in range(6)]


def test_words_that_all_items_share_open_no_item(spark):
    """A passage of every item, in every document, and items that only some documents hold besides."""
    common = passage(19, 50)  # a word short of a case
    items = {i: common + passage(40, 300 + i) for i in range(30)}
    items[30] = common + ["end"]
    docs = {d: passage(10, 800 + d) + common + passage(9, 900 + d) + (items[d][25:50] if d < 10 else []) for d in range(40)}
    docs[40] = common + ["end"]
    held = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    corpus = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    number = {x: k for k, x in enumerate({*sum(items.values(), []), *sum(docs.values(), [])})}
    code = lambda ws: np.array([number[x] for x in ws])
    expected = {(d, i) for d, w in docs.items() for i, item in items.items() if leakage.holds(code(w), code(item))}
    assert {tuple(r) for r in leakage.leaked(corpus, held).collect()} == expected and (40, 30) in expected


@pytest.mark.parametrize("text", ["The Crème-brûlée!", "THE creme brulee", "the<br />cr­eme bru​lee", "Ｔｈｅ creme <b>bru</b>lee", "thе сrеmе brulее", "the &#99;reme bru-\nlee", "the crème brulee"])
def test_ways_of_writing(text):
    assert leakage.words(text) == ["the", "creme", "brulee"]


def test_other_scripts_stay():
    assert leakage.words("Вкусный суп, 甘い麺 don’t") == ["вкусныи", "суп", "甘い麺", "dont"]
    assert leakage.words(None) == leakage.words("") == []
