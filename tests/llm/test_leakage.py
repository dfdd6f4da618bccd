import random

import numpy as np
import pytest

from lineweave.llm import leakage
from lineweave.llm.leakage import align, leaked, words_of


def plain_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_the_textbook_recurrence():
    r = random.Random(0)
    pairs = [([r.randrange(2, 9) for _ in range(r.randrange(1, 40))], [r.randrange(2, 9) for _ in range(r.randrange(1, 60))]) for _ in range(60)]
    got = align([(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)) for a, b in pairs])
    assert got.tolist() == [plain_score(a, b) for a, b in pairs]


def brute(items, docs):
    def runs(t):
        w = words_of(t)
        return {tuple(w[i : i + 10]) for i in range(len(w) - 9)}

    holders = {}
    for i, _, t in items:
        for g in runs(t):
            holders.setdefault(g, set()).add(i)
    return {(i, d) for d, text in docs for g in runs(text) for i in holders.get(g, ()) if len(holders[g]) <= 3}


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_agrees_with_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(leakage, "BROADCAST_SEEDS", broadcast)
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    stock = text(14)
    items = [(i, f, text(r.randrange(5, 40)) + (" " + stock if i < 5 else "")) for i in range(30) for f in ("q", "a")]
    items += [(100, "q", None), (101, "q", ""), (102, "q", items[0][2]), (103, "a", "one two")]
    docs = []
    for d in range(300):
        parts = [text(r.randrange(0, 30))]
        for _ in range(r.randrange(0, 3)):
            w = r.choice(items)[2] or ""
            w = w.split()
            a, n = r.randrange(0, max(1, len(w))), r.choice([6, 9, 10, 11, 30])
            parts += [", ".join(w[a : a + n]).upper(), text(r.randrange(0, 12))]
        docs.append((d, " ".join(parts)))
    docs += [(1000, None), (1001, ""), (1002, stock), (1003, "É " + items[7][2]), (1004, text(30_000) + " " + items[8][2] + " " + text(30_000))] + docs[:2]
    i = spark.createDataFrame(items, "item_id bigint, field string, text string")
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "'x' as field", "2 as h")
    got = leaked(i, d).filter("shown").select("item_id", "doc_id").distinct().collect()
    assert {tuple(x) for x in got} == brute(items, docs) and len(got) == len(set(map(tuple, got)))


def test_edited_copies_score_high_and_empty_tables_give_nothing(spark):
    words = [f"u{i}" for i in range(40)]
    edited = [w for k, w in enumerate(words) if k % 9] + ["tail"]
    i = spark.createDataFrame([(1, "a", " ".join(words))], "item_id bigint, field string, text string")
    d = spark.createDataFrame([(1, "x " + " ".join(edited)), (2, "y " * 50)], "doc_id bigint, text string")
    (row,) = leaked(i, d).collect()
    assert row.doc_id == 1 and not row.shown and 0.75 < row.share < 1
    assert leaked(i.limit(0), d).count() == 0 and leaked(i, d.limit(0)).count() == 0


def test_recall_of_edited_copies(spark):
    """Items of 40 words copied with a share of their words dropped, replaced or doubled, in the midst of other text."""
    r = random.Random(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, "a", " ".join(r.choice(vocabulary) for _ in range(40))) for i in range(200)]
    docs, rates = [], {}
    for i, _, text in items:
        for k, rate in enumerate((0.05, 0.1, 0.15)):
            out = []
            for w in text.split():
                x = r.random()
                out += [] if x < rate / 3 else [r.choice(vocabulary)] if x < 2 * rate / 3 else [w, w] if x < rate else [w]
            noise = lambda: [r.choice(vocabulary) for _ in range(60)]
            docs.append((1000 * k + i, " ".join([*noise(), *out, *noise()])))
    got = {(x.item_id, x.doc_id) for x in leaked(spark.createDataFrame(items, "item_id bigint, field string, text string"), spark.createDataFrame(docs, "doc_id bigint, text string")).filter("share >= 0.6").collect()}
    for k in range(3):
        rates[k] = sum((i, 1000 * k + i) in got for i in range(200)) / 200
    assert rates[0] >= 0.99 and rates[1] >= 0.97 and rates[2] >= 0.9, rates
    assert all(d % 1000 == i for i, d in got)
