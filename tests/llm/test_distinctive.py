import math
import random
import re

from lineweave.llm.distinctive import term_graphs, term_weights

SCHEMA = "origin string, row_id bigint, content string"


def brute(rows, window):
    lists = [(o, i, [w.lower() for w in re.findall("[A-Za-z0-9_]+", t or "")]) for o, i, t in rows]
    out = []
    for o, i, ws in lists:
        for t in set(ws):
            near = {ws[k] for j, w in enumerate(ws) if w == t for k in range(max(0, j - window + 1), min(len(ws), j + window))} - {t}
            n = sum(1 for p, _, x in lists if p == o and x)
            has = sum(1 for p, _, x in lists if p == o and t in x)
            out.append((o, i, t, len(near), has, round((1 + len(near)) * math.log((n + 1) / has), 6)))
    return sorted(out, key=str)


def test_agrees_with_brute_force(spark):
    r = random.Random(1)
    rows = []
    for i in range(200):
        words = [r.choice(["the", "The", "a", f"w{r.randrange(40)}", f"rare{r.randrange(4000)}"]) for _ in range(r.randrange(30))]
        rows.append((r.choice(["x", "y"]), i, r.choice([" ", "-", ".\n"]).join(words) if r.random() < 0.9 else r.choice([None, "", "é"])))
    rows += rows[:3]
    for window in (1, 2, 4):
        got = term_weights(term_graphs(spark.createDataFrame(rows, SCHEMA), window)).collect()
        assert sorted(((x.origin, x.row_id, x.term, x.degree, x.records, round(x.weight, 6)) for x in got), key=str) == brute(rows, window)


def test_lists_with_nulls_case_and_blanks_and_clashing_columns(spark):
    rows = [("s", 1, ["A", None, " b ", "", "a"], 1), ("s", 2, None, 1), ("s", None, ["a"], 1)]
    df = spark.createDataFrame(rows, "origin string, row_id bigint, content array<string>, term int")
    got = {(x.row_id, x.term): (x.degree, x.records) for x in term_weights(term_graphs(df, 3, from_text=False)).collect()}
    assert got == {(1, "a"): (1, 2), (1, "b"): (1, 1), (None, "a"): (0, 2)}


def test_empty_table_and_very_long_text(spark):
    assert term_weights(term_graphs(spark.createDataFrame([], SCHEMA))).count() == 0
    text = " ".join(f"t{i % 50_000}" for i in range(500_000))
    got = term_weights(term_graphs(spark.createDataFrame([("x", 1, text), ("x", 2, "t1")], SCHEMA)))
    assert got.filter("row_id = 1").count() == 50_000 and got.filter("term = 't5'").first().degree == 4
