import math
import random
from statistics import mean

import pytest

from lineweave.llm.fusion import median_rank


def brute(rows, weights):
    """Merged ranks by a direct reading of the definition."""
    groups = {}
    for g, i, m in rows:
        clean = {k: v for k, v in (m or {}).items() if v is not None and math.isfinite(v) and weights.get(k, 1) > 0}
        groups.setdefault(g, []).append((i, clean))
    out = {}
    for g, items in groups.items():
        names = {k for _, m in items for k in m}
        scored = []
        for i, m in items:
            pairs = []
            for k in names:
                held = [x[k] for _, x in items if k in x]
                if k in m:
                    r = mean(p for p, v in enumerate(sorted(held, reverse=True), 1) if v == m[k])
                else:
                    r = mean(range(len(held) + 1, len(items) + 1))
                pairs.append((r, weights.get(k, 1)))
            pairs.sort()
            total, c, lo, hi = sum(w for _, w in pairs), 0, None, None
            for r, w in pairs:
                c += w
                lo = r if lo is None and 2 * c >= total else lo
                hi = r if hi is None and 2 * c > total else hi
            med = (lo + hi) / 2 if pairs else 0
            avg = sum(r * w for r, w in pairs) / total if pairs else 0
            scored.append((med, round(avg, 9), i))
        for place, (med, avg, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2])), 1):
            out[g, i] = (place, med, avg)
    return out


SCHEMA = "grp string, ident bigint, scores map<string,double>"


@pytest.mark.parametrize("weights", [{}, {"a": 2.0, "c": 0.0, "b": 0.5}])
def test_agrees_with_brute_force(spark, weights):
    r = random.Random(3)
    rows = []
    for i in range(500):
        m = {k: r.choice([None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1.0, 7e9, r.random(), r.random()]) for k in "abcde" if r.random() < 0.8}
        rows.append(("hot" if r.random() < 0.5 else r.choice([None, "x", "y"]), i, m if r.random() < 0.95 else r.choice([None, {}])))
    got = median_rank(spark.createDataFrame(rows, SCHEMA), "grp", "ident", "scores", weights).collect()
    want = brute(rows, weights)
    assert len(got) == len(rows)
    for x in got:
        place, med, avg = want[x.grp, x.ident]
        assert (x.merged_rank, x.median_rank) == (place, med) and abs(x.mean_rank - avg) < 1e-6


def test_no_score_rules_by_its_range(spark):
    rows = [("q", 1, {"big": 1e12, "a": 0.1, "b": 0.1}), ("q", 2, {"big": 5.0, "a": 0.9, "b": 0.8}), ("q", 3, {"big": 1.0, "a": 0.5, "b": 0.5})]
    got = median_rank(spark.createDataFrame(rows, SCHEMA), "grp", "ident", "scores").orderBy("merged_rank").collect()
    assert [x.ident for x in got] == [2, 1, 3] or [x.ident for x in got][0] == 2


def test_empty_table_repeated_rows_and_clashing_names(spark):
    assert median_rank(spark.createDataFrame([], SCHEMA), "grp", "ident", "scores").count() == 0
    rows = [("q", 1, {"a": 2.0}), ("q", 1, {"a": 2.0}), ("q", 2, {"a": 1.0})]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as g", "2 as id", "3 as rank", "4 as before", "5 as n")
    got = median_rank(df, "grp", "ident", "scores").orderBy("merged_rank").collect()
    assert [(x.ident, x.merged_rank) for x in got] == [(1, 1), (1, 2), (2, 3)]
