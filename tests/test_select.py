"""Requests, ranges, maps and selections on small hand-written cases, against plain Python where they rank or walk."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lineweave.functions import text as T
from lineweave.operators import chunk, pack, rank, select

SPAN = "scope string, source string, token_start bigint, token_end bigint, line_start int, line_end int, text string"


@pytest.mark.parametrize(
    "bad",
    [{"query": " "}, {"query": 3}, {"query": "q", "budget": 0}, {"query": "q", "budget": True}, {"query": "q", "prefix": -1}, {"query": "q", "strategy": "best"}, {"query": "q", "files": "a.py"}, {"query": "q", "include": [""]}, {"query": "q", "colour": 1}],
)
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        select.SelectRequest.of(bad)


def test_good_requests_and_other_settings():
    r = select.SelectRequest.of({"query": "q", "files": ["a.py:1-2"], "budget": 5})
    assert (r.budget, r.prefix, r.files, r.ranking.rrf_k) == (5, 128, ("a.py:1-2",), 60)
    assert select.TraceRequest("f").max_depth == 4
    for bad in (lambda: select.TraceRequest(""), lambda: select.TraceRequest("f", "up"), lambda: select.TraceRequest("f", max_depth=-1), lambda: select.Ranking(b=2.0), lambda: select.Ranking(bm25=False, lexical=False)):
        with pytest.raises(ValueError):
            bad()


def test_resolve_keeps_order_and_unites_ranges(spark):
    asked = [(1, 1, "b.py", 10, 20), (1, 2, "a.py", 5, None), (1, 3, "b.py", 21, 30), (1, 4, "b.py", 50, 60), (1, 5, "c.py", 1, 2), (1, 6, "c.py", None, None), (2, 1, "z.py", None, None)]
    r = spark.createDataFrame(asked, "request_id int, place int, path string, low int, high int")
    d = spark.createDataFrame([(1, "d.py"), (1, "a.py"), (1, "d.py"), (3, "x.py")], "request_id int, path string")
    got = [tuple(x)[1:] for x in select.resolve(r, d).orderBy("request_id", "place").collect() if x.request_id == 1]
    assert got == [(1, "b.py", 10, 30), (2, "b.py", 50, 60), (3, "a.py", 5, 5), (4, "c.py", None, None), (5, "d.py", None, None)]
    with pytest.raises(Exception, match="max_files"):
        select.resolve(r, d, 2).collect()
    assert select.resolve(r.limit(0), d.limit(0)).count() == 0


def test_reading_ranges_stops_at_the_first_overflow(spark):
    lines = spark.createDataFrame([("a.py", i, i) for i in range(1, 200)] + [("b.py", 1, 1)], "source string, line int, n_tokens int")
    r = spark.createDataFrame([(1, 1, "a.py", 1, 3), (1, 2, "a.py", 90, 92), (1, 3, "b.py", 1, 9), (2, 1, "b.py", 1, 1), (3, 1, "no.py", 1, 2)], "request_id int, place int, path string, low int, high int")
    got = {(x.request_id, x.place): (x.read_to, x.n_tokens, x.continue_at) for x in select.read_ranges(lines, r, 100).collect()}
    assert got == {(1, 1): (3, 7, None), (1, 2): (90, 91, 91), (1, 3): (None, 0, 1), (2, 1): (1, 2, None), (3, 1): (None, 0, None)}


def plain_map(defs, query, budget):
    asked = {p for w in query.split() for p in (w.lower(), *w.lower().split("_"))}
    rows = []
    for _, source, name, kind, a, b in set(defs):
        parts = set(name.lower().split("_"))
        place = f"{source}:{a}" if a == b else f"{source}:{a}-{b}"
        rows.append((-len(parts & asked) / (len(parts) + 1), place, kind, name))
    out, used = [], 3
    for _, place, kind, name in sorted(rows):
        line = f"{place}  {kind} {name}"
        if used + len(line.split()) <= budget:
            used += len(line.split())
            out.append(line)
    return out


def test_symbol_map_against_plain_python(spark):
    r = random.Random(2)
    words = ["load", "cache", "store", "key", "emit"]
    defs = [("s", f"f{r.randrange(9)}.py", "_".join(r.sample(words, r.randrange(1, 4))), r.choice(["function", "class"]), a, a + r.randrange(3)) for a in range(1, 80)]
    d = spark.createDataFrame(defs + defs[:5], "scope string, source string, name string, kind string, line_start int, line_end int").withColumn("place", F.lit("clash"))
    queries = [(1, "load cache", "s"), (2, "the emit", "s"), (3, "nothing here", "s"), (4, "load", "other"), (5, "load", None), (6, None, "s")]
    q = spark.createDataFrame(queries, "query_id int, query_text string, scope string")
    for budget in (3, 20, 100, 10_000):
        got = {}
        for x in select.symbol_map(d, q, budget).orderBy("query_id", "place").collect():
            got.setdefault(x.query_id, []).append(x.line)
        for i, text, scope in queries[:3]:
            assert got.get(i, []) == plain_map(defs, text, budget)
        assert 4 not in got and 5 not in got


def test_lists_and_groups(spark):
    items = [[("a", 7, 12), ("a", 13, 20), ("a", 1, 6), ("b", 1, 2), ("a", 21, 22), ("a", 40, 41)], []]
    df = spark.createDataFrame([(x,) for x in items], "x array<struct<source: string, low: int, high: int>>")
    assert [[tuple(i) for i in r.m] for r in df.select(select.merge_listed(F.col("x")).alias("m")).collect()] == [[("a", 1, 20), ("b", 1, 2), ("a", 21, 22), ("a", 40, 41)], []]
    s = spark.createDataFrame([("a", 0, 5, 1, 1), ("a", 5, 9, 2, 3), ("a", 10, 12, 5, 5), ("b", 12, 13, 1, 1)], "source string, char_start int, char_end int, line_start int, line_end int")
    assert sorted((x.source, x.line_start, x.line_end, x.n_spans) for x in select.lossless_groups(s).collect()) == [("a", 1, 3, 2), ("a", 5, 5, 1), ("b", 1, 1, 1)]
    rows = spark.createDataFrame([(1, "x", 2.5), (1, 'q"', None)], "k int, name string, v double")
    (c,) = select.compact(rows, "k", ["name", "v"]).collect()
    body = json.loads(c.body)
    assert body["columns"] == ["name", "v"] and len(body["rows"]) == 2


def make(spark, scope, source, texts):
    rows, at, line = [], 0, 1
    for t in texts:
        n = len(t.split())
        rows.append((scope, source, at, at + n, line, line, t))
        at, line = at + n, line + 1
    return rows


def test_selection_by_scope(spark):
    r = random.Random(4)
    vocabulary = ["ledger", "cache", "queue", "emit", "plan", "node"]
    words = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = make(spark, "small", "small/a.py", [words(5), words(6)])
    rows += make(spark, "one", "one/only.py", [words(20) for _ in range(20)])
    for f in range(4):
        rows += make(spark, "many", f"many/f{f}.py", [words(12) + (" special_name" if f == i == 2 else "") for i in range(8)])
    s = spark.createDataFrame(rows + rows[:3], SPAN)
    d = spark.createDataFrame([("special_name", "many/f2.py", 3, 3, ["helper"]), ("helper", "many/f0.py", 1, 1, [None, ""])], "name string, source string, line_start int, line_end int, refs array<string>")
    queries = [(1, "ledger cache", "small"), (2, "queue plan", "one"), (3, "special_name ledger", "many"), (4, "ledger", "nowhere"), (5, "ledger", None), (6, None, "many"), (7, "the of", "many")]
    q = spark.createDataFrame(queries, "query_id bigint, query_text string, scope string")
    got = {}
    for x in select.select_context(s, q, d, 100, 20, 20).orderBy("query_id", "position").collect():
        got.setdefault(x.query_id, []).append(x)
    assert set(got) == {1, 2, 3}
    assert [(x.route, x.part, x.start) for x in got[1]] == [("lossless", "all", 0), ("lossless", "all", 5)]
    assert [x.part for x in got[2]] == ["prefix", "recalled", "recalled", "recalled", "tail"] and sum(x.n_tokens for x in got[2]) == 100
    assert (got[2][0].start, got[2][-1].end) == (0, 400) and all(x.source == "one/only.py" for x in got[2])
    chosen = [(x.source, x.start) for x in got[3]]
    assert sum(x.n_tokens for x in got[3]) <= 100 and ("many/f2.py", 24) in chosen
    assert all(x.source.startswith("many/") for x in got[3])
    tight = {x.part for x in select.select_context(s, q.filter("query_id = 2"), d, 30, 20, 20).collect()}
    assert tight == {"recalled"}  # a window over the budget is dropped
    assert select.select_context(s.limit(0), q, d).count() == 0 == select.select_context(s, q.limit(0), d).count()


def test_packing_of_a_selection_equals_plain_python(spark):
    """The rows of ``pack`` are the walk of ``pack_by_coverage`` over the head of the fused ranking."""
    r = random.Random(9)
    vocabulary = ["ledger", "cache", "queue", "emit", "plan", "node", "seal"]
    rows = [x for f in range(5) for x in make(spark, "m", f"m/f{f}.py", [" ".join(r.choice(vocabulary) for _ in range(r.randrange(3, 15))) for _ in range(10)])]
    s = spark.createDataFrame(rows, SPAN)
    q = spark.createDataFrame([(1, "ledger cache"), (2, "seal plan emit")], "query_id bigint, query_text string")
    fused = rank.fused_top(s.drop("scope"), q).join(s, rank.SPAN)
    c = fused.select("query_id", "source", F.col("token_start").alias("start"), F.col("token_end").alias("end"), F.col("rrf").alias("rank_score"), "text", "line_start")
    got = {}
    for x in pack.pack(c, q, 60).orderBy("query_id", "position").collect():
        got.setdefault(x.query_id, []).append((x.source, x.start, x.end))
    for x in q.collect():
        mine = sorted((y for y in c.collect() if y.query_id == x.query_id), key=lambda y: (-y.rank_score, y.source, y.start, y.end))
        terms = lambda t: frozenset(t.split())
        spans = [pack.Span(y.source, y.start, y.end, y.rank_score, terms(y.text), (y.text,), y.line_start, parts=(i,)) for i, y in enumerate(mine)]
        assert got[x.query_id] == [(y.source, y.start, y.end) for y in pack.pack_by_coverage(spans, terms(x.query_text), 60)]


def test_receipts_name_content(spark):
    c = spark.createDataFrame([(1, "a", 0, 5, 5), (1, "a", 5, 9, 4), (1, "b", 0, 3, 3), (2, "a", 0, 5, 5)], "query_id bigint, source string, start bigint, end bigint, n_tokens bigint")
    kept = spark.createDataFrame([(1, "a", 0, 9, 9), (2, "a", 0, 5, 5)], c.schema)
    one, two = select.receipts(c, kept).orderBy("query_id").collect()
    assert (one.n_kept, one.n_dropped, one.kept_tokens, one.kept) == (1, 1, 9, ["a#tokens=0:9"]) and (two.n_dropped, len(two.receipt_id)) == (0, 64)
    assert select.receipts(c, kept).filter("query_id = 1").first().receipt_id == one.receipt_id != two.receipt_id
    before = spark.createDataFrame([("a", "1"), ("b", "2")], "source string, fingerprint string")
    more, changed = select.expand(spark.createDataFrame([(1, "q", 10)], "query_id bigint, query_text string, budget int"), before, before.filter("source = 'a'"), 5)
    assert more.first().budget == 15 and [tuple(x) for x in changed.collect()] == [("b", "removed")]
    assert T.provenance is not None and chunk is not None
