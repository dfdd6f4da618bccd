import math
import random

from pyspark.sql import functions as F

from lineweave.operators import accounting, chunk, evalkit, graph, pack, rank, review, search, symbols
from lineweave.operators.chunk import chunk_text
from lineweave.operators.pack import Span, in_dependency_order, pack_by_coverage, pack_by_score, unite


def test_chunks_partition_the_text_and_respect_the_size():
    r = random.Random(3)
    for _ in range(80):
        text = "".join(" ".join("w" for _ in range(r.randrange(9))) + r.choice(["\n", "\n", "\n\n", ""]) for _ in range(r.randrange(30)))
        block = r.randrange(1, 20)
        out = list(chunk_text(text, block))
        assert "".join(c[6] for c in out) == text
        for a, b in zip(out, out[1:]):
            assert (a[1] + 1, a[3], a[5]) == (b[0], b[2], b[4])
        for c in out:
            assert c[5] - c[4] == len(c[6].split()) and (c[5] - c[4] <= block or c[0] == c[1] or c[6].rstrip("\n").count("\n") == 0 or len(c[6].split("\n", 1)[0].split()) == 0)
        # greedy: the first line of a block did not fit the block before
        for a, b in zip(out, out[1:]):
            assert a[5] - a[4] + len(b[6].split("\n")[0].split()) > block


def test_windows_and_ranges(spark):
    f = spark.createDataFrame([("a", "one two\nthree\n\nfour five six\n"), ("b", ""), ("c", "x")], "source string, text string")
    lines = chunk.lines(f)
    assert [(r.line, r.n_tokens) for r in lines.filter("source = 'a'").orderBy("line").collect()] == [(1, 2), (2, 1), (3, 0), (4, 3)]
    p = {r.source: (r.kept_lines, r.used_tokens, r.continue_at) for r in chunk.range_prefix(lines, 3).collect()}
    assert p == {"a": (3, 3, 4), "c": (1, 1, None)}
    r = spark.createDataFrame([("s", 1, 3), ("s", 4, 5), ("s", 8, 9), ("t", 2, 2), ("s", 2, 2)], "s string, low int, high int")
    assert sorted((x.s, x.low, x.high) for x in chunk.merge_ranges(r, ["s"], "low", "high").collect()) == [("s", 1, 5), ("s", 8, 9), ("t", 2, 2)]
    w = spark.createDataFrame([("k", i, 10) for i in range(10)], "k string, i int, n_tokens int")
    z = [x.zone for x in chunk.active_window(w, ["k"], F.col("i"), 15, 25).orderBy("i").collect()]
    assert z == ["prefix"] * 2 + ["middle"] * 5 + ["tail"] * 3
    assert {x.zone for x in chunk.active_window(w, ["k"], F.col("i"), 60, 40).collect()} == {"prefix"}
    got = chunk.sections(lines, spark.createDataFrame([("a", 2, 4)], "source string, low int, high int")).orderBy("line").collect()
    assert [(x.line, x.char_start) for x in got] == [(2, 8), (3, 14), (4, 15)]


def brute_coverage(ranked, query, budget):
    """Independent reading of the rule on spans that never overlap."""
    left, chosen, covered, used = list(range(len(ranked))), [], set(), 0
    while True:
        best = None
        for i in left:
            s = ranked[i]
            if used + s.tokens > budget or s.tokens == 0:
                continue
            new = (s.terms & query) - covered
            key = (int(s.named and i not in chosen), len(new) / s.tokens, len(new), s.source not in {ranked[c].source for c in chosen}, s.score, -i)
            if best is None or key > best[0]:
                best = (key, i)
        if best is None:
            return [ranked[i] for i in chosen]
        i = best[1]
        left.remove(i)
        chosen.append(i)
        covered |= ranked[i].terms & query
        used += ranked[i].tokens


def test_packers_against_brute_force():
    r = random.Random(5)
    for _ in range(100):
        query = frozenset("abcdef")
        spans = [Span(r.choice("xyz"), 1000 * i, 1000 * i + r.randrange(1, 60), r.choice([0.1, 0.2, 0.3]), frozenset(r.sample("abcdefgh", 3)), named=r.random() < 0.2) for i in range(12)]
        spans.sort(key=lambda s: (-s.score, s.source, s.start))
        budget = r.randrange(20, 200)
        assert pack_by_coverage(spans, query, budget) == brute_coverage(spans, query, budget)
        kept = pack_by_score(spans, budget)
        assert sum(s.tokens for s in kept) <= budget
        used = 0
        for s in spans:
            assert (s in kept) == (used + s.tokens <= budget)
            used += s.tokens if s in kept else 0


def test_overlaps_are_united_only_where_the_lines_agree():
    line = lambda n: tuple(f"l{i}\n" for i in n)
    a = Span("s", 0, 30, 0.5, frozenset("a"), line(range(1, 4)), 1, parts=(1,))
    b = Span("s", 20, 50, 0.4, frozenset("b"), line(range(3, 6)), 3, parts=(2,))
    u = unite(a, b)
    assert (u.start, u.end, u.line_start, u.lines) == (0, 50, 1, line(range(1, 6))) == (unite(b, a).start, 50, 1, u.lines)
    assert unite(a, Span("s", 20, 50, 0.4, frozenset(), ("other\n",), 3)) is None and unite(a, Span("s", 20, 50, 0.4, frozenset())) is None
    assert [(s.start, s.end) for s in pack_by_coverage([a, b], frozenset("ab"), 50)] == [(0, 50)]


def test_definitions_come_before_their_users():
    n = lambda name, *needs: Span("s", 0, 1, 0, frozenset(), names=frozenset([name]), needs=frozenset(needs))
    a, b, c, d, e = n("a", "b"), n("b", "c"), n("c"), n("d", "e"), n("e", "d")
    assert in_dependency_order([a, b, c]) == [c, b, a]
    assert in_dependency_order([d, a, e, b, c]) == [c, b, a, d, e]


def test_pack_runs_per_query_with_nulls_and_ties(spark):
    c = spark.createDataFrame([(1, "a", 0, 10, 0.5, "stale socket", None), (1, "b", 0, 10, 0.5, None, 1), (1, "a", 5, 12, 0.4, "socket", None), (2, "a", 0, 900, 1.0, "x", None)], "query_id bigint, source string, start bigint, end bigint, rank_score double, text string, line_start int")
    q = spark.createDataFrame([(1, "stale socket"), (2, "x y"), (3, None)], "query_id bigint, query_text string")
    got = pack.pack(c.fillna({"text": ""}), q, 100).collect()
    assert [(r.query_id, r.source, r.start) for r in sorted(got, key=lambda r: r.position)] == [(1, "a", 0), (1, "b", 0)]


def test_bm25_against_the_formula_and_fusion(spark):
    docs = {"a": "idle plugin collector", "b": "idle window", "c": "the plugin plugin", "d": "nothing here"}
    s = spark.createDataFrame([(k, 0, len(v.split()), v) for k, v in docs.items()], "source string, token_start int, token_end int, text string")
    q = spark.createDataFrame([(1, "idle plugin"), (2, "absent"), (3, "")], "query_id int, query_text string")
    terms = {"a": {"idle", "plugin", "collector"}, "b": {"idle", "window"}, "c": {"plugin"}, "d": {"nothing", "here"}}
    avg = sum(map(len, terms.values())) / 4
    want = {}
    for k, t in terms.items():
        x = sum(math.log(1 + (4 - 2 + 0.5) / (2 + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in ("idle", "plugin") if w in t)
        if x:
            want[k] = round(x, 9)
    got = rank.bm25(s, q)
    assert {r.source: round(r.score, 9) for r in got.collect()} == want
    best = rank.bm25(s, q, top_k=2).collect()
    assert sorted((r.source, round(r.score, 9)) for r in best) == sorted(sorted(want.items(), key=lambda x: (-x[1], x[0]))[:2])
    f = rank.fuse({"bm25": got, "lexical": rank.lexical_coverage(s, q)}).orderBy(F.col("rrf").desc()).collect()
    assert f[0].source == "a" and round(f[0].rrf, 9) == round(2 / 61, 9) and f[0].selection_reasons == ["bm25", "lexical"]


def test_pagerank_and_closure_against_brute_force(spark):
    r = random.Random(7)
    nodes = [f"n{i}" for i in range(25)]
    edges = {(a, b) for a in nodes[:20] for b in r.sample(nodes, 2) if a != b}
    seed = {n: r.random() for n in nodes}
    total = sum(seed.values())
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    now = {n: v / total for n, v in seed.items()}
    for _ in range(12):
        new = {n: 0.15 * seed[n] / total for n in nodes}
        for n in nodes:
            for m in out[n] or nodes:
                new[m] += 0.85 * now[n] / len(out[n] or nodes)
        now = new
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    got = graph.pagerank(spark.createDataFrame(sorted(seed.items()), "node string, score double"), e)
    assert all(abs(x["rank"] - now[x.node]) < 1e-9 for x in got.collect())
    depth, frontier = {"n0": 0}, {"n0"}
    for d in range(1, 4):
        frontier = {b for a in frontier for b in out[a]} - depth.keys()
        depth |= {n: d for n in frontier}
    roots = spark.createDataFrame([("n0",), ("n0",)], "node string")
    assert {x.node: x.depth for x in graph.closure(roots, e, 3).collect()} == depth


PY = '''import os.path as p
LIMIT = 3

class Store:
    def load(self, key, *rest, deep=False):
        return p.join(key, LIMIT)

@wrap
async def main(): await Store().load("k")
'''


def test_symbols_usages_and_owners(spark):
    f = spark.createDataFrame([("a.py", PY), ("b.rs", "pub struct Gc {\n x: u8 }\nimpl Gc {\n  pub fn run(&self) { sweep() }\n}\n"), ("c.md", "Store"), ("bad.py", "def (")], "source string, text string")
    s = symbols.parse_symbols(f)
    got = {(x.source, x.name, x.kind, x.line_start, x.line_end) for x in s.collect()}
    assert {("a.py", "Store", "class", 4, 6), ("a.py", "load", "function", 5, 6), ("a.py", "main", "function", 9, 9), ("a.py", "LIMIT", "variable", 2, 2), ("a.py", "p", "import", 1, 1), ("b.rs", "Gc", "struct", 1, 2), ("b.rs", "Gc", "impl", 3, 5), ("b.rs", "run", "function", 4, 4)} <= got
    load = next(x for x in s.collect() if x.name == "load")
    assert load.defines == ["deep", "key", "load", "rest", "self"] and {"LIMIT", "join", "p"} <= set(load.refs)
    d = s.filter("not is_import")
    u = search.find_usages(chunk.lines(f), d, "Store").collect()
    assert [(x.source, x.line, x.role, x.within) for x in u] == [("a.py", 4, "definition", "class Store"), ("a.py", 9, "usage", "function main"), ("c.md", 1, "usage", "(module level)")]
    q = spark.createDataFrame([(1, "Gc"), (2, "load the store")], "query_id int, query_text string")
    r = search.find_symbols(d, q).collect()
    assert [(x.name, x.kind) for x in sorted(r, key=lambda x: x["rank"]) if x.query_id == 1] == [("Gc", "struct"), ("Gc", "impl")]
    assert {x.name for x in r if x.query_id == 2} == {"Store", "load"}


def test_diff_and_review(spark):
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n a\n@@ -9 +10 @@\n-b\n+c\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n"
    h = review.parse_diff(spark.createDataFrame([(1, diff), (2, "")], "diff_id int, text string"))
    assert sorted((x.path, x.start, x.len) for x in h.collect()) == [("x.py", 1, 3), ("x.py", 10, 1)]
    d = spark.createDataFrame([("x.py", "Outer", 1, 20, ["g"]), ("x.py", "inner", 9, 11, []), ("x.py", "far", 30, 40, ["inner"])], "source string, name string, line_start int, line_end int, refs array<string>")
    t = review.innermost(review.touched(d, h.filter("start = 10")))
    assert [x.name for x in t.collect()] == ["inner"]
    c = review.callers_of(d, t)
    assert [x.name for x in c.collect()] == ["far"]
    p = review.pack_review(t.withColumns({"n_tokens": F.lit(5), "review_id": F.lit(1)}), c.withColumns({"n_tokens": F.lit(50), "review_id": F.lit(1)}), 20).collect()
    assert [(x.role, x.name) for x in p] == [("changed", "inner")]


def test_accounting_and_evaluation(spark):
    rows = [("2026-01-01T00:00:00Z", 10, 4, 1), ("2026-01-01T01:00:00Z", None, 4, None), ("2026-01-02T00:00:00Z", 0, 0, 2), (None, 5, 9, 0)]
    l = spark.createDataFrame(rows, "ts string, tokens_in bigint, tokens_out bigint, round_trips_saved int")
    s = {x.day: x for x in accounting.ledger_summary(l, price_per_million=2.0).collect()}
    assert s[None].calls == 4 and s[None].tokens_in is None and s[None].tokens_out == 17 and s[None].usd is None and s[None].round_trips_saved == 3
    assert s["2026-01-02"].reduction is None and s["unknown"].tokens_saved == -4 and s["2026-01-01"].unmeasured == 1
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "source string, fingerprint string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("w", "4")], "source string, fingerprint string")
    assert {(x.source, x.change) for x in accounting.drift(a, b).collect()} == {("y", "changed"), ("w", "added")}
    assert {x.source for x in accounting.stale(a, b).collect()} == {"y", "z"}
    q = spark.createDataFrame([(1, "who calls the parser"), (2, "How many files are there"), (3, "x"), (4, "where is stale socket"), (5, None)], "i int, q string")
    assert [x.c for x in q.select(accounting.query_class(F.col("q")).alias("c")).collect()] == ["trace", "aggregation", "unknown", "localized", "unknown"]
    assert evalkit.bootstrap([1.0] * 5, 100) == (1.0, 1.0, 1.0) and evalkit.bootstrap([]) == (0.0, 0.0, 0.0)
    low, high, _ = evalkit.bootstrap([0.0, 1.0] * 10, 500)
    assert 0.2 < low < 0.5 < high < 0.8
