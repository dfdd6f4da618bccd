"""Traces, reviews, diffs and scans on small hand-written cases."""

import pytest
from pyspark.sql import functions as F

from lineweave.operators import evalkit, review, symbols, trace
from lineweave.sources import workspace

DEFS = "name string, kind string, source string, line_start int, line_end int, defines array<string>, refs array<string>, ordinal bigint, n_tokens bigint"


@pytest.fixture(scope="module")
def defs(spark):
    rows = [
        ("root", "function", "a.py", 1, 5, ["root", "rows"], ["a", "b", None, ""], 1, 10),
        ("a", "function", "a.py", 7, 9, ["a"], ["b"], 2, 20),
        ("b", "function", "b.py", 1, 3, ["b"], ["x", "b"], 3, 30),
        ("x", "variable", "b.py", 5, 5, ["x", "y"], ["deep"], 4, 5),
        ("deep", "function", "c.py", 1, 2, ["deep"], None, 5, 7),
        ("lone", "function", "c.py", 9, 9, ["lone"], ["rows"], 6, 1),
        ("a", "function", "a.py", 7, 9, ["a"], ["b"], 7, 20),
        ("rows", "function", None, None, None, None, None, 8, 1),
    ]
    return spark.createDataFrame(rows, DEFS).withColumn("depth", F.lit("clash"))


def found(result):
    return {(x.source, x.name): x.depth for x in result[0].collect()}, result[1]


def test_trace_by_depth_and_direction(spark, defs):
    roots = spark.createDataFrame([("root",), ("root",), (None,)], "name string")
    d = defs.filter("source is not null").drop("depth")
    assert found(trace.trace(d, roots, 1)) == ({("a.py", "root"): 0, ("a.py", "a"): 1, ("b.py", "b"): 1}, True)
    whole = {("a.py", "root"): 0, ("a.py", "a"): 1, ("b.py", "b"): 1, ("b.py", "x"): 2, ("c.py", "deep"): 3}
    assert found(trace.trace(d, roots, 3)) == (whole, False) == found(trace.trace(d, roots, 9))
    y = spark.createDataFrame([("y",)], "name string")
    assert found(trace.trace(d, y))[0] == {("b.py", "x"): 0, ("c.py", "deep"): 1}
    deep = spark.createDataFrame([("deep",)], "name string")
    assert found(trace.trace(d, deep, 2, "callers")) == ({("c.py", "deep"): 0, ("b.py", "x"): 1, ("b.py", "b"): 2}, True)
    assert found(trace.trace(d, spark.createDataFrame([("no",)], "name string"))) == ({}, False) == found(trace.trace(d.limit(0), roots))
    for bad in ({"max_depth": -1}, {"direction": "up"}):
        with pytest.raises(ValueError):
            trace.trace(d, roots, **bad)
    (s,) = trace.summary(*trace.trace(d, roots, 1), d, 50).collect()
    assert (s.definitions, s.tokens, s.depth, s.index_definitions, s.index_tokens, s.truncated_by_depth, s.over_budget, s.token_reduction) == (3, 60, 1, 6, 73, True, True, 0.1781)
    assert [(x.name) for x in trace.pack_trace(trace.trace(d, roots, 3)[0], 59).orderBy("source", "line_start").collect()] == ["root", "a"]


def test_qualified_names_and_sections(spark):
    d = spark.createDataFrame([("Outer", "m/p.py", 1, 20, 0, 200), ("run", "m/p.py", 3, 5, 20, 60), ("run", "m/q.py", 3, 5, 20, 60), ("run", "m/p.py", 30, 31, 300, 320)], "name string, source string, line_start int, line_end int, char_start int, char_end int")
    names = spark.createDataFrame([("Outer::run",), ("p.Outer.run",), ("q.run",), ("run",), ("X::run",), ("p.run",)], "full string")
    got = {(x.full, x.source, x.line_start) for x in trace.qualified(d, names).collect()}
    assert got == {("Outer::run", "m/p.py", 3), ("p.Outer.run", "m/p.py", 3), ("q.run", "m/q.py", 3), ("p.run", "m/p.py", 30)}
    r = spark.createDataFrame([("m/p.py", 2, 25, 10)], "source string, low int, high int, base int")
    assert [(x.name, x.line_start, x.char_start, x.char_end) for x in trace.section_definitions(d, r).collect()] == [("run", 3, 10, 50)]
    files = trace.first_files(spark.createDataFrame([(1, "z.py")], "query_id int, path string"), spark.createDataFrame([(1, "a.py", 1), (1, "z.py", 2), (1, "b.py", 3), (1, "c.py", 4)], "query_id int, path string, rank int"))
    assert [(x.place, x.path, x.named) for x in files.orderBy("place").collect()] == [(1, "z.py", True), (2, "a.py", False), (3, "b.py", False)]


def test_diffs(spark):
    quoted = 'diff --git a/x b/x\n--- "a/caf\\303\\251.py"\n+++ "b/caf\\303\\251.py"\n@@ -1,2 +3,2 @@ def f\n-old\n+++ not a path\n same\n@@ -9 +9,0 @@\n-gone\n'
    plain = "--- a/d.py\n+++ /dev/null\n@@ -1,3 +0,0 @@\n-x\n-y\n-z\n--- a/e f.py\t2020\n+++ b/e f.py\t2020\n@@ -5 +7 @@\n-a\n+b\n"
    d = spark.createDataFrame([(1, quoted), (2, plain), (3, None), (4, "")], "diff_id bigint, text string")
    got = sorted(tuple(x) for x in review.parse_diff(d).collect())
    assert got == [(1, "café.py", 3, 2), (1, "café.py", 9, 0), (2, "e f.py", 7, 1)]


def test_review_of_several_changes(spark):
    d = spark.createDataFrame(
        [("A", "class", "m.py", 1, 40, ["g"], 90), ("f", "method", "m.py", 5, 9, ["g"], 20), ("g", "function", "n.py", 1, 4, [], 10), ("h", "function", "n.py", 6, 9, ["f"], 30), ("k", "function", "o.py", 1, 9, ["f", None], 5)],
        "name string, kind string, source string, line_start int, line_end int, refs array<string>, n_tokens bigint",
    )
    hunks = spark.createDataFrame([(1, "m.py", 6, 1), (2, "n.py", 2, 0), (3, "zzz.py", 1, 1)], "review_id bigint, path string, start int, len int")
    rows = [(x.review_id, x.role, x.name) for x in review.review_context(hunks, d, 40).collect()]
    assert sorted(rows) == [(1, "caller", "k"), (1, "changed", "f"), (2, "caller", "f"), (2, "changed", "g")]
    text = review.render_review([x.asDict() for x in review.review_context(hunks, d, 60).collect() if x.review_id == 1])
    assert text.index("m.py:5-9 f") < text.index("o.py:1-9 k") < text.index("n.py:6-9 h") and review.render_review([]) == ""
    assert [x.name for x in review.innermost(d.drop("refs")).collect()].count("A") == 0
    assert review.review_context(hunks.limit(0), d).count() == 0


def test_bootstrap_draws_like_the_generator_and_passes():
    import random

    values = [0.0, 1.0, 1.0, -1.0, 0.5]
    r = random.Random(0)
    means = sorted(sum(values[r.randrange(5)] for _ in range(5)) / 5 for _ in range(10_000))
    assert evalkit.bootstrap(values) == (round(means[250], 4), round(means[9750], 4), 0.3)


def test_python_symbols_of_decorated_and_nested_targets():
    text = "@cache\ndef f(a, *b, c=1, **d):\n    return g.h(a)\nx, y = 1, 2\nz.w = 3\nk: int = v\n"
    got = {(r[0], r[2]): (r[1], r[4], r[5]) for r in symbols.python_symbols(text)}
    assert got[("f", 2)] == ("function", ["a", "b", "c", "d", "f"], ["cache", "g", "h"])
    assert [k for k in got if got[k][0] == "variable"] == [("<assignment>", 4), ("<assignment>", 5), ("k", 6)]


def test_scan_keeps_the_newest_delivery(spark):
    rows = [("a.py", 5, 1), ("a.py", 7, 2), ("a.py", 7, 2), ("b.py", None, 1), ("c.bin", 1, 1)]
    f = spark.createDataFrame(rows, "relative_path string, size_bytes bigint, t int").withColumn("ingested_at", F.timestamp_seconds("t"))
    assert sorted((x.relative_path, x.size_bytes) for x in workspace.discover(f).collect()) == [("a.py", 7), ("b.py", None)]
