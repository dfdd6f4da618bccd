"""The verbs as one object, git trees, stores, packs, records and trials on small cases."""

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from lineweave.api import Engine, doctor
from lineweave.operators import graph, select, trials
from lineweave.sources import git, records
from lineweave.sources.cache import Store

FILES = {
    "app/store.py": "import os\n\nclass Store:\n    def load_key(self, key):\n        return read_disk(key)\n\n\ndef read_disk(key):\n    return os.open(key)\n",
    "app/main.py": "from app.store import Store\n\n\ndef main():\n    store = Store()\n    return store.load_key('a')\n",
    "docs/notes.md": "The store keeps keys on disk.\nEvict idle keys when the timer stops.\n",
}


@pytest.fixture(scope="module")
def engine(spark):
    rows = [*FILES.items(), ("app/store.py", FILES["app/store.py"]), ("bin/none.py", None)]
    return Engine(spark.createDataFrame(rows, "source string, text string").withColumn("extra", F.lit(1)))


def test_finding(engine):
    assert engine.find_files("store").rows.first().path == "app/store.py"
    assert engine.find_files("zebra").advice and [r.path for r in engine.find_files(" ").rows.collect()] == sorted(FILES)
    assert engine.find_files("notes", ["nowhere/**"]).advice[0].startswith("no file matches")
    assert [(r.name, r.source) for r in engine.find_symbols("read_disk").rows.collect()] == [("read_disk", "app/store.py")]
    assert "none of kind" in engine.find_symbols("read_disk", ["class"]).advice[0] and engine.find_symbols("zebra").advice
    u = engine.find_usages("load_key")
    assert [(r.source, r.line, r.role) for r in u.rows.collect()] == [("app/store.py", 4, "definition"), ("app/main.py", 6, "usage")] and not u.advice
    assert engine.find_usages("load_key", 1).advice[0].startswith("more than 1") and engine.find_usages("zebra").advice
    e = engine.find_evidence("what evicts idle zebra keys")
    assert "docs/notes.md" in {r.source for r in e.rows.collect()} and "zebra" in e.advice[0]


def test_reading_and_selecting(engine):
    whole = engine.select_context(select.SelectRequest("load key", 1000))
    assert {r.route for r in whole.rows.collect()} == {"lossless"}
    some = engine.select_context(select.SelectRequest("load key", 12, 0, 0, block=8, files=("app/store.py", "gone.py:1-2")))
    assert "gone.py" in some.advice[0] and {r.source for r in some.rows.collect()} == {"app/store.py"} and sum(r.n_tokens for r in some.rows.collect()) <= 12
    r = engine.read_code(["app/store.py:3-5", "docs/notes.md:1-2"], 11)
    assert r.advice == ["continue with docs/notes.md:1-2"] and engine.read_code(["docs/notes.md"], 500).advice == []
    assert {x.source for x in engine.search_code("what is in docs/notes.md about timer", 200).rows.collect()} >= {"docs/notes.md"}
    assert engine.search_code("zebra").advice


def test_tracing_and_reviewing(engine):
    t = engine.trace_dependencies(select.TraceRequest("main", max_depth=1))
    assert {r.name for r in t.rows.collect()} >= {"main", "Store", "load_key"} and t.advice
    diff = "--- a/app/store.py\n+++ b/app/store.py\n@@ -9 +9 @@\n-x\n+    return os.open(key)\n"
    assert {(r.role, r.name) for r in engine.review_context(diff).rows.collect()} == {("changed", "read_disk"), ("caller", "load_key"), ("caller", "Store")}
    assert engine.classify("what depends on read_disk and who calls it") == "trace"


def test_packs(engine, tmp_path):
    engine.save_pack(str(tmp_path), "mine", select.SelectRequest("load key", 1000))
    pack, stale = engine.run_pack(str(tmp_path), "mine")
    assert stale == [] and "class Store" in pack["context"] and pack["sources"] == sorted(FILES)
    spark = engine.spark
    changed = Engine(spark.createDataFrame([("app/store.py", "x"), ("docs/notes.md", FILES["docs/notes.md"])], "source string, text string"))
    assert changed.run_pack(str(tmp_path), "mine")[1] == ["app/main.py", "app/store.py"]
    path = tmp_path / "mine.json"
    body = json.loads(path.read_text())
    path.write_text(json.dumps(body | {"context": "other"}))
    with pytest.raises(ValueError, match="changed"):
        engine.run_pack(str(tmp_path), "mine")
    for bad in ({"version": 2}, {"name": "a/b"}, {"sources": ["q"]}, {"fingerprints": {"../x": "0" * 64}, "sources": ["../x"]}, {"fingerprints": {"x": "zz"}, "sources": ["x"]}):
        with pytest.raises(ValueError):
            records.check_pack(body | bad)
    redacted = Engine(spark.createDataFrame([("a.py", "key = 1")], "source string, text string"), lambda c: F.regexp_replace(c, r"\d", "*"))
    assert redacted.files.first().text == "key = *"


def test_doctor_and_texts(spark):
    assert doctor(spark)["ok"]
    assert records.render_report([]).startswith("No usage")
    days = [{"day": None, "calls": 3, "unmeasured": 1, "tokens_in": None, "tokens_out": 1200, "tokens_saved": None, "reduction": None}, {"day": "2026-01-01", "calls": 3, "tokens_saved": None}]
    assert "2/3" in records.render_report(days) and "1,200" in records.render_report(days) and "unknown" in records.render_report(days)
    receipt = {"id": "x", "query": "q", "route": "selected", "token_count": 5, "budget": 9, "kept": [{"provenance": "a:1-2", "n_tokens": 5}], "dropped": []}
    assert "| 1 | `a:1-2` | 5 |" in records.render_receipt(receipt) and "Dropped (0)" in records.render_receipt(receipt)
    chosen = spark.createDataFrame([(1, "q" * 200, "selected", "a", 5), (1, "q" * 200, "selected", "b", 7)], "query_id int, query_text string, route string, source string, n_tokens bigint")
    (row,) = records.ledger_entry(chosen, spark.createDataFrame([(1, 100, 4)], "query_id int, tokens_in bigint, files_scanned int"), "select").collect()
    assert (row.tokens_out, row.tokens_saved, row.round_trips_saved, len(row.query)) == (12, 88, 3, 160)


def test_git_trees_and_changes(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.test", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text("x = 1\r\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.py").write_text("no")
    (tmp_path / "c.py").write_bytes(b"\xff\xfe")
    (tmp_path / "d.bin").write_text("no")
    (tmp_path / "l.py").symlink_to("a.py")
    run("add", "-A")
    run("commit", "-q", "-m", "one")
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    assert "+y = 2" in git.read_change(tmp_path).diff
    run("add", "-A")
    staged = git.read_change(tmp_path, staged=True)
    assert staged.kind == "index" and [(r.relative_path, r.text) for r in git.tree_files(spark, tmp_path, staged.tree).collect()] == [("a.py", "x = 1\ny = 2\n")]
    run("commit", "-q", "-m", "two")
    change = git.read_change(tmp_path, ref_range="HEAD~1..HEAD")
    assert "+y = 2" in change.diff and git.range_commits(tmp_path, "HEAD~1...HEAD") == git.range_commits(tmp_path, "HEAD~1..HEAD")
    assert [r.text for r in git.tree_files(spark, tmp_path, "HEAD~1", ["*.py"]).collect()] == ["x = 1\n"]
    for bad in ({"staged": True, "diff": "x"}, {"ref_range": "nope..HEAD"}, {"ref_range": "HEAD"}, {"ref_range": "--all..HEAD"}):
        with pytest.raises(ValueError):
            git.read_change(tmp_path, **bad)


def test_store_computes_each_content_once(spark, tmp_path):
    calls = []

    def lengths(files):
        calls.append(sorted(r.source for r in files.collect()))
        return files.filter("text <> ''").select("source", "fingerprint", F.length("text").alias("n"))

    f = spark.createDataFrame([("a", "1", "xx"), ("b", "2", "yyy"), ("c", "3", "")], "source string, fingerprint string, text string")
    store = Store(spark, str(tmp_path), "v1", "n int")
    assert sorted((r.source, r.n) for r in store.through(f, lengths).collect()) == [("a", 2), ("b", 3)]
    assert sorted((r.source, r.n) for r in Store(spark, str(tmp_path), "v1", "n int").through(f, lengths).collect()) == [("a", 2), ("b", 3)]
    newer = f.withColumn("fingerprint", F.when(F.col("source") == "b", "9").otherwise(F.col("fingerprint")))
    assert store.through(newer, lengths).count() == 2 and calls == [["a", "b", "c"], ["b"]]
    assert Store(spark, str(tmp_path), "v2", "n int").rows().count() == 0 == Store(spark, str(tmp_path), "v1", "n string").rows().count()
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path), "a/b", "n int")


def test_gate_and_stratified_intervals(spark):
    r = random.Random(3)
    pairs = [(r.randrange(2), r.randrange(2), 0, r.randrange(2), float(r.randrange(10, 60)), float(r.randrange(50, 150))) for _ in range(30)]
    rng = random.Random(trials.SEED)
    diffs = sorted(sum(p[0] - p[1] for p in s) / 30 for s in ([pairs[rng.randrange(30)] for _ in range(30)] for _ in range(500)))
    got = trials.gate(pairs, 500)
    at = 499 * 0.025
    assert got["low"] == pytest.approx(diffs[int(at)] + (diffs[int(at) + 1] - diffs[int(at)]) * (at - int(at)))
    assert got["tokens"] and got["saving"] and got["errs"] and got["passes"] == (got["supports"] and got["accuracy"])
    assert trials.gate([(1, 1, 0, 0, 5.0, 0.0)], 10)["ratio_high"] is None and not trials.gate([])["passes"]
    schema = "arm string, k int, supported_a int, supported_b int, errors_a int, errors_b int, tokens_a double, tokens_b double"
    rows = spark.createDataFrame([("x", i, *p) for i, p in enumerate(pairs)] + [("y", 1, 1, 1, 0, 0, None, 5.0), ("z", 1, 1, 1, 0, 0, 1.0, 5.0), ("z", 1, 1, 1, 0, 0, 1.0, 5.0)], schema)
    out = {x.arm: x for x in trials.paired_gate(rows, ["arm"], "k", 500).collect()}
    assert out["x"].low == got["low"] and out["x"].n == 30 and not out["y"].passes and not out["z"].passes
    now, then = {("c", 1): [(50.0, True)] * 4, ("c", 2): [(1.0, False)]}, {("c", 1): [(100.0, False)] * 4}
    assert trials.stratified(now, then, 50) == {"tokens": (-0.5, -0.5, -0.5), "right": (1.0, 1.0, 1.0)} and trials.stratified({}, then) == {}


def test_packers_that_stop_and_clip(spark):
    x = spark.createDataFrame([("a", i, n) for i, n in enumerate([4, 5, 3, 1])] + [("b", 0, 50)], "k string, i int, n int")
    keep = lambda **w: sorted((r.k, r.i, r.n_tokens) for r in trials.pack_until(x, ["k"], [F.col("i")], F.col("n"), 10, **w).collect())
    assert keep() == [("a", 0, 4), ("a", 1, 5)] and keep(clip=True) == [("a", 0, 4), ("a", 1, 5), ("a", 2, 1), ("b", 0, 10)]
    t = spark.createDataFrame([("one two  three", 2), ("one  two", 5), ("a b", 0)], "t string, n int").select(trials.clipped(F.col("t"), F.col("n")).alias("c"))
    assert [r.c for r in t.collect()] == ["one two", "one  two", ""]
    usage = "prompt_tokens int, completion_tokens int, input_tokens int, output_tokens int, cache_read_input_tokens int, cache_creation_input_tokens int"
    u = spark.createDataFrame([((10, 2, None, None, None, None),), ((None, None, 5, 3, 4, None),)], f"u struct<{usage.replace(' int', ': int')}>").select(trials.provider_usage(F.col("u")).alias("x"))
    assert [(r.x.input, r.x.output) for r in u.collect()] == [(10, 2), (9, 3)]


def test_weighted_rank_against_plain_python(spark):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("a", "b", 1.0), ("b", "c", 5.0), ("c", "a", 0.0)]
    seed = {"a": 1.0, "b": 2.0, "c": 1.0, "d": 0.0}
    start = {n: v / 4 for n, v in seed.items()}
    out = {"a": {"b": 0.75, "c": 0.25}, "b": {"c": 1.0}}
    rank = dict(start)
    for _ in range(12):
        idle = sum(rank[n] for n in rank if n not in out)
        rank = {n: 0.15 * start[n] + 0.85 * idle * start[n] + 0.85 * sum(rank[s] * t.get(n, 0.0) for s, t in out.items()) for n in rank}
    got = graph.weighted_pagerank(spark.createDataFrame(list(seed.items()), "node string, score double"), spark.createDataFrame(edges, "src string, dst string, weight double"))
    assert {r.node: r["rank"] for r in got.collect()} == pytest.approx(rank)
