import json

import pytest

from lineweave.sources import records, workspace
from lineweave.streaming import usage


def test_workspace_scan(spark, tmp_path):
    files = {"src/a.py": b"x = 1\r\ny\r", "src/deep/b c+d.RS": "\ufefffn é()".encode(), "src/bad.txt": b"\xff\xfe", "src/nul.md": b"a\0b", ".hid/a.py": b"x", "node_modules/p/i.js": b"x", "big.md": b"x" * 300, "bin.exe": b"x", "build/x.py": b"x"}
    for p, b in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    got = {x.relative_path: x.text for x in workspace.read_workspace(spark, str(tmp_path), config=workspace.ScanConfig(max_bytes=200)).collect()}
    assert got == {"src/a.py": "x = 1\ny\n", "src/deep/b c+d.RS": "fn é()"}
    got = workspace.read_workspace(spark, str(tmp_path), ["src/*.py", "src/deep"]).collect()
    assert {x.relative_path for x in got} == {"src/a.py", "src/deep/b c+d.RS"}


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("**/*.py", "a.py", True), ("**/*.py", "x/y/a.py", True), ("*.py", "x/a.py", False), ("src/**", "src/a/b", True), ("a/**/b.c", "a/b.c", True), ("a/**/b.c", "a/x/y/b.c", True), ("x[ab].c", "xa.c", True), ("x?.c", "x/.c", False)],
)
def test_globs(pattern, path, hit):
    import re

    assert bool(re.search(workspace.glob_regex(pattern), path)) == hit


@pytest.mark.parametrize("pattern", ["", "/etc", "../x", "a/../../b", "C:/x"])
def test_patterns_stay_inside(pattern):
    with pytest.raises(ValueError):
        workspace.glob_regex(pattern)


def test_locators_and_missing(spark):
    df = spark.createDataFrame([("a.py:3-9",), ("b:c.py:7",), ("plain.py",)], "p string")
    assert [(x.path, x.low, x.high) for x in workspace.parse_locators(df, "p").collect()] == [("a.py", 3, 9), ("b:c.py", 7, 7), ("plain.py", None, None)]
    have = spark.createDataFrame([("x/a.py",), ("x/y/b.py",), ("z/b.py",)], "relative_path string")
    want = spark.createDataFrame([("x/a.py",), ("x/q/b.py",)], "relative_path string")
    there, gone = workspace.split_missing(want, have)
    assert [x[0] for x in there.collect()] == ["x/a.py"]
    assert [x.candidate for x in workspace.suggest(gone, have).orderBy("rank").collect()] == ["x/y/b.py", "z/b.py"]


def test_ledger_is_strict(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    p.write_text("\n".join(json.dumps({"ts": "2026-01-01", "tokens_in": v, "tokens_out": 1}) for v in [12, "12", True, -1, 1.5, None]) + "\n")
    assert [x.tokens_in for x in records.read_ledger(spark, str(p)).collect()] == [12, None, None, None, None, None]
    p.write_text('{"ts": "a"}\n[1]\n')
    with pytest.raises(Exception, match="bad ledger line"):
        records.read_ledger(spark, str(p)).collect()


def test_receipts_are_content_addressed(spark, tmp_path):
    r = records.with_ids(spark.createDataFrame([("a", 1), ("b", 2)], "q string, n int"), ["q", "n"])
    records.write_records(r, str(tmp_path / "r"))
    back = spark.read.schema(r.schema).json(str(tmp_path / "r"))
    assert records.verified(back, ["q", "n"]).count() == 2
    assert records.verified(back.withColumn("n", back.n + 1), ["q", "n"]).count() == 0
    assert records.content_hash({"b": 1, "a": 2}) == records.content_hash({"a": 2, "b": 1})
    assert records.check_name("a-b.1") == "a-b.1"
    with pytest.raises(ValueError):
        records.check_name("../x")


def test_streams(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2026, 1, 1)
    src, out = str(tmp_path / "e"), str(tmp_path / "o")
    schema = "ts timestamp, user_id bigint, event_type string, value double"
    for day in (0, 0, 1, 9, 1):  # the last is too late
        spark.createDataFrame([(t + timedelta(days=day), 1, "a", 1.0)], schema).coalesce(1).write.mode("append").parquet(src)
    q = usage.daily_usage(usage.event_stream(spark, src, schema)).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {str(x.day): x.calls for x in spark.read.parquet(out).collect()}
    assert got["2026-01-01"] == 2 and got["2026-01-02"] in (1, 2)
    idx = str(tmp_path / "idx")
    for n, fp in enumerate(["1", "1", "2"]):
        spark.createDataFrame([("a.py", fp)], "path string, fingerprint string").coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
        usage.index_changes(spark.readStream.schema("path string, fingerprint string").parquet(str(tmp_path / "f")), idx, str(tmp_path / f"c{n}")).awaitTermination()
    assert sorted(x.fingerprint for x in spark.read.parquet(idx).collect()) == ["1", "2"]
