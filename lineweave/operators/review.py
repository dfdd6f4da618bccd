"""Reviewing a change: unified diffs, touched definitions, their callers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.plans.durable import durable

_HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_DIFFED = "diff_id {kind}, path string, start int, len int"
_ESCAPE = re.compile(rb"\\([abtnvfr\"\\]|[0-7]{1,3})")
_PLAIN = {b"a": b"\a", b"b": b"\b", b"t": b"\t", b"n": b"\n", b"v": b"\v", b"f": b"\f", b"r": b"\r", b'"': b'"', b"\\": b"\\"}


def new_path(line: str) -> str | None:
    """The path of a ``+++`` line; quoted paths have their escapes undone. None for a deleted file."""
    name = line[4:]
    if name.startswith('"'):
        raw = name[1 : name.rindex('"')].encode()
        name = _ESCAPE.sub(lambda m: _PLAIN.get(m[1]) or bytes([int(m[1], 8)]), raw).decode("utf-8", "replace")
    else:
        name = name.split("\t")[0].rstrip("\r")
    if name == "/dev/null":
        return None
    return name[2:] if name.startswith("b/") else name


def diff_hunks(text: str) -> list[tuple[str, int, int]]:
    """(path, first line, lines) of the new side of each hunk. A hunk's own lines are counted off, so an added line ``++ x`` is no path."""
    out, path, old, new = [], None, 0, 0
    for line in text.split("\n"):
        if (old > 0 or new > 0) and line[:1] in (" ", "-", "+", "\\", ""):
            old -= line[:1] in (" ", "-", "")
            new -= line[:1] in (" ", "+", "")
        elif line.startswith("+++ "):
            path = new_path(line)
        elif m := _HUNK.match(line):
            old, new = (int(x) if x is not None else 1 for x in (m[1], m[3]))
            if path is not None:
                out.append((path, int(m[2]), new))
    return out


def parse_diff(diffs: DataFrame) -> DataFrame:
    """``diff_id, path, start, len`` of the new side's hunks of unified diffs (diff_id, text). Deleted files and renames without a hunk give no row."""
    kind = diffs.schema["diff_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [diff_hunks(t) if t else [] for t in b.column(1).to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            rows = list(zip(*(h for f in found for h in f))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *(pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int32(), pa.int32())))], names=["diff_id", "path", "start", "len"])

    return diffs.select("diff_id", "text").mapInArrow(run, _DIFFED.format(kind=kind.simpleString()))


def _binned(df: DataFrame, low: Column, high: Column, bin_lines: int = 64) -> DataFrame:
    return df.withColumn("__bin", F.explode(F.sequence(F.floor(low / bin_lines), F.floor(F.greatest(high, low) / bin_lines))))


def touched(definitions: DataFrame, hunks: DataFrame) -> DataFrame:
    """Definitions (source, line_start, line_end, ...) that overlap a hunk (path, start, len), once each."""
    last = F.col("start") + F.greatest(F.col("len") - 1, F.lit(0))
    h = _binned(hunks.select("path", "start", last.alias("stop")).distinct(), F.col("start"), F.col("stop")).withColumnRenamed("__bin", "h_bin")
    d = _binned(definitions, F.col("line_start"), F.col("line_end"))
    hit = (F.col("source") == F.col("path")) & (F.col("__bin") == F.col("h_bin")) & (F.col("line_start") <= F.col("stop")) & (F.col("line_end") >= F.col("start"))
    return d.join(h, hit, "left_semi").drop("__bin").distinct()


def innermost(definitions: DataFrame) -> DataFrame:
    """Definitions that hold no other of the given definitions. An inner definition is looked for by the bin of its first line."""
    i = definitions.select(F.col("source").alias("i_source"), F.col("line_start").alias("i_start"), F.col("line_end").alias("i_end"), F.floor(F.col("line_start") / 64).alias("i_bin")).distinct()
    d = _binned(definitions.distinct(), F.col("line_start"), F.col("line_end"))
    holds = (F.col("source") == F.col("i_source")) & (F.col("__bin") == F.col("i_bin")) & (F.col("line_start") <= F.col("i_start")) & (F.col("line_end") >= F.col("i_end"))
    real = (F.col("line_start") != F.col("i_start")) | (F.col("line_end") != F.col("i_end"))
    outer = d.join(i, holds & real, "left_semi").drop("__bin").distinct()
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in definitions.columns]
    return definitions.distinct().alias("a").join(outer.alias("b"), on, "left_anti")


def callers_of(definitions: DataFrame, changed: DataFrame) -> DataFrame:
    """Definitions (with ``refs``) that refer to the name of a changed one, without the changed themselves."""
    uses = definitions.select("source", "name", "line_start", "line_end", F.explode("refs").alias("ref"))
    names = changed.select(F.col("name").alias("ref")).distinct()
    x = uses.join(names, "ref", "left_semi").select("source", "name", "line_start", "line_end").distinct()
    return x.join(changed.select("source", "name", "line_start").distinct(), ["source", "name", "line_start"], "left_anti")


def pack_review(changed: DataFrame, impacted: DataFrame, budget: int) -> DataFrame:
    """Of each review (review_id) the changed definitions in order, then the callers from the smallest, as far as its budget goes:
    ``review_id, role, source, name, line_start, line_end, n_tokens``.

    What overflows is passed over. A definition over the budget by itself can't be kept and is left out before the walk; the walk is one fold a review.
    """
    keep = ["review_id", "source", "name", "line_start", "line_end", "n_tokens"]
    a = changed.select(F.lit(0).alias("o"), F.lit(0).cast("bigint").alias("size"), F.lit("changed").alias("role"), *keep)
    b = impacted.select(F.lit(1).alias("o"), F.col("n_tokens").cast("bigint").alias("size"), F.lit("caller").alias("role"), *keep)
    x = a.unionByName(b).filter(F.col("n_tokens") <= budget).groupBy("review_id").agg(
        F.array_sort(F.collect_list(F.struct("o", "size", "source", "line_start", "line_end", "name", "role", F.col("n_tokens").cast("bigint").alias("n_tokens")))).alias("x")
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.slice("x", 1, 0).alias("kept"))
    fold = F.aggregate("x", zero, lambda s, i: F.when(s["used"] + i["n_tokens"] <= budget, F.struct((s["used"] + i["n_tokens"]).alias("used"), F.concat(s["kept"], F.array(i)).alias("kept"))).otherwise(s), lambda s: s["kept"])
    return x.select("review_id", F.explode(fold).alias("i")).select("review_id", "i.role", *[f"i.{c}" for c in keep[1:]])


def review_context(hunks: DataFrame, definitions: DataFrame, budget: int = 6000) -> DataFrame:
    """Of each review (hunks: review_id, path, start, len) the innermost definitions that it touches and those that refer to them, packed.

    ``definitions`` has ``source, name, kind, line_start, line_end, refs, n_tokens``. Callers are followed one step; a review's own changes are no callers.
    """
    d = definitions.select("source", "name", "kind", "line_start", "line_end", "refs", "n_tokens").dropDuplicates(["source", "name", "line_start", "line_end"])
    last = F.col("start") + F.greatest(F.col("len") - 1, F.lit(0))
    h = _binned(hunks.select("review_id", "path", "start", last.alias("stop")).distinct(), F.col("start"), F.col("stop")).withColumnRenamed("__bin", "h_bin")
    spans = _binned(d.select("source", "name", "line_start", "line_end", "n_tokens"), F.col("line_start"), F.col("line_end"))
    hit = (F.col("source") == F.col("path")) & (F.col("__bin") == F.col("h_bin")) & (F.col("line_start") <= F.col("stop")) & (F.col("line_end") >= F.col("start"))
    t = durable(spans.join(h, hit).select("review_id", "source", "name", "line_start", "line_end", "n_tokens").distinct(), "review-touched")
    i = t.select(F.col("review_id").alias("i_review"), F.col("source").alias("i_source"), F.col("line_start").alias("i_start"), F.col("line_end").alias("i_end"))
    holds = (F.col("review_id") == F.col("i_review")) & (F.col("source") == F.col("i_source")) & (F.col("line_start") <= F.col("i_start")) & (F.col("line_end") >= F.col("i_end"))
    real = (F.col("line_start") != F.col("i_start")) | (F.col("line_end") != F.col("i_end"))
    inner = durable(t.join(i, holds & real, "left_anti"), "review-inner")
    uses = d.select("source", "name", "line_start", "line_end", "n_tokens", F.explode(F.array_distinct("refs")).alias("ref"))
    calls = uses.join(inner.select("review_id", F.col("name").alias("ref")).distinct(), "ref").drop("ref").distinct()
    key = ["review_id", "source", "name", "line_start"]
    return pack_review(inner, calls.join(inner.select(*key), key, "left_anti"), budget)


def render_review(rows: list[dict]) -> str:
    """Packed rows of one review as text: a heading a part, a line a definition."""
    out = []
    for role, title in (("changed", "## Changed definitions"), ("caller", "## Definitions that refer to them")):
        part = [r for r in rows if r["role"] == role]
        if part:
            out += [title, *(f"- {r['source']}:{r['line_start']}-{r['line_end']} {r['name']} ({r['n_tokens']} tokens)" for r in part), ""]
    return "\n".join(out)
