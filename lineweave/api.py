"""One object with the verbs of the engine over a workspace's files. Each verb returns a DataFrame, or a result with advice in words."""

from __future__ import annotations

import json
import platform
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.functions import text as T
from lineweave.operators import accounting, chunk, review, search, select, symbols, trace
from lineweave.plans.durable import durable
from lineweave.sources import git, records
from lineweave.sources.workspace import ScanConfig, included, read_workspace


@dataclass
class Answer:
    """Rows of a verb and what to do next, in words."""

    rows: DataFrame
    advice: list[str] = field(default_factory=list)


class Engine:
    """The verbs over ``files`` (source, text). ``redact`` changes texts before anything reads them."""

    def __init__(self, files: DataFrame, redact: Callable | None = None):
        self.spark: SparkSession = files.sparkSession
        x = files.filter("text is not null").select("source", "text").dropDuplicates(["source"])
        if redact:
            x = x.withColumn("text", redact(F.col("text")))
        self.files = durable(x.withColumn("fingerprint", F.sha2("text", 256)), "engine-files")
        self._symbols: DataFrame | None = None

    @classmethod
    def of_folder(cls, spark: SparkSession, root: str, patterns: list[str] | None = None, config: ScanConfig = ScanConfig()) -> Engine:
        return cls(read_workspace(spark, root, patterns, config).withColumnRenamed("relative_path", "source"))

    @property
    def symbols(self) -> DataFrame:
        if self._symbols is None:
            s = symbols.parse_symbols(self.files)
            self._symbols = durable(s, "engine-symbols")
        return self._symbols

    @property
    def definitions(self) -> DataFrame:
        return self.symbols.filter("not is_import")

    def _one(self, query: str, scope: str | None = None) -> DataFrame:
        return self.spark.createDataFrame([(0, query, scope)], "query_id bigint, query_text string, scope string")

    def within(self, include: list[str] | None) -> tuple[DataFrame, str | None]:
        """The files of a scope; if it matches nothing, all of them and a note."""
        if not include:
            return self.files, None
        some = self.files.filter(included(F.col("source"), include))
        return (self.files, f"no file matches {include}; all files were searched") if some.isEmpty() else (some, None)

    def find_files(self, query: str, include: list[str] | None = None, top_k: int = 30) -> Answer:
        f, note = self.within(include)
        listing = f.select(F.col("source").alias("path"))
        if not query.strip():
            return Answer(listing.orderBy("path").limit(top_k), [note] if note else [])
        found = search.find_files(listing, self._one(query), top_k).drop("query_id")
        advice = ["no path holds a word of the query; try find_evidence for words within files"] if found.isEmpty() else []
        return Answer(found, [*([note] if note else []), *advice])

    def find_symbols(self, query: str, kinds: list[str] | None = None, top_k: int = 30) -> Answer:
        found = search.find_symbols(self.definitions, self._one(query), kinds, top_k).drop("query_id")
        if not found.isEmpty():
            return Answer(found)
        if kinds and not search.find_symbols(self.definitions, self._one(query), None, 1).isEmpty():
            return Answer(found, [f"definitions exist, but none of kind {kinds}"])
        return Answer(found, ["no definition has such a name; try find_usages or find_evidence"])

    def find_usages(self, name: str, top_k: int = 30) -> Answer:
        found = search.find_usages(chunk.lines(self.files), self.definitions, name, top_k + 1)
        n = found.count()
        return Answer(found.limit(top_k), [f"more than {top_k} lines use {name}"] if n > top_k else [] if n else [f"no line uses {name}"])

    def find_evidence(self, query: str, include: list[str] | None = None, top_k: int = 30) -> Answer:
        f, note = self.within(include)
        q = self._one(query)
        d = self.definitions.select("name", "kind", "source", "line_start", "line_end", F.col("ordinal").cast("bigint").alias("ordinal"), "refs")
        hits = search.evidence_hits(f, chunk.lines(f), q, d, top_k).drop("query_id")
        terms = [r.term for r in search.evidence_terms(q).select("term").distinct().collect()]  # words of one query
        folded = T.casefold(F.col("text"))
        have = f.agg(*[F.coalesce(F.bool_or(F.contains(folded, F.lit(t))), F.lit(False)).alias(f"t{i}") for i, t in enumerate(terms)] or [F.lit(True).alias("t")]).first()
        absent = sorted(t for t, h in zip(terms, have) if not h)
        return Answer(hits, [*([note] if note else []), *([f"no file holds: {', '.join(absent)}"] if absent else [])])

    def _spans(self, files: DataFrame, block: int) -> DataFrame:
        s = chunk.chunk_lines(files, block)
        return s.select(F.lit("all").alias("scope"), "source", F.col("token_start").cast("bigint").alias("token_start"), F.col("token_end").cast("bigint").alias("token_end"), "line_start", "line_end", "text")

    def select_context(self, request: select.SelectRequest) -> Answer:
        """The selected spans of the request's scope with their texts."""
        f, note = self._scope(request)
        spans = durable(self._spans(f, request.block), "engine-spans")
        chosen = select.select_context(spans, self._one(request.query, "all"), self.definitions, request.budget, request.prefix, request.tail, request.strategy, max(request.ranking.top_k, 64))
        return Answer(chosen.drop("query_id"), [note] if note else [])

    def _scope(self, request: select.SelectRequest) -> tuple[DataFrame, str | None]:
        if not request.files:
            return self.within(list(request.include))
        paths = [p.rsplit(":", 1)[0] if p.rsplit(":", 1)[-1].replace("-", "").isdigit() else p for p in request.files]
        some = self.files.filter(F.col("source").isin(paths))
        missing = sorted(set(paths) - {r.source for r in some.select("source").collect()})  # at most the files asked for
        return some, f"missing files: {', '.join(missing)}" if missing else None

    def search_code(self, query: str, budget: int = 1500) -> Answer:
        """Context out of the three files that the query names or that bear on it most."""
        q = self._one(query)
        named = trace.named_paths(q, self.files.select(F.col("source").alias("path")))
        hits = self.find_evidence(query).rows.groupBy("source").agg(F.min("rank").alias("rank")).select(F.lit(0).cast("bigint").alias("query_id"), F.col("source").alias("path"), "rank")
        first = [r.path for r in trace.first_files(named, hits).orderBy("place").collect()]  # three rows
        if not first:
            return Answer(self.files.select("source").limit(0), ["nothing bears on the query; name an identifier or a path"])
        return self.select_context(select.SelectRequest(query, budget, 0, 0, files=tuple(first)))

    def read_code(self, ranges: list[str], budget: int = 1500) -> Answer:
        """Whole lines of ``path:first-last`` in order, up to the budget, and where to continue."""
        r = self.spark.createDataFrame([(0, n, p) for n, p in enumerate(ranges, 1)], "request_id int, place int, locator string")
        from lineweave.sources.workspace import parse_locators

        r = parse_locators(r, "locator").withColumns({"low": F.coalesce("low", F.lit(1)), "high": F.coalesce("high", F.lit(1_000_000))})
        x = select.read_ranges(chunk.lines(self.files), r.select("request_id", "place", "path", "low", "high"), budget)
        more = [f"{t.path}:{t.continue_at}-{t.high}" for t in x.filter("continue_at is not null").orderBy("place").collect()]  # the ranges asked for
        return Answer(x.drop("request_id"), [f"continue with {', '.join(more)}"] if more else [])

    def trace_dependencies(self, request: select.TraceRequest) -> Answer:
        sizes = self.symbols.select("source", "name", "kind", "line_start", "line_end", "defines", "refs", F.col("ordinal").cast("bigint").alias("ordinal"), (F.col("line_end") - F.col("line_start") + 1).cast("bigint").alias("n_tokens"))
        found, more = trace.trace(sizes, self.spark.createDataFrame([(request.symbol,)], "name string"), request.max_depth, request.direction)
        return Answer(found, ["the trace goes on beyond max_depth"] if more else [])

    def review_context(self, diff: str, budget: int = 6000) -> Answer:
        h = review.parse_diff(self.spark.createDataFrame([(0, diff)], "diff_id bigint, text string")).withColumnRenamed("diff_id", "review_id")
        d = self.definitions.withColumn("n_tokens", (F.col("line_end") - F.col("line_start") + 1).cast("bigint"))
        return Answer(review.review_context(h, d, budget).drop("review_id"))

    def review_change(self, root: str, **which) -> Answer:
        return self.review_context(git.read_change(root, **which).diff)

    def classify(self, query: str) -> str:
        return self._one(query).select(accounting.query_class(F.col("query_text")).alias("c")).first().c

    def save_pack(self, folder: str, name: str, request: select.SelectRequest) -> dict:
        """Select and keep the result under a name, with the fingerprints of its sources."""
        rows = self.select_context(request).rows.orderBy("position").collect()  # within the budget
        texts = {(r.source, r.token_start): r.text for r in self._spans(self.files, request.block).join(self.spark.createDataFrame([(r.source, r.start) for r in rows] or [("", 0)], "source string, token_start bigint"), ["source", "token_start"]).collect()}
        prints = {r.source: r.fingerprint for r in self.files.filter(F.col("source").isin(sorted({r.source for r in rows}))).select("source", "fingerprint").collect()}
        context = "\n".join(texts.get((r.source, r.start), "").strip("\n") for r in rows)
        pack = records.build_pack(name, request.query, {"budget": request.budget, "strategy": request.strategy}, context, prints, [{"source": r.source, "start": r.start, "end": r.end, "n_tokens": r.n_tokens} for r in rows])
        Path(folder).mkdir(parents=True, exist_ok=True)
        (Path(folder) / f"{name}.json").write_text(records.pack_text(pack), encoding="utf-8", newline="\n")
        return pack

    def run_pack(self, folder: str, name: str) -> tuple[dict, list[str]]:
        """A saved pack and the sources that have changed since or can't be read."""
        pack = records.check_pack(json.loads((Path(folder) / f"{records.check_name(name)}.json").read_text(encoding="utf-8")))
        saved = self.spark.createDataFrame(sorted(pack["fingerprints"].items()) or [("", "")], "source string, fingerprint string").filter("source <> ''")
        return pack, sorted(r.source for r in accounting.stale(saved, self.files.select("source", "fingerprint")).collect())


def doctor(spark: SparkSession) -> dict:
    """Does the engine work here? Each check runs on a text of its own and reports pass or the kind of error, never its words."""
    checks = {}
    text = "def probe(a):\n    return helper(a)\n\n\ndef helper(b):\n    return b\n"

    def run(name: str, f: Callable[[], bool]) -> None:
        try:
            checks[name] = "pass" if f() else "fail"
        except Exception as e:  # a diagnosis reports every failure
            checks[name] = f"fail ({type(e).__name__})"

    engine = Engine(spark.createDataFrame([("probe.py", text)], "source string, text string"))
    run("symbols", lambda: engine.find_symbols("helper").rows.count() == 1)
    run("usages", lambda: engine.find_usages("helper").rows.count() == 2)
    run("trace", lambda: engine.trace_dependencies(select.TraceRequest("probe")).rows.count() == 2)
    run("selection", lambda: engine.select_context(select.SelectRequest("helper", 100)).rows.count() >= 1)
    run("lines", lambda: engine.files.select(F.size(T.physical_lines(F.col("text"))).alias("n")).first().n == 6)
    return {"ok": all(c == "pass" for c in checks.values()), "checks": checks, "runtime": {"python": platform.python_version(), "pyspark": pyspark.__version__}}
