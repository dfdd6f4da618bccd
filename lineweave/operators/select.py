"""Selecting context end to end: requests, scopes, lossless answers, the active window, ranges, maps, receipts and packs."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineweave.functions import text as T
from lineweave.operators import chunk, pack, rank
from lineweave.plans.durable import durable


def _whole(value: object, name: str, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be a whole number of at least {least}")
    return value


def _texts(value: object, name: str) -> tuple[str, ...]:
    if not isinstance(value, (list, tuple)) or not all(isinstance(x, str) and x.strip() for x in value):
        raise ValueError(f"{name} must be a list of non-empty strings")
    return tuple(value)


@dataclass(frozen=True)
class Ranking:
    """What ranks: top k, the constant of the fusion, BM25's parameters, and which signals take part."""

    top_k: int = 8
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75
    bm25: bool = True
    lexical: bool = True

    def __post_init__(self) -> None:
        _whole(self.top_k, "top_k", 1)
        _whole(self.rrf_k, "rrf_k", 0)
        if self.k1 < 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 must be at least 0 and b between 0 and 1")
        if not (self.bm25 or self.lexical):
            raise ValueError("at least one signal is needed")


@dataclass(frozen=True)
class SelectRequest:
    """A request for context: budget and window in tokens, the packing strategy, and the scope as files, ranges and patterns."""

    query: str
    budget: int = 3000
    prefix: int = 128
    tail: int = 128
    strategy: str = "coverage"
    block: int = 400
    files: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_files: int = 100
    ranking: Ranking = field(default_factory=Ranking)

    def __post_init__(self) -> None:
        if not isinstance(self.query, str) or not self.query.strip():
            raise ValueError("query must be a non-empty string")
        for name, least in (("budget", 1), ("prefix", 0), ("tail", 0), ("block", 1), ("max_files", 1)):
            _whole(getattr(self, name), name, least)
        if self.strategy not in ("coverage", "score"):
            raise ValueError("strategy must be coverage or score")
        for name in ("files", "include", "exclude"):
            object.__setattr__(self, name, _texts(getattr(self, name), name))

    @classmethod
    def of(cls, payload: dict) -> SelectRequest:
        unknown = set(payload) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        return cls(**payload)


@dataclass(frozen=True)
class TraceRequest:
    """A request for a trace: the name, direction, depth and budget."""

    symbol: str
    direction: str = "dependencies"
    max_depth: int = 4
    budget: int = 4000

    def __post_init__(self) -> None:
        if not isinstance(self.symbol, str) or not self.symbol.strip():
            raise ValueError("symbol must be a non-empty string")
        if self.direction not in ("dependencies", "callers"):
            raise ValueError("direction must be dependencies or callers")
        _whole(self.max_depth, "max_depth", 0)
        _whole(self.budget, "budget", 1)


def resolve(requested: DataFrame, discovered: DataFrame, max_files: int = 100) -> DataFrame:
    """``request_id, place, path, low, high`` of each request: the files asked for (request_id, place, path, low, high) in their order, touching ranges of
    one file united, a whole file dominating its ranges, then the discovered files (request_id, path) by path. Ranges are null for whole files.

    A request of more than ``max_files`` files raises when the result is computed.
    """
    key = ["request_id", "path"]
    asked = requested.groupBy(*key).agg(F.min("place").alias("place"), F.bool_or(F.col("low").isNull()).alias("whole"))
    ranges = chunk.merge_ranges(requested.filter("low is not null").withColumn("high", F.coalesce("high", "low")).select(*key, "low", "high"), key, "low", "high")
    explicit = asked.join(ranges.withColumnsRenamed({"low": "l", "high": "h"}), key, "left")
    explicit = explicit.select(*key, F.lit(0).alias("tier"), "place", F.when(~F.col("whole"), F.col("l")).alias("low"), F.when(~F.col("whole"), F.col("h")).alias("high")).distinct()
    more = discovered.select(*key).distinct().join(asked.select(*key), key, "left_anti").select(*key, F.lit(1).alias("tier"), F.lit(0).alias("place"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    x = explicit.unionByName(more)
    n = x.select(*key).distinct().groupBy("request_id").agg(F.count("*").alias("n"))
    x = x.join(n, "request_id")
    w = Window.partitionBy("request_id").orderBy("tier", "place", "path", F.col("low").asc_nulls_first())
    fits = F.when(F.col("n") <= max_files, F.row_number().over(w)).otherwise(F.raise_error(F.concat(F.lit("a request resolved more files than max_files: "), F.col("n"))))
    return x.select("request_id", fits.alias("place"), "path", "low", "high")


def read_ranges(line_rows: DataFrame, ranges: DataFrame, budget: int, bin_lines: int = 64) -> DataFrame:
    """Whole lines of each request's ranges (request_id, place, path, low, high) in order, up to the first line that overflows the budget:
    ``request_id, place, path, low, high, read_to, n_tokens, continue_at``; ``continue_at`` is the first line of a range that was not read, null if all was.

    A line costs its white-space tokens, a range one more for its label. ``high`` may lie beyond the file's end.
    """
    r = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / bin_lines), F.floor(F.col("high") / bin_lines))))
    x = line_rows.select(F.col("source").alias("path"), "line", F.col("n_tokens").cast("bigint").alias("t"), F.floor(F.col("line") / bin_lines).alias("bin"))
    x = r.join(x, ["path", "bin"]).filter(F.col("line").between(F.col("low"), F.col("high")))
    cost = F.col("t") + F.when(F.col("line") == F.col("low"), 1).otherwise(0)
    w = Window.partitionBy("request_id").orderBy("place", "line")
    x = x.withColumn("used", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("fits", F.max(F.col("used") > budget).over(w.rowsBetween(Window.unboundedPreceding, 0)) == F.lit(False))
    got = x.groupBy("request_id", "place").agg(F.max(F.when(F.col("fits"), F.col("line"))).alias("read_to"), F.coalesce(F.sum(F.when(F.col("fits"), cost)), F.lit(0)).alias("n_tokens"), F.min(F.when(~F.col("fits"), F.col("line"))).alias("continue_at"))
    return ranges.join(got, ["request_id", "place"], "left").select("request_id", "place", "path", "low", "high", "read_to", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "continue_at")


def symbol_map(definitions: DataFrame, queries: DataFrame, budget: int) -> DataFrame:
    """``query_id, place, line, cost`` of the map of definitions (scope, source, name, kind, line_start, line_end) of each question's scope: lines ranked by
    the share of name parts that the question holds, then by provenance; a line that overflows the budget is passed over.

    Definitions with no shared part follow in order of provenance, so only as many of them as the budget can hold are kept of each scope before the walk:
    every line costs at least three tokens. Questions without a scope give no row.
    """
    heading, least = 3, 3
    most = max(1, budget // least)
    place = T.provenance(F.col("source"), F.col("line_start"), F.col("line_end"))
    d = definitions.select("scope", "name", "kind", place.alias("place"), T.identifier_terms(F.array("name")).alias("parts")).distinct()
    first = d.withColumn("n", F.row_number().over(Window.partitionBy("scope").orderBy("place", "kind", "name"))).filter(F.col("n") <= most).drop("n")
    q = queries.filter("scope is not null").select("query_id", "scope", F.array_distinct(F.concat(T.identifier_terms(F.split("query_text", r"\s+")), F.transform(F.split("query_text", r"\s+"), T.casefold))).alias("asked"))
    by_part = d.withColumn("part", F.explode(F.array_distinct("parts"))).join(q.select("query_id", "scope", F.explode("asked").alias("part")), ["scope", "part"])
    shared = by_part.groupBy("query_id", "place", "kind", "name", "parts").agg(F.count_distinct("part").alias("m"))
    shared = shared.select("query_id", "place", "kind", "name", (F.col("m") / (F.size(F.array_distinct("parts")) + 1)).alias("score"))
    rest = q.select("query_id", "scope").join(first, "scope").select("query_id", "place", "kind", "name", F.lit(0.0).alias("score"))
    x = shared.unionByName(rest).groupBy("query_id", "place", "kind", "name").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "place", "kind", "name")
    x = x.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    line = F.concat_ws(" ", F.concat("place", F.lit(" ")), "kind", "name")
    items = x.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line"), T.token_count(line).cast("bigint").alias("cost")))).alias("x"))
    zero = F.struct(F.lit(heading).cast("bigint").alias("used"), F.slice("x", 1, 0).alias("kept"))
    fold = F.aggregate("x", zero, lambda a, i: F.when(a["used"] + i["cost"] <= budget, F.struct((a["used"] + i["cost"]).alias("used"), F.concat(a["kept"], F.array(i)).alias("kept"))).otherwise(a), lambda a: a["kept"])
    return items.select("query_id", F.posexplode(fold).alias("place", "i")).select("query_id", (F.col("place") + 1).alias("place"), "i.line", "i.cost")


def lossless_groups(spans: DataFrame) -> DataFrame:
    """Runs of spans (source, char_start, char_end, line_start, line_end) where each begins where the one before ends:
    ``source, line_start, line_end, char_start, char_end, n_spans``."""
    w = Window.partitionBy("source").orderBy("char_start", "char_end")
    x = spans.withColumn("__new", F.when(F.lag("char_end").over(w) == F.col("char_start"), 0).otherwise(1))
    x = x.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("source", "__run").agg(*[f(c).alias(c) for c, f in (("line_start", F.min), ("line_end", F.max), ("char_start", F.min), ("char_end", F.max))], F.count("*").alias("n_spans")).drop("__run")


def merge_listed(items: Column) -> Column:
    """Neighbours of a list of structs (source, low, high) that are of one source and touch or overlap, in either direction, as one; the list's order stays."""

    def add(done: Column, i: Column) -> Column:
        last = F.element_at(done, -1)
        touching = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["source"] == i["source"]) & (i["low"] <= F.try_element_at(done, F.lit(-1))["high"] + 1) & (i["high"] + 1 >= F.try_element_at(done, F.lit(-1))["low"])
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["source"].alias("source"), F.least(last["low"], i["low"]).alias("low"), F.greatest(last["high"], i["high"]).alias("high"))
        return F.when(touching, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(i)))

    return F.aggregate(items, F.slice(items, 1, 0), add)


def without(candidates: DataFrame, taken: DataFrame) -> DataFrame:
    """Candidates (query_id, source, start, end) that overlap none of the spans taken already (same columns)."""
    t = taken.select(F.col("query_id").alias("t_query"), F.col("source").alias("t_source"), F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    hit = (F.col("query_id") == F.col("t_query")) & (F.col("source") == F.col("t_source")) & (F.col("start") < F.col("t_end")) & (F.col("t_start") < F.col("end"))
    return candidates.join(t, hit, "left_anti")


def select_context(spans: DataFrame, queries: DataFrame, definitions: DataFrame, budget: int = 3000, prefix: int = 128, tail: int = 128, strategy: str = "coverage", k: int = 64) -> DataFrame:
    """The context of each question (query_id, query_text, scope) out of the spans of its scope (scope, source, token_start, token_end, line_start, line_end,
    text): ``query_id, route, position, part, source, start, end, n_tokens, n_united``.

    A scope within the budget is given whole (route ``lossless``, in the order of source and place). Else BM25 and coverage rank the scope's spans by
    reciprocal rank fusion and ``k`` of them are packed. Where the scope is one file, its first ``prefix`` and last ``tail`` tokens are kept in any case
    (part ``prefix`` and ``tail``) and the rest of the budget goes to the middle; a window over the budget is dropped. Definitions within a span give the
    names it holds and needs, so that what a question names comes first and definitions stand before what uses them.

    Collection statistics of BM25 are those of all spans. Scopes are summed by source before they meet questions. Questions without a scope or terms have
    no selected route; null texts count as empty.
    """
    s = spans.select("scope", *rank.SPAN, "line_start", "line_end", F.coalesce("text", F.lit("")).alias("text"), (F.col("token_end") - F.col("token_start")).cast("bigint").alias("n_tokens"))
    s = durable(s.dropDuplicates(["scope", *rank.SPAN]), "select-spans")
    sizes = s.groupBy("scope", "source").agg(F.sum("n_tokens").alias("t")).groupBy("scope").agg(F.sum("t").alias("total"), F.count("*").alias("sources"))
    q = queries.filter("scope is not null").select("query_id", "query_text", "scope").join(sizes, "scope")
    q = durable(q, "select-queries")
    whole, part = q.filter(F.col("total") <= budget), q.filter(F.col("total") > budget)
    out = ["query_id", "route", "position", "part", "source", "start", "end", "n_tokens", "n_united"]
    order = Window.partitionBy("query_id").orderBy(*rank.SPAN)
    lossless = whole.select("query_id", "scope").join(s, "scope").select("query_id", F.lit("lossless").alias("route"), F.row_number().over(order).alias("position"), F.lit("all").alias("part"), "source", F.col("token_start").alias("start"), F.col("token_end").alias("end"), "n_tokens", F.lit(1).alias("n_united"))

    ranked = rank.fused_top(s, part, k).join(s, rank.SPAN)
    ranked = ranked.select("query_id", "source", F.col("token_start").alias("start"), F.col("token_end").alias("end"), F.col("rrf").alias("rank_score"), "text", "line_start", "line_end")
    single = part.filter("sources = 1")
    zoned = chunk.active_window(s.join(single.select("scope").distinct(), "scope", "left_semi"), ["scope"], F.col("token_start"), prefix, tail)
    window = single.select("query_id", "scope").join(zoned.filter("zone <> 'middle'"), "scope")
    held = window.groupBy("query_id").agg(F.sum("n_tokens").alias("held")).filter(F.col("held") <= budget)
    window = durable(window.join(held, "query_id").select("query_id", F.lit("selected").alias("route"), "zone", "source", F.col("token_start").alias("start"), F.col("token_end").alias("end"), "n_tokens", "held"), "select-window")
    ranked = durable(without(ranked, window), "select-ranked")
    named = with_definitions(ranked, definitions, part)
    left = part.select("query_id", "query_text").join(held, "query_id", "left").select("query_id", "query_text", (F.lit(budget) - F.coalesce("held", F.lit(0))).alias("budget"))
    packed = pack.pack(named, left, budget, "coverage" if strategy == "coverage" else "score", k)
    recalled = packed.select("query_id", F.lit("selected").alias("route"), F.col("position").cast("bigint").alias("o"), F.lit("recalled").alias("part"), "source", "start", "end", "n_tokens", "n_united", F.lit(1).alias("tier"))
    kept = window.select("query_id", "route", F.col("start").alias("o"), F.col("zone").alias("part"), "source", "start", "end", "n_tokens", F.lit(1).alias("n_united"), F.when(F.col("zone") == "prefix", 0).otherwise(2).alias("tier"))
    x = recalled.unionByName(kept).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "o")))
    return x.select(*out).unionByName(lossless.select(*out))


def with_definitions(candidates: DataFrame, definitions: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates with ``names`` that are defined within their lines, ``needs`` that these definitions refer to, and whether the question names one."""
    d = definitions.select(F.col("source").alias("d_source"), F.col("name").alias("d_name"), F.col("line_start").alias("ls"), F.col("line_end").alias("le"), "refs")
    inside = (F.col("source") == F.col("d_source")) & (F.col("ls") >= F.col("line_start")) & (F.col("le") <= F.col("line_end"))
    found = candidates.select("query_id", "source", "start", "end", "line_start", "line_end").join(d, inside)
    clean = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    found = found.groupBy("query_id", "source", "start", "end").agg(F.collect_set("d_name").alias("names"), F.array_distinct(F.flatten(F.collect_list(clean(F.col("refs"))))).alias("needs"))
    words = queries.select("query_id", F.regexp_extract_all("query_text", F.lit("([A-Za-z0-9_]+)"), 1).alias("words"))
    x = candidates.join(found, ["query_id", "source", "start", "end"], "left").join(words, "query_id", "left")
    none = F.array().cast("array<string>")
    x = x.withColumns({"names": F.coalesce("names", none), "needs": F.coalesce("needs", none)})
    return x.withColumn("named", F.coalesce(F.arrays_overlap("names", "words"), F.lit(False))).drop("words")


def receipts(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """Of each question what was kept and what dropped, and a name made of the content: ``query_id, n_kept, n_dropped, kept_tokens, kept, receipt_id``.

    ``candidates`` and ``selected`` have ``query_id, source, start, end, n_tokens``; a candidate within a selected span of its source is kept. The name is
    the SHA-256 of the question's identifier and the kept spans in order, so equal selections have equal names.
    """
    c = candidates.select(F.col("query_id").alias("c_query"), F.col("source").alias("c_source"), F.col("start").alias("c_start"), F.col("end").alias("c_end")).distinct()
    within = (F.col("c_query") == F.col("query_id")) & (F.col("c_source") == F.col("source")) & (F.col("start") <= F.col("c_start")) & (F.col("c_end") <= F.col("end"))
    dropped = c.join(selected, within, "left_anti").groupBy(F.col("c_query").alias("query_id")).agg(F.count("*").alias("n_dropped"))
    span = F.concat("source", F.lit("#tokens="), F.col("start").cast("string"), F.lit(":"), F.col("end").cast("string"))
    kept = selected.groupBy("query_id").agg(F.count("*").alias("n_kept"), F.sum("n_tokens").alias("kept_tokens"), F.array_sort(F.collect_list(span)).alias("kept"))
    x = kept.join(dropped, "query_id", "left").withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0)))
    return x.withColumn("receipt_id", F.sha2(F.concat_ws("\n", F.col("query_id").cast("string"), F.array_join("kept", "\n")), 256))


def expand(receipt: DataFrame, before: DataFrame, now: DataFrame, extra: int) -> tuple[DataFrame, DataFrame]:
    """What a repeated selection needs: the questions of a receipt (query_id, query_text, budget) with ``extra`` tokens more, and the sources whose fingerprint
    has changed since."""
    from lineweave.operators.accounting import drift

    _whole(extra, "extra", 1)
    return receipt.select("query_id", "query_text", (F.col("budget") + extra).alias("budget")), drift(before, now)


def response(candidates: DataFrame, labelled: bool = False) -> DataFrame:
    """Candidates as they go to a caller: provenance instead of source and lines, no text if the context is labelled already, no score parts."""
    text = F.lit(None).cast("string") if labelled else F.col("text")
    provenance = F.coalesce(F.col("metadata.provenance"), T.provenance(F.col("source"), F.col("metadata.line_start"), F.col("metadata.line_end")))
    return candidates.select("cand_id", "query_id", provenance.alias("provenance"), F.concat("source", F.lit("#tokens="), F.col("tok_start").cast("string"), F.lit(":"), F.col("tok_end").cast("string")).alias("span_id"), "token_count", "selection_reasons", "rank_score", text.alias("text"))


def compact(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Records of each key as one JSON text of column names and rows of values, in the order of the columns."""
    items = F.array_sort(F.collect_list(F.struct(*columns)))
    values = F.transform(items, lambda r: F.concat(F.lit("["), F.array_join(F.array(*[F.to_json(F.struct(r[c].alias("v"))) for c in columns]), ","), F.lit("]")))
    return rows.groupBy(key).agg(F.array_join(values, ",").alias("rows")).select(key, F.concat(F.lit('{"columns":["' + '","'.join(columns) + '"],"rows":['), "rows", F.lit("]}")).alias("body"))
