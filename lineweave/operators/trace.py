"""Tracing a name through definitions: what it depends on, and who calls it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineweave.plans.durable import durable
from lineweave.plans.skew import running_total

KEY = ["source", "name", "line_start"]


def known_by() -> Column:
    """The names by which a definition is known: its own, and for imports and variables every name they bind."""
    bound = F.filter(F.coalesce("defines", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    every = F.when(F.col("kind").isin("import", "variable") & (F.size(bound) > 0), F.array_distinct(bound)).otherwise(F.array("name"))
    return F.filter(every, lambda x: x.isNotNull())


def unique_definitions(definitions: DataFrame) -> DataFrame:
    """One row a (source, name, line_start): the last by ``ordinal``, with arrays ``known`` and ``uses`` of names."""
    last = F.max_by(F.struct("kind", "line_end", "defines", "refs", "n_tokens"), "ordinal").alias("x")
    d = definitions.groupBy(*KEY).agg(last).select(*KEY, "x.*")
    uses = F.array_distinct(F.filter(F.coalesce("refs", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))
    return d.select(*KEY, "kind", "line_end", "n_tokens", known_by().alias("known"), uses.alias("uses"))


def trace(definitions: DataFrame, roots: DataFrame, max_depth: int = 4, direction: str = "dependencies") -> tuple[DataFrame, bool]:
    """The definitions reached from the names in ``roots`` (name) in at most ``max_depth`` steps, each at its least depth; and whether more lie beyond.

    ``definitions`` has ``source, name, line_start, line_end, kind, defines, refs, ordinal, n_tokens``. Steps go by names: the names that a step's
    definitions use (or, for callers, are known by) are distinct and each is followed once, so a name that many use and many define costs the sum of
    both, never their product. Null and empty names lead nowhere; repeated rows are one definition.
    """
    if max_depth < 0:
        raise ValueError("max_depth must be at least 0")
    if direction not in ("dependencies", "callers"):
        raise ValueError("direction must be dependencies or callers")
    d = durable(unique_definitions(definitions), "trace-definitions")
    leads, meets = ("uses", "known") if direction == "dependencies" else ("known", "uses")
    at = durable(d.select(*KEY, F.explode(meets).alias("by")), "trace-names")
    seeds = d.select(*KEY, F.explode("known").alias("by")).join(roots.select(F.col("name").alias("by")).distinct(), "by", "left_semi")
    seen = frontier = durable(seeds.select(*KEY).distinct().withColumn("depth", F.lit(0)), "trace-0")
    followed = d.select(F.lit("").alias("by")).limit(0)
    for depth in range(1, max_depth + 2):
        names = d.join(frontier.select(*KEY), KEY, "left_semi").select(F.explode(leads).alias("by")).distinct().join(followed, "by", "left_anti")
        names = durable(names, f"trace-follow-{depth}")
        followed = followed.unionByName(names)
        found = at.join(names, "by", "left_semi").select(*KEY).distinct().join(seen.select(*KEY), KEY, "left_anti")
        if depth > max_depth:
            return _full(d, seen), not found.isEmpty()
        frontier = durable(found.withColumn("depth", F.lit(depth)), f"trace-{depth}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return _full(d, seen), False


def _full(d: DataFrame, seen: DataFrame) -> DataFrame:
    return seen.join(d.select(*KEY, "kind", "line_end", "n_tokens"), KEY)


def summary(traced: DataFrame, truncated: bool, definitions: DataFrame, budget: int = 4000) -> DataFrame:
    """One row: definitions and tokens of the closure and of the whole index, the depth reached, and whether depth or budget were exceeded."""
    index = unique_definitions(definitions).agg(F.count("*").alias("index_definitions"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("index_tokens"))
    x = traced.agg(F.count("*").alias("definitions"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))
    x = x.crossJoin(F.broadcast(index))  # one row each
    reduction = F.when(F.col("index_tokens") > 0, F.round(1 - F.col("tokens") / F.col("index_tokens"), 4)).otherwise(0.0)
    return x.withColumns({"token_reduction": reduction, "truncated_by_depth": F.lit(truncated), "over_budget": F.col("tokens") > budget})


def pack_trace(traced: DataFrame, budget: int) -> DataFrame:
    """The definitions in the order of source, line and name up to the first that overflows the budget; none is cut."""
    x = running_total(traced, [], [F.col("source"), F.col("line_start"), F.col("name")], F.col("n_tokens"), "before", "trace-pack")
    return x.filter(F.col("before") + F.col("n_tokens") <= budget).drop("before")


def section_definitions(definitions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Definitions that lie wholly within a requested range (source, low, high, with ``base`` as its first character's place), with offsets from there."""
    r = ranges.select(F.col("source").alias("r_source"), "low", "high", "base")
    inside = (F.col("source") == F.col("r_source")) & (F.col("line_start") >= F.col("low")) & (F.col("line_end") <= F.col("high"))
    x = definitions.join(r, inside)
    return x.withColumns({"char_start": F.col("char_start") - F.col("base"), "char_end": F.col("char_end") - F.col("base")}).drop("r_source", "base")


def blank_outside(line_rows: DataFrame, ranges: DataFrame, bin_lines: int = 64) -> DataFrame:
    """The lines (source, line, text) with those outside all ranges (source, low, high) made empty, so that line numbers stay. Files without a range stay
    as they are."""
    r = ranges.select(F.col("source").alias("r_source"), "low", "high", F.explode(F.sequence(F.floor(F.col("low") / bin_lines), F.floor(F.col("high") / bin_lines))).alias("r_bin"))
    x = line_rows.withColumn("bin", F.floor(F.col("line") / bin_lines))
    hit = (F.col("source") == F.col("r_source")) & (F.col("bin") == F.col("r_bin")) & F.col("line").between(F.col("low"), F.col("high"))
    inside = x.join(r, hit, "left_semi").select("source", "line").distinct().withColumn("inside", F.lit(True))
    limited = ranges.select("source").distinct().withColumn("limited", F.lit(True))
    x = x.join(inside, ["source", "line"], "left").join(limited, "source", "left")
    return x.select("source", "line", F.when(F.col("limited").isNull() | F.col("inside"), F.col("text")).otherwise("").alias("text"))


def named_paths(queries: DataFrame, files: DataFrame) -> DataFrame:
    """``query_id, path``: files that a question names by their path or the end of it, where the name fits one file only."""
    tokens = F.array_distinct(F.transform(F.regexp_extract_all("query_text", F.lit(r"([A-Za-z0-9_.\-/\\]+)"), 1), lambda t: F.btrim(F.translate(t, "\\", "/"), F.lit("./"))))
    q = queries.select("query_id", F.explode(F.filter(tokens, lambda t: t.contains("."))).alias("token"))
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    f = files.select("path").distinct().select("path", F.explode(ends).alias("token"))
    only = f.groupBy("token").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n = 1")
    return q.join(only, "token").select("query_id", "path").distinct()


def first_files(named: DataFrame, hits: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` files of each question: those it names, then those of the hits (query_id, path, rank) by rank; ties by path."""
    n = named.select("query_id", "path", F.lit(0).alias("tier"), F.lit(0).cast("bigint").alias("rank"))
    x = n.unionByName(hits.select("query_id", "path", F.lit(1).alias("tier"), F.col("rank").cast("bigint").alias("rank")))
    x = x.groupBy("query_id", "path").agg(F.min(F.struct("tier", "rank")).alias("x"))
    w = Window.partitionBy("query_id").orderBy("x.tier", "x.rank", "path")
    return x.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query_id", "place", "path", (F.col("x.tier") == 0).alias("named"))


def qualified(definitions: DataFrame, names: DataFrame, bin_lines: int = 64) -> DataFrame:
    """Definitions that a qualified name (``full``, parts joined by ``::``, ``->``, ``.`` or ``/``) means: its parts are the last of the definition's own
    path, which is its module's path, the definitions around it from the outermost, and its name. ``full, source, name, line_start``."""
    d = definitions.select("source", "name", "line_start", "line_end").distinct()
    around = d.select(F.col("source").alias("o_source"), F.col("name").alias("o_name"), F.col("line_start").alias("o_start"), F.col("line_end").alias("o_end"))
    around = around.withColumn("o_bin", F.explode(F.sequence(F.floor(F.col("o_start") / bin_lines), F.floor(F.col("o_end") / bin_lines))))
    parts = names.select("full", F.filter(F.split("full", r"::|->|[./]"), lambda p: p != "").alias("want")).filter(F.size("want") > 1)
    wanted = d.join(parts.select("full", "want", F.element_at("want", -1).alias("name")), "name").withColumn("bin", F.floor(F.col("line_start") / bin_lines))
    inside = (F.col("source") == F.col("o_source")) & (F.col("bin") == F.col("o_bin")) & (F.col("o_start") <= F.col("line_start")) & (F.col("o_end") >= F.col("line_end"))
    real = (F.col("o_start") != F.col("line_start")) | (F.col("o_end") != F.col("line_end"))
    x = wanted.join(around, inside & real, "left").groupBy("full", "want", "source", "name", "line_start").agg(
        F.array_sort(F.collect_set(F.when(F.col("o_name").isNotNull(), F.struct("o_start", (-F.col("o_end")).alias("e"), "o_name")))).alias("outer")
    )
    module = F.split(F.regexp_replace("source", r"\.[^./]+$", ""), "/")
    own = F.concat(module, F.transform("outer", lambda o: o.o_name), F.array("name"))
    fits = (F.size(own) >= F.size("want")) & (F.slice(own, F.greatest(F.size(own) - F.size("want") + 1, F.lit(1)), F.size("want")) == F.col("want"))
    return x.filter(fits).select("full", "source", "name", "line_start")
