"""Evidence accounting, query classes, confidence, usage reports and drift of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions import text as T

# Phrases of questions about call chains, and of questions about all of something.
TRACE_SIGNALS = ("dependencies of", "dependency of", "depends on", "call chain", "call graph", "callers of", "who calls", "what calls", "calls does", "import chain", "transitively", "transitive", "closure of", "trace the", "trace dependencies")
AGGREGATION_SIGNALS = (
    "how many", "number of", "count of", "count the", "list all", "list every", "every function", "every class", "all functions", "all classes", "across all", "across the codebase", "across the repo", "across the project",
    "whole codebase", "entire codebase", "throughout the", "in total", "overall", "summarize the", "summarise the", "all the places", "everywhere", "each file",
)


def query_class(query: Column) -> Column:
    """``unknown`` for less than two keywords, else ``trace``, ``aggregation`` or ``localized`` by the phrases in it."""
    low = T.casefold(query)

    def any_of(signals: tuple[str, ...]) -> Column:
        return F.exists(F.array(*[F.lit(s) for s in signals]), lambda s: F.contains(low, s))

    few = F.coalesce(F.size(T.keywords(query)), F.lit(0)) < 2
    return F.when(few, "unknown").when(any_of(TRACE_SIGNALS), "trace").when(any_of(AGGREGATION_SIGNALS), "aggregation").otherwise("localized")


def claims(queries: DataFrame, spans: DataFrame) -> DataFrame:
    """Per claim of a query: keywords, how many some span of the query supports (by text or path), coverage and status.

    ``spans`` has ``query_id, source, text``. Keywords meet spans by equality.
    """
    c = queries.select("query_id", F.posexplode(T.claims(F.col("query_text"))).alias("n", "claim")).withColumn("k", T.plain_keywords(F.col("claim")))
    terms = F.array_distinct(F.concat(T.plain_keywords(F.coalesce("text", F.lit(""))), T.path_keywords(F.coalesce("source", F.lit("")))))
    have = spans.select("query_id", F.explode(terms).alias("term")).distinct().withColumn("hit", F.lit(1))
    asked = c.select("query_id", "n", F.explode("k").alias("term"))
    found = asked.join(have, ["query_id", "term"], "left").groupBy("query_id", "n").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("matched"))
    x = c.join(found, ["query_id", "n"], "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    total = F.size("k")
    status = F.when(total == 0, "not_evaluable").when(F.col("matched") == total, "supported").when(F.col("matched") > 0, "partial").otherwise("unsupported")
    return x.select("query_id", (F.col("n") + 1).alias("claim_no"), "claim", total.alias("n_keywords"), F.col("matched").alias("n_matched"), F.when(total > 0, F.col("matched") / total).alias("coverage"), status.alias("status"))


def evidence_summary(claimed: DataFrame) -> DataFrame:
    """Of each query's claims (rows of ``claims``): how many of each status, and the share of all keywords found; 1 where there is none to find."""
    n = F.sum("n_keywords")
    of = lambda s: F.sum((F.col("status") == s).cast("bigint")).alias(s)
    return claimed.groupBy("query_id").agg(F.count("*").alias("claims"), of("supported"), of("partial"), of("unsupported"), of("not_evaluable"), F.when(n > 0, F.sum("n_matched") / n).otherwise(1.0).alias("coverage"))


def keyword_cover(asked: Column, held: Column) -> Column:
    """The asked keywords that are held and those that are not, each sorted."""
    return F.struct(F.array_sort(F.array_intersect(asked, held)).alias("covered"), F.array_sort(F.array_except(asked, held)).alias("uncovered"))


def confidence(df: DataFrame) -> Column:
    """How far a selection can be trusted, from ``lossless, coverage, multi_signal, n_scored, n_skipped, window_dropped, query_class``."""
    pressure = F.col("n_skipped") / F.greatest(F.col("n_scored") + F.col("n_skipped"), F.lit(1))
    x = 0.5 * F.col("coverage") + 0.3 * F.col("multi_signal") + 0.2 * (1 - pressure)
    x = x * F.when(F.col("window_dropped"), 0.8).otherwise(1.0)
    x = x * F.when(F.col("query_class") == "aggregation", 0.6).when(F.col("query_class") == "trace", 0.85).when(F.col("query_class") == "unknown", 0.7).otherwise(1.0)
    return F.when(F.col("lossless"), 0.95).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def ledger_summary(ledger: DataFrame, since: str | None = None, price_per_million: float = 0.0) -> DataFrame:
    """Totals (day null) and days of a usage ledger. A sum with one unknown count is unknown, and so is what is computed from it; savings are always
    recomputed. ``since`` compares date strings."""
    x = ledger.filter(F.col("ts") >= since) if since else ledger
    x = x.withColumn("day", F.coalesce(F.nullif(F.substring("ts", 1, 10), F.lit("")), F.lit("unknown")))
    known = F.col("tokens_in").isNotNull() & F.col("tokens_out").isNotNull()
    x = x.withColumn("saved", F.when(known, F.col("tokens_in") - F.col("tokens_out")))
    x = x.groupingSets([[], [F.col("day")]], F.col("day")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum((~known).cast("bigint")).alias("unmeasured"), T.strict_sum(F.col("tokens_in")).alias("tokens_in"), T.strict_sum(F.col("tokens_out")).alias("tokens_out"),
        T.strict_sum(F.col("saved")).alias("tokens_saved"), F.sum(F.coalesce("round_trips_saved", F.lit(0))).alias("round_trips_saved"),
    )
    x = x.withColumn("reduction", F.when(F.col("tokens_in") > 0, F.col("tokens_saved") / F.col("tokens_in")))
    return x.withColumn("usd", F.col("tokens_saved") * price_per_million / 1e6 if price_per_million > 0 else F.lit(None).cast("double"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sources whose fingerprint differs between two states: ``source, change`` (added, removed, changed)."""
    a = before.select("source", F.col("fingerprint").alias("old"))
    b = after.select("source", F.col("fingerprint").alias("new"))
    x = a.join(b, "source", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    return x.select("source", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def stale(pack: DataFrame, current: DataFrame) -> DataFrame:
    """Sources of a pack (source, fingerprint) that changed or can't be read any more."""
    c = current.select("source", F.col("fingerprint").alias("now"))
    return pack.join(c, "source", "left").filter(F.col("now").isNull() | (F.col("now") != F.col("fingerprint"))).select("source")
