"""Trials of retrieval: context packers of the compared arms, groups and gates over attempts, replay of transcripts, citations against what was delivered."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineweave.functions import text as T
from lineweave.operators import chunk
from lineweave.plans.skew import running_total

# Parts of paths that tell tests, and endings that tell documents.
TEST_HINTS = ("/test", "test_", "_test.", "/tests/", "conftest")
DOC_ENDINGS = (".md", ".rst", ".txt")
# Fixed value: seed of the gate's draws.
SEED = 2026100505


def source_priority(path: Column) -> Column:
    """0 for code, 1 more for documents, 2 more for tests, so that a cut keeps code."""
    low = T.casefold(path)
    test = F.lit(False)
    for hint in TEST_HINTS:
        test = test | F.contains(low, F.lit(hint))
    doc = F.lit(False)
    for ending in DOC_ENDINGS:
        doc = doc | low.endswith(ending)
    return test.cast("int") * 2 + doc.cast("int")


def pack_until(rows: DataFrame, key: list[str], order: list[Column], cost: Column, budget: int, clip: bool = False) -> DataFrame:
    """The rows of each key in order until one overflows the budget: the walk stops there, or with ``clip`` that row is kept for the tokens left
    (``n_tokens`` tells how many). Groups of any size: the running sum is taken over range partitions."""
    x = running_total(rows.withColumn("__cost", cost.cast("bigint")), key, order, F.col("__cost"), "before", "pack-until")
    fits = F.col("before") + F.col("__cost") <= budget
    if not clip:
        return x.filter(fits).withColumn("n_tokens", F.col("__cost")).drop("__cost", "before")
    left = F.lit(budget) - F.col("before")
    return x.filter(left > 0).withColumn("n_tokens", F.least(F.col("__cost"), left)).drop("__cost", "before")


def clipped(text: Column, n: Column) -> Column:
    """The first ``n`` white-space tokens of a text with the white space between them."""
    return F.when(T.token_count(text) <= n, text).otherwise(F.array_join(F.slice(T.tokens(text), F.lit(1), F.greatest(n.cast("int"), F.lit(0))), " "))


def native_search(files: DataFrame, queries: DataFrame, top: int = 6, most: int = 4000) -> DataFrame:
    """The files of each question's scope (files: scope, source, text; queries: query_id, query_text, scope) in which its keywords occur most often:
    ``query_id, place, source, hits, n_tokens``, at most ``most`` tokens of a file. Keywords are counted as substrings without overlap, ties go by path.

    Questions of one scope go to the tasks together, so each file is read once; a question's files are never shuffled but its best.
    """
    asked = [(r.query_id, r.scope, r.k) for r in queries.filter("scope is not null").select("query_id", "scope", T.keywords(F.col("query_text")).alias("k")).collect()]  # the stated questions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, list] = {}
        for i, scope, words in asked:
            of.setdefault(scope, []).append((i, words or []))
        for b in batches:
            out = []
            for scope, source, folded, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                for i, words in of.get(scope, ()) if folded else ():
                    hits = sum(map(folded.count, words))
                    if hits:
                        out.append((i, source, hits, min(n, most)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), (), ()), (pa.int64(), pa.string(), pa.int64(), pa.int32()))], names=["query_id", "source", "hits", "n_tokens"])

    x = files.select("scope", "source", T.casefold(F.col("text")).alias("t"), T.token_count(F.col("text")).alias("n")).mapInArrow(run, "query_id bigint, source string, hits bigint, n_tokens int")
    w = Window.partitionBy("query_id").orderBy(F.col("hits").desc(), "source")
    return x.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select("query_id", "place", "source", "hits", "n_tokens")


def grep(line_rows: DataFrame, pattern: str, most: int = 40, per_file: int = 5) -> DataFrame:
    """Lines that match without regard to case, the first ``per_file`` of a file and ``most`` in all by path and line: ``source, line, text``."""
    w = Window.partitionBy("source").orderBy("line")
    x = line_rows.filter(F.col("text").rlike("(?i)" + pattern)).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_file)
    return x.select("source", "line", F.substring(F.trim("text"), 1, 200).alias("text")).orderBy("source", "line").limit(most)


def attempts_summary(rows: DataFrame, group: list[str]) -> DataFrame:
    """Of each group of attempts (supported, failed, tokens, cost, bound): how many, how many supported and failed, how many of unknown usage or cost, and
    totals and ratios that are unknown as soon as one attempt's value is."""
    tokens, cost, bound = T.strict_sum(F.col("tokens")), T.strict_sum(F.col("cost")), T.strict_sum(F.col("bound"))
    good = F.sum(F.col("supported").cast("bigint"))
    x = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), good.alias("supported"), F.sum(F.col("failed").cast("bigint")).alias("failed"), F.sum(F.col("tokens").isNull().cast("bigint")).alias("unknown_usage"), F.sum(F.col("cost").isNull().cast("bigint")).alias("unknown_cost"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_at_least"), tokens.alias("tokens"), cost.alias("cost"), bound.alias("cost_at_most"),
    )
    per = lambda c: F.when(F.col("supported") > 0, F.col(c) / F.col("supported"))
    return x.withColumns({"tokens_per_supported": per("tokens"), "cost_per_supported": per("cost"), "mean_cost": F.col("cost") / F.col("n")})


def _quantile(ordered: list[float], q: float) -> float | None:
    at = (len(ordered) - 1) * q
    low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at)) if math.isfinite(high) else None


def gate(pairs: list[tuple[int, int, int, int, float, float]], draws: int = 10_000, seed: int = SEED) -> dict:
    """Does a candidate pass against its reference? ``pairs`` has, a question each, supported, errors and tokens of both (candidate, reference alternating).

    It must support no less, err no more, its accuracy may fall by 0.05 at the lower end of the bootstrap interval, and its tokens must be at most 0.85 of
    the reference's and below 1 at the upper end. An interval whose end would be infinite is unknown and fails.
    """
    if not pairs:
        return {"passes": False, "problem": "no pairs"}
    totals = [sum(p[i] for p in pairs) for i in range(6)]
    rng, n = random.Random(seed), len(pairs)
    differences, ratios = [], []
    for _ in range(draws):
        sample = [pairs[rng.randrange(n)] for _ in range(n)]
        differences.append(sum(p[0] - p[1] for p in sample) / n)
        below = sum(p[5] for p in sample)
        ratios.append(sum(p[4] for p in sample) / below if below else math.inf)
    differences.sort()
    ratios.sort()
    accuracy, ratio = [[_quantile(x, q) for q in (0.025, 0.975)] for x in (differences, ratios)]
    observed = totals[4] / totals[5] if totals[5] else None
    checks = {
        "supports": totals[0] >= totals[1], "errs": totals[2] <= totals[3], "accuracy": accuracy[0] is not None and accuracy[0] >= -0.05, "tokens": ratio[1] is not None and ratio[1] < 1, "saving": observed is not None and observed <= 0.85,
    }
    return {"passes": all(checks.values()), "holds": checks["supports"] and checks["errs"], "n": n, "low": accuracy[0], "high": accuracy[1], "ratio": observed, "ratio_low": ratio[0], "ratio_high": ratio[1], **checks}


_GATE = "n bigint, passes boolean, holds boolean, low double, high double, ratio double, ratio_low double, ratio_high double"


def paired_gate(rows: DataFrame, group: list[str], key: str, draws: int = 10_000) -> DataFrame:
    """The gate of each group of paired attempts (``key``, supported_a, supported_b, errors_a, errors_b, tokens_a, tokens_b), a plan's questions each.

    A group with an unknown value or a question twice doesn't pass.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    values = ["supported_a", "supported_b", "errors_a", "errors_b", "tokens_a", "tokens_b"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bad = pdf[values].isna().any().any() or pdf[key].duplicated().any()
        g = {} if bad else gate(list(pdf.sort_values(key)[values].itertuples(index=False, name=None)), draws)
        row = [pdf[c].iloc[0] for c in group] + [len(pdf), g.get("passes", False), g.get("holds", False), *(g.get(c) for c in ("low", "high", "ratio", "ratio_low", "ratio_high"))]
        return pd.DataFrame([row], columns=[*group, *(x.split()[0] for x in _GATE.split(", "))])

    return rows.groupBy(*group).applyInPandas(run, ", ".join([*[f"{g} {fields[g]}" for g in group], _GATE]))


def stratified(now: dict[tuple, list[tuple[float, bool]]], then: dict[tuple, list[tuple[float, bool]]], draws: int = 4000) -> dict[str, tuple[float, float, float]]:
    """Median and 95 % interval of the change in mean tokens (relative) and in the share of right answers, resampling runs (tokens, right) within each cell
    that both arms have."""
    rng = random.Random(0)
    keys = sorted(set(now) & set(then), key=str)
    if not keys:
        return {}
    tokens, right = [], []
    for _ in range(draws):
        sums = [[0.0, 0, 0], [0.0, 0, 0]]
        for k in keys:
            for s, arm in zip(sums, (now, then)):
                group = arm[k]
                for _ in group:
                    t, ok = group[rng.randrange(len(group))]
                    s[0] += t
                    s[1] += bool(ok)
                    s[2] += 1
        (a, ra, na), (b, rb, nb) = sums
        tokens.append(a / na / (b / nb) - 1 if b else math.inf)
        right.append(ra / na - rb / nb)
    lo, hi = int(draws * 0.025), int(draws * 0.975)
    return {n: (x[draws // 2], x[lo], x[hi]) for n, x in (("tokens", sorted(tokens)), ("right", sorted(right)))}


def replay(turns: DataFrame) -> DataFrame:
    """Cost of each run (run, turn, fixed, output, reply) if every prompt repeats what came before: ``run, turn, prompt, total``. ``reply`` is what a tool's
    answer adds to later prompts; unknown replies add nothing."""
    before = Window.partitionBy("run").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("run").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    history = F.coalesce(F.sum(F.col("output") + F.coalesce("reply", F.lit(0))).over(before), F.lit(0))
    x = turns.withColumn("prompt", F.col("fixed") + history)
    return x.withColumn("total", F.sum(F.col("prompt") + F.col("output")).over(upto)).select("run", "turn", "prompt", "total")


def provider_usage(usage: Column) -> Column:
    """Input and output tokens of a provider's record, whichever names it uses; cached parts count as input once."""
    cached = F.coalesce(usage["cache_read_input_tokens"], F.lit(0)) + F.coalesce(usage["cache_creation_input_tokens"], F.lit(0))
    return F.struct(F.coalesce(usage["prompt_tokens"], usage["input_tokens"] + cached).alias("input"), F.coalesce(usage["completion_tokens"], usage["output_tokens"]).alias("output"))


def citations(cited: DataFrame, delivered: DataFrame, bin_lines: int = 64) -> DataFrame:
    """For each cited range (cite_id, source, low, high) whether the delivered ranges (source, low, high) hold all of its lines, some or none:
    ``cite_id, delivery``."""
    merged = chunk.merge_ranges(delivered.filter("low is not null and high >= low").select("source", "low", "high").distinct(), ["source"], "low", "high")
    d = merged.select(F.col("source").alias("d_source"), F.col("low").alias("d_low"), F.col("high").alias("d_high"), F.explode(F.sequence(F.floor(F.col("low") / bin_lines), F.floor(F.col("high") / bin_lines))).alias("d_bin"))
    c = cited.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / bin_lines), F.floor(F.col("high") / bin_lines))))
    on = (F.col("source") == F.col("d_source")) & (F.col("bin") == F.col("d_bin")) & (F.col("low") <= F.col("d_high")) & (F.col("d_low") <= F.col("high"))
    whole = F.bool_or((F.col("d_low") <= F.col("low")) & (F.col("high") <= F.col("d_high")))
    x = c.join(d, on, "left").groupBy("cite_id").agg(F.coalesce(whole, F.lit(False)).alias("all"), F.bool_or(F.col("d_low").isNotNull()).alias("some"))
    return x.select("cite_id", F.when(F.col("all"), "whole").when(F.col("some"), "fragment").otherwise("never").alias("delivery"))


def pending(plan: DataFrame, arms: list[str], done: DataFrame, task: str = "task_id") -> DataFrame:
    """Cells (task, arm) of a plan that no row of ``done`` covers, as a resumed run needs them."""
    cells = plan.select(task, F.explode(F.array(*[F.lit(a) for a in arms])).alias("arm")).distinct()
    return cells.join(done.select(task, "arm").distinct(), [task, "arm"], "left_anti")


def source_hit(sources: Column, critical: Column) -> Column:
    """Is the critical source part of one of the sources? Unknown where there is none to find."""
    return F.when(critical.isNotNull(), F.exists(sources, lambda s: F.contains(s, critical)))


def name_like(word: Column) -> Column:
    """Does a keyword look like an identifier: an underscore, or a capital within?"""
    return word.rlike("_") | word.rlike("^.+[A-Z]")


def router_accuracy(labelled: DataFrame, predicted: str, label: str) -> DataFrame:
    """Share of right predictions over the labelled rows, in all and by label."""
    x = labelled.filter(F.col(label).isNotNull())
    return x.groupingSets([[], [F.col(label)]], F.col(label)).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy"))
