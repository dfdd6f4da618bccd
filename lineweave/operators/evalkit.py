"""Evaluation of retrieval runs: aggregates by arm, paired comparison, bootstrap intervals, completeness of a schedule."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arm_means(rows: DataFrame, group: list[str], measures: list[str]) -> DataFrame:
    """Number of rows and mean of each measure (booleans count 0 and 1) per group."""
    return rows.groupBy(*group).agg(F.count("*").alias("n"), *[F.avg(F.col(m).cast("double")).alias(m) for m in measures])


def arm_rollup(rows: DataFrame, first: str, second: str, measures: list[str]) -> DataFrame:
    """The same by ``first`` and by both; the total of a first has a null second."""
    x = rows.groupingSets([[F.col(first)], [F.col(first), F.col(second)]], F.col(first), F.col(second))
    return x.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(m).cast("double")).alias(m) for m in measures])


def paired(rows: DataFrame, arm: str, a: str, b: str, key: str, measure: str) -> DataFrame:
    """``key, delta``: measure under arm ``a`` less that under arm ``b``, where both have the key."""
    x = rows.filter(F.col(arm) == a).select(key, F.col(measure).cast("double").alias("x"))
    y = rows.filter(F.col(arm) == b).select(key, F.col(measure).cast("double").alias("y"))
    return x.join(y, key).select(key, (F.col("x") - F.col("y")).alias("delta"))


def savings(means: DataFrame, arm: str, baseline: str, measure: str) -> DataFrame:
    """Share of the baseline's measure that each arm saves."""
    base = means.filter(F.col(arm) == baseline).select(F.col(measure).alias("base"))
    return means.crossJoin(F.broadcast(base)).select(arm, (1 - F.col(measure) / F.col("base")).alias("saving"))  # one row


def bootstrap(values: list[float], draws: int = 10_000, seed: int = 0) -> tuple[float, float, float]:
    """Percentile interval and mean of resamples with a seeded generator, each to four places; the values count in the given order."""
    n = len(values)
    if not n:
        return 0.0, 0.0, 0.0
    rng = random.Random(seed)
    means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(draws))
    return round(means[int(0.025 * draws)], 4), round(means[min(int(0.975 * draws), draws - 1)], 4), round(sum(values) / n, 4)


def intervals(deltas: DataFrame, group: list[str], key: str, margin: float = -0.05, draws: int = 10_000) -> DataFrame:
    """Mean, bootstrap interval and non-inferiority of ``delta`` per group: the mean, and the lower end, at or above the margin.

    A group is one paired comparison of an evaluation plan; its values count in the order of ``key``, as the generator's draws depend on it.
    """
    fields = {f.name: f.dataType.simpleString() for f in deltas.schema}
    schema = ", ".join([*[f"{g} {fields[g]}" for g in group], "n_pairs bigint, delta_mean double, low double, high double, passes_point boolean, passes_ci boolean"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.dropna(subset=["delta"]).sort_values(key).delta.tolist()
        low, high, mean = bootstrap(v, draws)
        return pd.DataFrame([(*[pdf[g].iloc[0] for g in group], len(v), mean, low, high, mean >= margin, low >= margin)], columns=[*group, "n_pairs", "delta_mean", "low", "high", "passes_point", "passes_ci"])

    return deltas.groupBy(*group).applyInPandas(run, schema)


def distribution(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Count, mean, median and 95th percentile (exact, interpolated)."""
    v = F.col(value).cast("double")
    return rows.groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.95)).alias("p95"))


def missing_cells(plan: DataFrame, arms: list[str], rows: DataFrame, task: str = "task_id") -> DataFrame:
    """Cells (task, arm) of a plan without a row, and cells with several: ``task, arm, n``. Arms are a short list of the plan."""
    want = plan.select(task, F.explode(F.array(*[F.lit(a) for a in arms])).alias("arm"))
    have = rows.groupBy(task, "arm").agg(F.count("*").alias("n"))
    return want.join(have, [task, "arm"], "left").select(task, "arm", F.coalesce("n", F.lit(0)).alias("n")).filter("n <> 1")


def grounded(answer: Column, keywords: Column, hit: Column) -> Column:
    """A run succeeded if its answer holds all keywords and the critical source was hit."""
    return F.forall(keywords, lambda k: F.contains(F.lower(answer), F.lower(k))) & hit


def localised(text: Column, must: Column, any_of: Column) -> Column:
    """All of the one and, if there are any, at least one of the other substrings."""
    return F.forall(must, lambda k: F.contains(text, k)) & ((F.size(any_of) == 0) | F.exists(any_of, lambda k: F.contains(text, k)))


def transcript_cost(turns: DataFrame) -> DataFrame:
    """Growth of the prompt from turn to turn (never below 0) and its running total: ``run, turn, growth, total``."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("run").orderBy("turn")
    growth = F.greatest(F.col("prompt_tokens") - F.coalesce(F.lag("prompt_tokens").over(w), F.lit(0)), F.lit(0))
    return turns.withColumn("growth", growth).withColumn("total", F.sum("prompt_tokens").over(w)).select("run", "turn", "growth", "total")
