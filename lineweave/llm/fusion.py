"""One ranking from several differently scaled scores: weighted median rank aggregation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.plans.durable import durable
from lineweave.plans.skew import hot_split_join, running_total
from lineweave.sources.tables import table


def _weight(name: Column, weights: Mapping[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
    return F.coalesce(known[name], F.lit(1.0))


def median_rank(items: DataFrame, group: str, ident: str, scores: str, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Order the rows of each group by the weighted median of their ranks in each score.

    ``items`` has one row per item with the map ``scores`` (name to double, larger is better). The result has ``group``, ``ident``, ``median_rank``,
    ``mean_rank`` (both weighted), ``n_scores`` (usable scores of the row) and ``merged_rank`` (1 for the best): median, then mean, then identifier.

    Ranks: within its group a score's values are ranked from 1 for the largest; equal values share the mean of their ranks. A value that is null,
    NaN or infinite counts as absent. Items without a score that others of the group have share the ranks after those, so absence is never an
    advantage; a score that no item of the group has plays no part, and a group without any score is ordered by identifier with rank 0. Where half
    of the weight lies on either side, the median is the mean of the two middle ranks. Scores not named in ``weights`` weigh 1; a weight of 0 or less
    leaves a score out. A null group is a group of its own. Rows repeated under one identifier are
    placed next to each other by all their scores together; for exact repetitions that is each row's own place.

    Only distinct (group, score, value) triples with their counts are ordered, range-partitioned, so neither a large group nor a value shared by
    millions of items meets in one task. The ranks return to the rows by a join that broadcasts only the at most 1000 most frequent triples.
    """
    weights = dict(weights or {})
    base = items.select(F.col(group).alias("g"), F.col(ident).alias("id"), F.col(scores).alias("m"))
    usable = F.map_filter("m", lambda k, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))) & (_weight(k, weights) > 0))
    base = base.select("g", "id", F.coalesce(usable, F.create_map().cast("map<string,double>")).alias("m"))
    long = base.select("g", "id", F.explode("m").alias("name", "value")).withColumn("value", F.col("value") + F.lit(0.0))

    ties = long.groupBy("g", "name", "value").agg(F.count("*").alias("ties"))
    ranked = running_total(ties, ["g", "name"], [F.col("value").desc()], F.col("ties"), "before", "fusion-values")
    ranked = durable(ranked.withColumn("rank", F.col("before") + (F.col("ties") + 1) / 2).select("g", "name", "value", "ties", "rank", "before"), "fusion-ranks")
    total = ranked.agg(F.coalesce(F.sum("ties"), F.lit(0))).first()[0]

    sizes = base.groupBy("g").agg(F.count("*").alias("n"))
    held = ranked.groupBy("g", "name").agg(F.sum("ties").alias("held"))
    held = held.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("name", "held"))).alias("held"))
    held = held.withColumnRenamed("g", "g2")
    sizes = sizes.join(held, F.col("g").eqNullSafe(F.col("g2")), "left").drop("g2")
    sizes = durable(sizes, "fusion-groups")
    items_total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    own = hot_split_join(long, ranked.select("g", "name", "value", "ties", "rank"), ["g", "name", "value"], "ties", total)
    own = own.groupBy("g", "id").agg(F.collect_set(F.struct("name", "rank")).alias("ranks"))
    rows = hot_split_join(base.select("g", "id"), sizes, ["g"], "n", items_total)
    own = own.withColumnsRenamed({"g": "g2", "id": "id2"})
    rows = rows.join(own, F.col("g").eqNullSafe(F.col("g2")) & F.col("id").eqNullSafe(F.col("id2")), "left").drop("g2", "id2")

    empty = F.array().cast("array<struct<name:string,rank:double>>")
    ranks = F.coalesce("ranks", empty)
    names = F.transform(ranks, lambda x: x["name"])
    absent = F.map_filter(F.coalesce("held", F.create_map().cast("map<string,bigint>")), lambda k, v: ~F.array_contains(names, k))
    late = F.transform(F.map_entries(absent), lambda e: F.struct(e["key"].alias("name"), ((e["value"] + 1 + F.col("n")) / 2).alias("rank")))
    rows = rows.select("g", "id", F.size(ranks).alias("n_scores"), F.concat(ranks, late).alias("all"))
    pairs = F.array_sort(F.transform("all", lambda x: F.struct(x["rank"].alias("r"), _weight(x["name"], weights).alias("w"))))
    rows = rows.select("g", "id", "n_scores", pairs.alias("p"))
    weight = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["w"])
    state = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))

    def step(a: Column, x: Column) -> Column:
        c = a["c"] + x["w"]
        lo = F.when(a["lo"].isNull() & (2 * c >= F.col("total")), x["r"]).otherwise(a["lo"])
        hi = F.when(a["hi"].isNull() & (2 * c > F.col("total")), x["r"]).otherwise(a["hi"])
        return F.struct(c.alias("c"), lo.alias("lo"), hi.alias("hi"))

    rows = rows.withColumn("total", weight)
    mid = F.aggregate("p", state, step, lambda a: (a["lo"] + a["hi"]) / 2)
    mean = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["w"] * x["r"]) / F.col("total")
    rows = rows.select("g", "id", "n_scores", F.coalesce(mid, F.lit(0.0)).alias("median_rank"), F.when(F.size("p") > 0, mean).otherwise(0.0).alias("mean_rank"))
    placed = running_total(rows, ["g"], [F.col("median_rank"), F.col("mean_rank"), F.col("id")], F.lit(1), "before", "fusion-order")
    return placed.select(F.col("g").alias(group), F.col("id").alias(ident), "median_rank", "mean_rank", "n_scores", (F.col("before") + 1).alias("merged_rank"))


def p3_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate's place in its query's merged order."""
    c = table(spark, sf_dir, "candidates", "query_id", "cand_id", "score_components")
    merged = median_rank(c, "query_id", "cand_id", "score_components")
    return merged.select("query_id", "cand_id", "merged_rank", F.round("median_rank", 6).alias("median_rank"), F.round("mean_rank", 6).alias("mean_rank"), "n_scores")


def p3_against_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query, how the merged order's best row compares with the given score's best row."""
    c = table(spark, sf_dir, "candidates", "query_id", "cand_id", "rank_score", "score_components")
    merged = median_rank(c, "query_id", "cand_id", "score_components").filter("merged_rank = 1").select(F.col("query_id").alias("q"), F.col("cand_id").alias("merged_best"))
    valid = F.col("rank_score").isNotNull() & ~F.isnan("rank_score")
    given = c.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.when(valid, F.struct("rank_score", (-F.col("cand_id")).alias("k")))).alias("b"))
    both = given.join(merged, F.col("query_id").eqNullSafe(F.col("q")))
    return both.select("query_id", "n", "merged_best", (-F.col("b.k")).alias("given_best"))


_MERGED = """
with long as (
  select query_id, cand_id, e.key as name, e.value as value
  from (select query_id, cand_id, unnest(map_entries(score_components)) as e from candidates)
  where e.value is not null and not isnan(e.value) and not isinf(e.value)
), ranked as (
  select *, rank() over (partition by query_id, name order by value desc)
      + (count(*) over (partition by query_id, name, value) - 1) / 2.0 as r from long
), held as (select query_id, name, count(*) as held from long group by 1, 2),
sizes as (select query_id, count(*) as n from candidates group by 1),
every as (
  select c.query_id, c.cand_id, h.name, coalesce(r.r, (h.held + 1 + s.n) / 2.0) as r, r.r is not null as own
  from candidates c join sizes s using (query_id) left join held h using (query_id)
  left join ranked r on r.query_id = c.query_id and r.cand_id = c.cand_id and r.name = h.name
), scored as (
  select query_id, cand_id, coalesce(median(r) filter (name is not null), 0) as med, coalesce(avg(r) filter (name is not null), 0) as mean,
      count(*) filter (own) as n_scores
  from every group by 1, 2
), placed as (
  select *, row_number() over (partition by query_id order by med, mean, cand_id) as merged_rank from scored
)
"""

QUERIES = {"p3_merged": p3_merged, "p3_against_given": p3_against_given}
SQL = {
    "p3_merged": _MERGED + "select query_id, cand_id, merged_rank, round(med, 6) as median_rank, round(mean, 6) as mean_rank, n_scores from placed",
    "p3_against_given": _MERGED
    + """, given as (
  select query_id, cand_id, row_number() over (partition by query_id order by rank_score desc, cand_id) as k
  from candidates where rank_score is not null and not isnan(rank_score))
select p.query_id, s.n, p.cand_id as merged_best, g.cand_id as given_best
from placed p join sizes s using (query_id) left join given g on g.query_id = p.query_id and g.k = 1 where p.merged_rank = 1""",
}
