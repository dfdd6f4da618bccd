"""Reference edges, personalised PageRank and dependency closure as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.plans.durable import durable


def reference_edges(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """Distinct ``src, dst``: a file names (identifier of three characters or more) what another file defines.

    A name defined in many files links to all of them; names are joined by equality after distinct per file.
    """
    named = files.select(F.col("source").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z_][A-Za-z0-9_]{2,})"), 1))).alias("name"))
    defined = definitions.filter((F.col("name") != "") & (F.col("name") != "<anonymous>")).select("name", F.col("source").alias("dst")).distinct()
    return named.join(defined, "name").filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def pagerank(seed: DataFrame, edges: DataFrame, iterations: int = 12, damping: float = 0.85) -> DataFrame:
    """``node, rank`` after a fixed number of steps from ``seed`` (node, score). Mass of nodes without edges spreads evenly over all nodes.

    ``edges`` (src, dst) must be distinct and lie within the seed. Lineage is cut every fourth step.
    """
    n, total = seed.agg(F.count("*"), F.sum("score")).first()
    if not n:
        return seed.select("node", F.col("score").cast("double").alias("rank"))
    start = seed.select("node", (F.col("score") / (total or 1.0)).alias("start"))
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    base = durable(start.join(out, F.col("node") == F.col("src"), "left").select("node", "start", "out"), "rank-nodes")
    links = durable(edges.join(out, "src").select("src", "dst", "out"), "rank-links")
    rank = base.select("node", F.col("start").alias("rank"))
    for i in range(iterations):
        moved = links.join(rank, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(damping * F.col("rank") / F.col("out")).alias("gain"))
        idle = base.join(rank, "node").filter(F.col("out").isNull()).agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("idle"))
        x = base.join(moved, F.col("node") == F.col("dst"), "left").crossJoin(F.broadcast(idle))  # one row
        rank = x.select("node", ((1 - damping) * F.col("start") + F.coalesce("gain", F.lit(0.0)) + damping * F.col("idle") / n).alias("rank"))
        if i % 4 == 3 and i + 1 < iterations:
            rank = durable(rank, f"rank-{i}")
    return rank


def weighted_pagerank(seed: DataFrame, edges: DataFrame, iterations: int = 12, damping: float = 0.85) -> DataFrame:
    """``node, rank`` as ``pagerank``, with each node's rank split over its edges (src, dst, weight) by weight. Parallel edges add up; nodes without edges
    and edges of no weight pass their mass on by the seed."""
    total = seed.agg(F.sum("score")).first()[0]
    if not total:
        return seed.select("node", F.lit(0.0).alias("rank")).limit(0)
    e = edges.filter(F.col("weight") > 0).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = e.groupBy("src").agg(F.sum("weight").alias("out"))
    base = durable(seed.select("node", (F.col("score") / total).alias("start")).join(out, F.col("node") == F.col("src"), "left").select("node", "start", "out"), "wrank-nodes")
    links = durable(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), "wrank-links")
    rank = base.select("node", F.col("start").alias("rank"))
    for i in range(iterations):
        moved = links.join(rank, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(damping * F.col("rank") * F.col("share")).alias("gain"))
        idle = base.join(rank, "node").filter(F.col("out").isNull()).agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("idle"))
        x = base.join(moved, F.col("node") == F.col("dst"), "left").crossJoin(F.broadcast(idle))  # one row
        rank = x.select("node", ((1 - damping + damping * F.col("idle")) * F.col("start") + F.coalesce("gain", F.lit(0.0))).alias("rank"))
        if i % 4 == 3 and i + 1 < iterations:
            rank = durable(rank, f"wrank-{i}")
    return rank


def closure(roots: DataFrame, edges: DataFrame, max_depth: int = 4) -> DataFrame:
    """``node, depth`` of everything reached from ``roots`` (node) along ``edges`` (src, dst) in at most ``max_depth`` steps, each node at its least depth."""
    seen = durable(roots.select("node").distinct().withColumn("depth", F.lit(0)), "closure-0")
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = durable(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), f"closure-{depth}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def callers(edges: DataFrame) -> DataFrame:
    """The edges turned round."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def blend(lexical: DataFrame, similar: DataFrame, referenced: DataFrame, key: list[str]) -> DataFrame:
    """Sum of three scores (``score`` each), each divided by its largest value per query; absent scores count 0."""
    from pyspark.sql.window import Window

    def scaled(df: DataFrame, name: str) -> DataFrame:
        top = F.max("score").over(Window.partitionBy(key[0]))
        return df.select(*key, F.when(top > 0, F.col("score") / top).otherwise(0.0).alias(name))

    x = scaled(lexical, "a").join(scaled(similar, "b"), key, "left").join(scaled(referenced, "c"), key, "left")
    return x.select(*key, (F.col("a") + F.coalesce("b", F.lit(0.0)) + F.coalesce("c", F.lit(0.0))).alias("score"))
