"""Joins and orderings that hold when one key owns a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineweave.plans.durable import durable

#: A key is hot when it holds more than this share of all rows, so there are at most 1/HOT_SHARE hot keys.
HOT_SHARE = 0.001


def hot_split_join(big: DataFrame, small: DataFrame, keys: Sequence[str], count: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row per key, with the key's row count in ``count``).

    Keys that hold more than ``share * total`` rows of ``big`` are at most ``1 / share`` by arithmetic, so they are broadcast; their rows are
    never shuffled. All other keys own at most that share and go through a shuffle join. ``big`` is read twice and should be cheap to read.
    Null keys match each other. ``count`` stays in the result.
    """
    limit = max(1.0, share * total)
    hot = F.broadcast(small.filter(F.col(count) > limit).toDF(*[f"__s_{c}" for c in small.columns]))
    cold = small.filter(F.col(count) <= limit).toDF(*[f"__s_{c}" for c in small.columns])
    extra = [c for c in small.columns if c not in keys]

    def on(b: DataFrame, s: DataFrame) -> Column:
        cond = F.lit(True)
        for k in keys:
            cond = cond & b[k].eqNullSafe(s[f"__s_{k}"])
        return cond

    def shape(x: DataFrame) -> DataFrame:
        return x.select(*big.columns, *[F.col(f"__s_{c}").alias(c) for c in extra])

    hits = shape(big.join(hot, on(big, hot), "inner"))
    rest = big.join(F.broadcast(hot.select(*[f"__s_{k}" for k in keys])), on(big, hot), "left_anti")
    return hits.unionByName(shape(rest.join(cold, on(rest, cold), "inner")))


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[Column], weight: Column, out: str, tag: str, partitions: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of the same group that come before this one.

    The rows are range-partitioned by group and order, so a group of any size spreads over many tasks; each task sums its own slice, and only one
    total a slice and group is carried over. ``order`` must be total within a group. Cuts lineage once, so both passes see the same slices.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = df.withColumn("__w", weight).repartitionByRange(n, *[F.col(c) for c in group], *order).withColumn("__p", F.spark_partition_id())
    x = durable(x, tag)
    keys = [*group, "__p"]
    before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    slices = x.groupBy(*keys).agg(F.sum("__w").alias("__t")).withColumn("__o", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    slices = slices.toDF(*[f"__k{i}" for i in range(len(keys))], "__o")
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    y = x.withColumn("__l", F.coalesce(F.sum("__w").over(own), F.lit(0)))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return y.join(slices, cond, "inner").withColumn(out, F.col("__l") + F.col("__o")).drop("__w", "__p", "__l", "__o", *slices.columns)


def in_blocks(df: DataFrame, keys: Sequence[str], rows: int) -> list[DataFrame]:
    """``df`` (a stated set of queries) dealt by hash into broadcast blocks of about ``rows`` rows each, so that no broadcast grows with the set."""
    n = df.count()
    blocks = max(1, -(-n // rows))
    if blocks == 1:
        return [F.broadcast(df)]
    slot = F.pmod(F.xxhash64(*keys), F.lit(blocks))
    return [F.broadcast(df.filter(slot == i)) for i in range(blocks)]
