import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lineweave.plans.skew import hot_split_join, in_blocks, running_total


@pytest.mark.parametrize("share", [0.0005, 0.2, 1.0])
def test_hot_split_join_equals_a_join(spark, share):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.4 else r.choice([None, *map(str, range(50))]), i) for i in range(1500)]
    big = spark.createDataFrame(rows, "k string, v int")
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("first"))
    got = hot_split_join(big, small, ["k"], "n", len(rows), share)
    want = {k: (sum(1 for a, _ in rows if a == k), min(v for a, v in rows if a == k)) for k, _ in rows}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((k, v, *want[k]) for k, v in rows), key=str)


def test_running_total_over_groups_that_span_partitions(spark):
    r = random.Random(2)
    rows = [("big" if r.random() < 0.6 else r.choice([None, "x", "y"]), i, r.randrange(5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o int, w bigint").repartition(5)
    got = {(x.g, x.o): x.before for x in running_total(df, ["g"], [F.col("o").desc()], F.col("w"), "before", "t", 7).collect()}
    sums = defaultdict(int)
    for g, o, w in sorted(rows, key=lambda x: -x[1]):
        assert got[g, o] == sums[g]
        sums[g] += w
    assert len(got) == len(rows)
    assert running_total(df.limit(0), ["g"], [F.col("o")], F.col("w"), "before", "t").count() == 0


def test_blocks_hold_every_row_once(spark):
    df = spark.range(100)
    assert len(in_blocks(df, ["id"], 1000)) == 1
    parts = in_blocks(df, ["id"], 30)
    assert len(parts) == 4 and sorted(r.id for p in parts for r in p.collect()) == list(range(100))


def test_released_tables_are_gone_and_results_stay(spark, tmp_path):
    from lineweave.plans.durable import durable, release

    release(spark)
    x = durable(spark.range(5), "release-test")
    x.write.parquet(str(tmp_path / "out"))
    (path,) = {f.rsplit("/", 1)[0] for f in x.inputFiles()}
    assert os.path.isdir(path.replace("file://", "")) and release(spark) == 1
    assert not os.path.isdir(path.replace("file://", "")) and spark.read.parquet(str(tmp_path / "out")).count() == 5 and release(spark) == 0
