"""Candidates scored where they lie: only the best of each task are shuffled, ties and exact names included."""

from pyspark.sql import functions as F

from lineweave.operators import score, symbols


def counted(monkeypatch):
    """The rows that tasks hand on."""
    sent, top = [], score.top
    monkeypatch.setattr(score, "top", lambda index, ranker, k: (sent.append(k), top(index, ranker, k))[1])
    return sent


def test_symbol_candidates_keep_the_best_in_the_tasks(spark, monkeypatch):
    """the same rows as ranking every pair, with 4 rows a question kept in the tasks."""
    sent = counted(monkeypatch)
    s = spark.range(300).select(F.col("id").alias("symbol_id"), F.lit("a.py").alias("source"), F.concat(F.lit("loadX"), F.col("id") % 7).alias("name"), F.when(F.col("id") % 3 == 0, "import").otherwise("function").alias("kind"), F.lit(0).alias("start"), (F.col("id") % 5).cast("int").alias("end"),
                                F.when(F.col("id") % 4 > 0, F.array(F.lit("load_plan"), F.lit(None).cast("string"))).alias("defines"), F.array(F.lit("Ledger")).alias("refs"), F.when(F.col("id") % 6 > 0, F.lit("the plan of queue")).alias("text"))
    q = spark.createDataFrame([(1, "load plan"), (2, "where is loadX3 loadX3 read"), (3, "the"), (4, None), (5, "queue ledger zebra")], "query_id bigint, query_text string")
    x = symbols.symbol_candidates(s, q, None).withColumn("score", F.col("symbol_coverage") + F.col("lexical_coverage"))
    every = sorted(x.collect(), key=lambda r: (r.query_id, -r.symbol_name_match, -round(r.score, 9), r.symbol_id))
    want = [(r.query_id, r.symbol_id, round(r.score, 6), r.symbol_name_match) for i in range(1, 6) for r in [y for y in every if y.query_id == i][:4]]
    got = sorted(symbols.top_candidates(s, q, 4).collect(), key=lambda r: (r.query_id, r["rank"]))
    assert [(r.query_id, r.symbol_id, round(r.score, 6), r.symbol_name_match) for r in got] == want != [] and set(sent) == {4}
