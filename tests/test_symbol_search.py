"""Definitions scored where they lie: only the best of each task are shuffled, ties and exact names included."""

from pyspark.sql import functions as F

from lineweave.operators import score, search


def counted(monkeypatch):
    """The rows that tasks hand on."""
    sent, top = [], score.top
    monkeypatch.setattr(score, "top", lambda index, ranker, k: (sent.append(k), top(index, ranker, k))[1])
    return sent


def test_a_name_part_of_all_definitions_is_not_joined(spark, monkeypatch):
    """each question meets all 300 definitions by a part; 3 rows a question are kept in the tasks."""
    sent = counted(monkeypatch)
    d = spark.range(300).select(F.concat(F.lit("get_x"), F.col("id")).alias("name"), F.when(F.col("id") % 2 == 0, "impl").otherwise("function").alias("kind"), F.lit("a.py").alias("source"), F.col("id").cast("int").alias("line_start"), F.col("id").cast("int").alias("line_end"))
    q = spark.createDataFrame([(1, "get"), (2, "get the GET_X7 now"), (3, "get_x7"), (4, None), (5, "zebra")], "query_id bigint, query_text string")
    got = {i: [(r.name, r.score) for r in sorted(search.find_symbols(d, q, top_k=3).filter(F.col("query_id") == i).collect(), key=lambda r: r["rank"])] for i in range(1, 6)}
    assert sent and set(sent) == {3}
    assert got[1] == [("get_x1", 1.5), ("get_x3", 1.5), ("get_x5", 1.5)] and got[3] == [("get_x7", 4.5)] and got[4] == got[5] == []
    assert [n for n, _ in got[2]] == ["get_x7", "get_x17", "get_x27"] or got[2][0][0] == "get_x7"
