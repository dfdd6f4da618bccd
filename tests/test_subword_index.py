"""Sub-word features are computed once, whatever the number of questions."""

from lineweave.operators import rank, score


def test_features_lie_in_the_index_and_questions_add_up_their_words(spark, monkeypatch):
    """one block holds all questions, and its columns are the stored features, not texts."""
    spans = spark.createDataFrame([("a.py", 0, 5, "read the ledger"), ("a.py", 5, 9, ""), ("b.py", 0, 4, "Ledger_X queue")], "source string, token_start bigint, token_end bigint, text string")
    q = spark.createDataFrame([(i, ["ledger read ledger", "queue", "??", None][i % 4]) for i in range(1200)], "query_id bigint, query_text string")
    read, top = [], score.top
    monkeypatch.setattr(score, "top", lambda index, ranker, k: (read.append(ranker.columns), top(index, ranker, k))[1])
    got = rank.subword_top(spans, q, 1).collect()
    assert read == [("span_no", "buckets", "weights")]
    assert {(r.query_id % 4, r.source, r.token_start) for r in got} == {(0, "a.py", 0), (1, "b.py", 0)} and len(got) == 600
