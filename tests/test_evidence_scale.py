"""Work of the evidence queries that must not grow with what can't be in the result."""

from pyspark.sql import functions as F

from lineweave.operators import search


def table(spark):
    files = [(f"a{i:03}.py", "\n" * (i % 7) + f"the ledger {i}\nxqueuex {i}" + "\nqueue" * (i % 3 == 0)) for i in range(120)]
    f = spark.createDataFrame(files, "source string, text string")
    lines = f.select("source", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    return f, lines, spark.createDataFrame([(1, "ledger"), (2, "queue"), (3, "queue ledger")], "query_id bigint, query_text string")


def test_lines_are_taken_of_the_best_files_first(spark, monkeypatch):
    """a question with enough lines in its best files has no other file's lines compared."""
    f, lines, q = table(spark)
    seen, best = [], search._best_lines
    monkeypatch.setattr(search, "_best_lines", lambda rows, head, *more: (seen.append(head.count()), best(rows, head, *more))[1])
    some = lambda: sorted(map(tuple, search.evidence_hits(f, lines, q, top_k=5).collect()))
    got = some()
    assert sum(seen) < 3 * 120
    monkeypatch.setattr(search, "FEW", 1000)
    assert got == some() != []


def test_one_automaton_serves_all_blocks(spark, monkeypatch):
    """the texts are read once, not once a block of questions."""
    f, _, q = table(spark)
    built, make, blocks = [], search._substrings, search.score.question_blocks
    monkeypatch.setattr(search, "_substrings", lambda words: (built.append(words), make(words))[1])
    want = sorted(map(tuple, search.evidence_files(f, q, 5).collect()))
    monkeypatch.setattr(search.score, "question_blocks", lambda queries, terms: blocks(queries, terms, 1))
    built.clear()
    assert sorted(map(tuple, search.evidence_files(f, q, 5).collect())) == want != [] and len(built) == 1
