"""Sums that questions share, bounds of the best, and ranks that are counted only where they matter."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineweave.functions import text as T
from lineweave.functions.keywords import Keywords, casefold, path_keywords
from lineweave.operators import rank, score

WORDS = ["ledger", "cache_key", "queue", "span", "Window.size", "read", "emit", "node-id", "plan", "rare"]


@pytest.fixture(scope="module")
def many(spark):
    """More spans than give a first bound, with many ties."""
    r = random.Random(5)
    spans = [(f"a/{r.choice(['queue', 'plan', 'x'])}{i % 9}.py", 10 * i, 10 * i + r.randrange(1, 6), " ".join(r.choices(WORDS, [9, 8, 7, 6, 5, 4, 3, 2, 1, 0.02], k=r.randrange(0, 7)))) for i in range(2600)]
    queries = [(i, " ".join(r.sample(WORDS, r.randrange(1, 5)))) for i in range(12)]
    return spark.createDataFrame(spans, "source string, token_start bigint, token_end bigint, text string"), spark.createDataFrame(queries, "query_id bigint, query_text string")


def rows(df, columns):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def best(df, k, by="score"):
    w = Window.partitionBy("query_id").orderBy(F.round(by, 9).desc(), *rank.SPAN)
    return df.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)


def questions(*asked):
    words = sorted({w for x in asked for w in x})
    pairs = np.array(sorted((words.index(w), i) for i, x in enumerate(asked) for w in x))
    return score.Questions(np.arange(len(asked)), words, np.searchsorted(pairs[:, 0], np.arange(len(words) + 1)), pairs[:, 1], np.array([float(len(x)) for x in asked]))


def test_what_questions_share_is_summed_once(monkeypatch):
    q = questions("abc", "abd", "ab", "c", "")
    added, add = [], score.Postings.add
    monkeypatch.setattr(score.Postings, "add", lambda self, t, before, out: (added.append(t), add(self, t, before, out)))
    held = np.array([[0, 1, 2, 3, 4, 4, 4, 4], [0, 0, 1, 2, 0, 1, 2, 3]])
    walk = score.Walk(q)
    got = {i: sums[0].tolist() for i, sums in walk.over([score.Postings(held[0], held[1], None, 40, 4)], 40)}
    assert {i: x[:5] for i, x in got.items()} == {0: [1, 1, 1, 1, 3], 1: [1, 1, 1, 0, 3], 2: [1, 1, 1, 0, 2], 3: [0, 0, 0, 1, 1], 4: [0] * 5} and len(added) < 9


def test_a_bound_of_the_first_rows_loses_nothing(many):
    spans, q = many
    columns = ["query_id", *rank.SPAN, "score"]
    assert rows(rank.bm25(spans, q, top_k=5), columns) == rows(best(rank.bm25(spans, q), 5), columns)
    assert rows(rank.lexical_top(spans, q, 5), columns) == rows(best(rank.lexical_coverage(spans, q), 5), columns)


def test_only_ranks_that_matter_are_counted(many, monkeypatch):
    """nearly every span of one head only can't be among the best k, so its rank in the other ranking isn't asked for."""
    spans, q = many
    asked, places = [], score.places
    monkeypatch.setattr(score, "places", lambda index, ranker, x: (asked.append(x.count()), places(index, ranker, x))[1])
    groups = {"bm25": rank.bm25(spans, q), "lexical": rank.lexical_coverage(spans, q)}
    columns = ["query_id", *rank.SPAN, "rrf"]
    assert rows(rank.fused_top(spans, q, 2), columns) == rows(best(rank.fuse(groups), 2, "rrf"), columns)
    assert sum(asked) < 0.5 * 12 * (60 + 2 * 2)


def test_keywords_in_batches_are_those_of_the_columns(spark):
    texts = ["Straße ﬁle.Name-x_y the", "a.-b..c __init__ 12ab -x-", "", "ſhift İx Kelvin ẞ", "THE.end of_the", None]
    x = spark.createDataFrame([(t,) for t in texts], "t string")
    got = x.select("t", T.keywords(F.col("t")).alias("k"), T.path_keywords(F.col("t")).alias("p"), T.casefold(F.col("t")).alias("c")).collect()
    words = Keywords()
    assert [(words.of(r.t), path_keywords(r.t)) for r in got if r.t is not None] == [(r.k, r.p) for r in got if r.t is not None]
    assert all(casefold(r.t) == r.c for r in got if r.t is not None)
