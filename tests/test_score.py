"""Scoring in place against the joins that it replaces, and the re-rank against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineweave.operators import rank, score, search

WORDS = ["ledger", "cache_key", "queue", "span", "Window.size", "read", "emit", "node-id", "plan", "the"]


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(1)
    spans = [(f"a/{r.choice(['queue', 'plan', 'x'])}{i % 7}.py", 10 * i, 10 * i + r.randrange(0, 9), " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 12)))) for i in range(200)]
    spans += [("b.py", 0, 5, "ledger ledger"), ("b.py", 5, 9, ""), ("big.py", 0, 9000, "queue " * 9000)]
    queries = [(i, " ".join(r.sample(WORDS, r.randrange(1, 5)))) for i in range(12)] + [(50, ""), (51, None), (52, "unknownword"), (53, "the")]
    return spark.createDataFrame(spans, "source string, token_start bigint, token_end bigint, text string"), spark.createDataFrame(queries, "query_id bigint, query_text string")


def plain(df, columns):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def best(df, k, by="score"):
    w = Window.partitionBy("query_id").orderBy(F.round(by, 9).desc(), *rank.SPAN)
    return df.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)


def test_top_of_each_ranking_equals_the_joined_one(data, monkeypatch):
    monkeypatch.setattr(score, "CHUNK", 64)
    spans, queries = data
    columns = ["query_id", *rank.SPAN, "score"]
    assert plain(rank.bm25(spans, queries, top_k=7), columns) == plain(best(rank.bm25(spans, queries), 7), columns)
    columns += ["lexical_coverage", "lexical_density", "path_bonus", "lexical_match_count", "reason"]
    assert plain(rank.lexical_top(spans, queries, 7), columns) == plain(best(rank.lexical_coverage(spans, queries), 7), columns)


def test_fused_top_equals_fusion_of_complete_rankings(data):
    spans, queries = data
    groups = {"bm25": rank.bm25(spans, queries), "lexical": rank.lexical_coverage(spans, queries)}
    columns = ["query_id", *rank.SPAN, "rrf"]
    assert plain(rank.fused_top(spans, queries, 3), columns) == plain(best(rank.fuse(groups), 3, "rrf"), columns)
    assert plain(rank.duplicate_ratio(spans, queries), ["query_id", "duplicate_ratio"]) == plain(rank.duplicate_span_ratio(groups), ["query_id", "duplicate_ratio"])


def test_places_beyond_the_head_are_exact(data):
    """With a depth of 1 nearly every rank in the other list has to be counted."""
    spans, queries = data
    index = score.keyword_index(spans)
    (q,) = score.question_blocks(queries, F.expr("split(query_text, ' ')"), 100)
    ranker = score.Coverage(index, q)
    every = score.top(index, ranker, 1000)
    some = every.filter("rank % 3 = 2")
    assert plain(score.places(index, ranker, some), ["query_id", "span_no", "points", "rank"]) == plain(some, ["query_id", "span_no", "points", "rank"])


def test_blocks_of_questions_change_nothing(data):
    spans, queries = data
    index = score.keyword_index(spans)
    terms = F.expr("filter(split(query_text, ' '), t -> t <> '')")
    got = [plain(x, x.columns) for block in (3, 1000) for x in [_all([score.top(index, score.Bm25(index, q), 5) for q in score.question_blocks(queries, terms, block)]).select("query_id", "span_no", "rank")]]
    assert got[0] == got[1] != []


def _all(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def test_subword_top_equals_joined_features(data):
    spans, queries = data
    s = rank.heaviest(rank.hash_features(spans, rank.SPAN), rank.SPAN)
    q = rank.hash_features(queries.select("query_id", F.col("query_text").alias("text")), ["query_id"])
    columns = ["query_id", *rank.SPAN, "score"]
    assert plain(rank.subword_top(spans, queries, 5), columns) == plain(best(rank.sparse_cosine(q, s, ["query_id"], rank.SPAN), 5), columns)


def test_empty_tables_give_nothing(data):
    spans, queries = data
    for s, q in ((spans.limit(0), queries), (spans, queries.limit(0))):
        assert rank.bm25(s, q, top_k=3).count() == rank.lexical_top(s, q, 3).count() == rank.fused_top(s, q, 3).count() == rank.duplicate_ratio(s, q).count() == 0


def features(text, keep=None):
    x = defaultdict(float)
    for w, n in Counter(re.findall("[a-z0-9_]+", text.lower())).items():
        p = f"#{w}#"
        for t, v in [(f"w:{w}", 2.0), *((f"c:{p[i : i + k]}", 1.0) for k in (3, 4) for i in range(len(p) - k + 1))]:
            x[crc32(t.encode()) % 4096] += v * n
    cut = lambda y: {b: v / (math.sqrt(sum(z * z for z in y.values())) or 1.0) for b, v in y.items()}
    x = cut(x)
    return cut(dict(sorted(x.items(), key=lambda i: (-i[1], i[0]))[:keep])) if keep and len(x) > keep else x


def test_rerank_equals_plain_python(spark):
    r = random.Random(3)
    names = ["PluginGc", "collect_idle", "Session", "stop_timer", "x1"]
    files = [(f"src/f{i}.py", "\n".join(" ".join(r.choice([*names, "idle", "plugin", "timer", "stops", "inactive"]) for _ in range(4)) for _ in range(r.randrange(0, 140)))) for i in range(9)]
    defs = [(n, "function", f"src/f{i}.py", 1, 2, i, []) for i, n in enumerate(names)] + [("<anonymous>", "function", "src/f0.py", 1, 1, 9, []), ("idle", "function", "src/f8.py", 1, 1, 10, [])]
    query = "what stops idle plugins"
    scores = [(1, f"src/f{i}.py", float(i + 1)) for i in range(8)] + [(2, "src/f3.py", 4.0)]
    f = spark.createDataFrame(files, "source string, text string")
    d = spark.createDataFrame(defs, "name string, kind string, source string, line_start int, line_end int, ordinal bigint, refs array<string>")
    q = spark.createDataFrame([(1, query), (2, query)], "query_id bigint, query_text string")
    got = {(x.query_id, x.source): x.score for x in search.rerank(f, d, q, spark.createDataFrame([x for x in scores if x[2] > 2], "query_id bigint, source string, score double")).collect()}
    assert got.pop((2, "src/f3.py")) == 4.0

    text = dict(files)
    lexical = {s: v / 8 for _, s, v in scores[:8]}
    head = sorted(lexical, key=lambda s: -lexical[s])[:6]
    asked = features(query)
    similar = {}
    for s in head:
        lines = text[s].split("\n") if text[s] else []
        blocks = [features(f"{s}\n" + "\n".join(lines[c : c + 60]), 256) for c in range(0, max(len(lines), 1), 60)]
        similar[s] = max(sum(v * b.get(k, 0.0) for k, v in asked.items()) for b in blocks)
    owners = defaultdict(set)
    for n, _, s, *_ in defs:
        if s in head and n != "<anonymous>":
            owners[n].add(s)
    out = {s: set().union(*[owners[n] for n in set(re.findall("[A-Za-z_][A-Za-z0-9_]{2,}", text[s])) if n in owners] or [set()]) - {s} for s in head}
    total = sum(lexical[s] for s in head)
    start = {s: lexical[s] / total for s in head}
    walk = dict(start)
    for _ in range(12):
        after = {s: 0.15 * start[s] for s in head}
        for s in head:
            for t in out[s] or head:
                after[t] += 0.85 * walk[s] / len(out[s] or head)
        walk = after
    scaled = lambda x: {s: v / max(x.values()) for s, v in x.items()}
    want = {(1, s): lexical[s] + scaled(similar)[s] + scaled(walk)[s] for s in head}
    assert got == pytest.approx(want)


def test_lines_beyond_the_head_are_found_where_the_head_has_too_few(spark):
    """The rarest words stand in files whose lines hold them only within other words, so the head alone gives no line."""
    files = [(f"a{i}.py", f"xxledgerxx {i}") for i in range(20)] + [(f"z{i}.py", "\n" * 50 + "the ledger\nthe queue") for i in range(6)]
    f = spark.createDataFrame(files, "source string, text string").withColumn("term", F.lit("clash"))
    lines = f.select("source", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    q = spark.createDataFrame([(1, "ledger"), (2, "queue"), (3, ""), (4, None)], "query_id bigint, query_text string")
    some = lambda head: sorted((r.query_id, r["rank"], r.source, r.line) for r in search.evidence_hits(f, lines, q, top_k=4, head=head).collect())
    assert some(2) == some(1000) and [x[2:] for x in some(2) if x[0] == 1] == [(f"z{i}.py", 51) for i in range(4)]
    assert search.evidence_hits(f, lines, q.limit(0)).count() == 0 == search.evidence_hits(f.limit(0), lines.limit(0), q).count()
