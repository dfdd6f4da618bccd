"""Ranking spans for queries: BM25, keyword coverage, sub-word and dense similarity, and fusion of rankings.

All scorers are joins on terms or buckets with partial aggregation; queries and spans are never crossed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineweave.functions import text as T
from lineweave.operators import score
from lineweave.plans.skew import in_blocks

SPAN = ["source", "token_start", "token_end"]


def stable_rank(df: DataFrame, score: str, out: str, partition: list[str]) -> DataFrame:
    """Rank from 1 by score descending, then source and token range."""
    w = Window.partitionBy(*partition).orderBy(F.col(score).desc(), *SPAN)
    return df.withColumn(out, F.row_number().over(w))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, n_terms``; queries without keywords give no row."""
    k = queries.select("query_id", T.keywords(F.col("query_text")).alias("k"))
    return k.select("query_id", F.explode("k").alias("term"), F.size("k").alias("n_terms"))


def bm25(spans: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, top_k: int | None = None) -> DataFrame:
    """``query_id``, span key and score > 0. A term counts once a span; a span's length is its number of distinct terms.

    Corpus statistics (number of spans, mean length, document frequency) are one pass each with map-side sums; only the postings of asked terms
    are scored. With ``top_k`` nothing but the best of each task is shuffled (see ``score``); ties go by key, scores being compared to nine places.
    """
    if top_k:
        index = score.keyword_index(spans)
        found = [score.top(index, score.Bm25(index, q, k1, b), top_k) for q in score.question_blocks(queries, T.keywords(F.col("query_text")))]
        return _with_keys(found, index, queries).select("query_id", *SPAN, (F.col("points") / score.PLACES).alias("score"))
    key = SPAN
    terms = spans.select(*key, T.keywords(F.col("text")).alias("k")).withColumn("dl", F.size("k"))
    corpus = terms.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    q = query_terms(queries)
    asked = q.select("term").distinct()
    postings = terms.select(*key, "dl", F.explode("k").alias("term")).join(asked, "term", "left_semi")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    df = df.crossJoin(F.broadcast(corpus))  # one row of statistics
    scored = postings.join(df, "term").withColumn("w", weight).select("term", *key, "w")
    scored = scored.join(q.select("query_id", "term"), "term").groupBy("query_id", *key).agg(F.sum("w").alias("score")).filter(F.col("score") > 0)
    return scored


def _with_keys(found: list[DataFrame], index: DataFrame, queries: DataFrame) -> DataFrame:
    """The found rows of all blocks of questions with their spans' keys."""
    if not found:
        found = [queries.select("query_id", F.lit(0).cast("bigint").alias("span_no"), F.lit(0).cast("bigint").alias("points"), F.lit(1).alias("rank")).limit(0)]
    return reduce(DataFrame.unionByName, found).join(index.select("span_no", *SPAN), "span_no")


def lexical_top(spans: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best spans of each question by ``lexical_coverage``, with its parts; nothing but the best of each task is shuffled."""
    index = score.keyword_index(spans)
    found = [score.top(index, score.Coverage(index, q), k) for q in score.question_blocks(queries, T.keywords(F.col("query_text")))]
    best = _with_keys(found, index, queries).select("query_id", "span_no", *SPAN)
    terms = queries.select("query_id", T.keywords(F.col("query_text")).alias("k"))
    x = best.join(index.select("span_no", "terms", "path_terms", "n_tokens"), "span_no").join(terms, "query_id")
    n = F.size("k")
    hits, path = F.size(F.array_intersect("k", "terms")).cast("bigint"), F.size(F.array_intersect("k", "path_terms"))
    cover, density, bonus = hits / n, hits / F.col("n_tokens"), 0.5 * path / n
    return x.select(
        "query_id", *SPAN, cover.alias("lexical_coverage"), density.alias("lexical_density"), hits.alias("lexical_match_count"), bonus.alias("path_bonus"), (cover + density + bonus).alias("score"),
        F.when(hits > 0, "lexical_anchor").otherwise("path_anchor").alias("reason"),
    )


def fused_top(spans: DataFrame, queries: DataFrame, k: int = 64) -> DataFrame:
    """The ``k`` best spans of each question by reciprocal rank fusion of BM25 and coverage, exactly as over complete rankings: ``query_id``, span key,
    ``rrf, bm25, coverage, n_signals``."""
    index = score.keyword_index(spans)
    found = [score.fused_top(index, q, k) for q in score.question_blocks(queries, T.keywords(F.col("query_text")))]
    if not found:
        return spans.select(F.lit(0).cast("bigint").alias("query_id"), *SPAN, *[F.lit(0.0).alias(c) for c in ("rrf", "bm25", "coverage")], F.lit(0).alias("n_signals")).limit(0)
    x = reduce(DataFrame.unionByName, found).join(index.select("span_no", *SPAN), "span_no")
    return x.select("query_id", *SPAN, "rrf", "bm25", "coverage", (F.col("bm25").isNotNull().cast("int") + F.col("coverage").isNotNull().cast("int")).alias("n_signals"))


def duplicate_ratio(spans: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, duplicate_ratio`` of the rankings by BM25 and coverage, counted where the spans lie; one sum a question and task is shuffled."""
    index = score.keyword_index(spans)
    found = [score.signal_counts(index, q) for q in score.question_blocks(queries, T.keywords(F.col("query_text")))]
    if not found:
        return queries.select("query_id", F.lit(0.0).alias("duplicate_ratio")).limit(0)
    return reduce(DataFrame.unionByName, found).select("query_id", ((F.col("entries") - F.col("spans")) / F.col("entries")).alias("duplicate_ratio"))


def lexical_coverage(spans: DataFrame, queries: DataFrame) -> DataFrame:
    """Share of a query's terms in each span's text, their density, and half the share in its path; spans with neither give no row."""
    q = query_terms(queries)
    n_tokens = F.greatest(F.col("token_end") - F.col("token_start"), F.lit(1))
    text = spans.select(*SPAN, n_tokens.alias("n_tokens"), F.explode(T.keywords(F.col("text"))).alias("term"))
    matched = text.join(q, "term").groupBy("query_id", *SPAN, "n_tokens", "n_terms").agg(F.count("*").alias("hits"))
    path = spans.select("source").distinct().select("source", F.explode(T.path_keywords(F.col("source"))).alias("term"))
    by_path = path.join(q, "term").groupBy("query_id", "source", "n_terms").agg(F.count("*").alias("path_hits"))
    anchored = by_path.join(spans.select(*SPAN, n_tokens.alias("n_tokens")), "source").select("query_id", *SPAN, "n_tokens", "n_terms", F.lit(0).cast("bigint").alias("hits"), "path_hits")
    both = matched.withColumn("path_hits", F.lit(0).cast("bigint")).unionByName(anchored)
    both = both.groupBy("query_id", *SPAN, "n_tokens", "n_terms").agg(F.sum("hits").alias("hits"), F.sum("path_hits").alias("path_hits"))
    cover, density, bonus = F.col("hits") / F.col("n_terms"), F.col("hits") / F.col("n_tokens"), 0.5 * F.col("path_hits") / F.col("n_terms")
    return both.select(
        "query_id", *SPAN, cover.alias("lexical_coverage"), density.alias("lexical_density"), F.col("hits").alias("lexical_match_count"), bonus.alias("path_bonus"), (cover + density + bonus).alias("score"),
        F.when(F.col("hits") > 0, "lexical_anchor").otherwise("path_anchor").alias("reason"),
    )


def hash_features(texts: DataFrame, key: list[str], dims: int = 4096) -> DataFrame:
    """Long form of normalised sub-word features: each word weighs 2, each 3- and 4-gram of the padded word 1."""
    words = texts.select(*key, F.explode(F.regexp_extract_all(T.casefold(F.col("text")), F.lit("([a-z0-9_]+)"), 1)).alias("w"))
    words = words.groupBy(*key, "w").agg(F.count("*").alias("c"))
    padded = F.concat(F.lit("#"), F.col("w"), F.lit("#"))

    def grams(n: int) -> Column:
        last = F.length(padded) - n + 1
        at = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.concat(F.lit("c:"), F.substring(padded, i, F.lit(n))).alias("t"), F.lit(1.0).alias("x")))

    whole = F.array(F.struct(F.concat(F.lit("w:"), F.col("w")).alias("t"), F.lit(2.0).alias("x")))
    x = words.select(*key, "c", F.explode(F.concat(whole, grams(3), grams(4))).alias("f"))
    x = x.groupBy(*key, T.bucket(F.col("f.t"), dims).alias("bucket")).agg(F.sum(F.col("f.x") * F.col("c")).alias("weight"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(*key)))
    return x.withColumn("weight", F.col("weight") / norm)


def heaviest(features: DataFrame, key: list[str], keep: int = 256) -> DataFrame:
    """The heaviest ``keep`` features of each key, normalised again; ties by bucket."""
    w = Window.partitionBy(*key).orderBy(F.col("weight").desc(), "bucket")
    x = features.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= keep).drop("__n")
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(*key)))
    return x.withColumn("weight", F.col("weight") / norm)


def sparse_cosine(a: DataFrame, b: DataFrame, a_key: list[str], b_key: list[str], floor: float = 0.02) -> DataFrame:
    """Cosine of two feature tables by a join on buckets; pairs at or below ``floor`` are dropped."""
    y = b.select(*b_key, "bucket", F.col("weight").alias("weight2"))
    x = a.join(y, "bucket").groupBy(*a_key, *b_key).agg(F.sum(F.col("weight") * F.col("weight2")).alias("score"))
    return x.filter(F.col("score") > floor)


def subword_top(spans: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best spans of each question by sub-word cosine above 0.02: ``query_id``, span key, ``score``. Questions go to the spans in blocks; the
    result is that of ``sparse_cosine`` over ``hash_features``, without a join."""
    index = score.subword_index(spans)
    found = [score.top(index, score.Subword(q), k) for q in score.subword_questions(queries)]
    return _with_keys(found, index, queries).select("query_id", *SPAN, (F.col("points") / score.PLACES).alias("score"))


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """The ``k`` vectors nearest by cosine to each query vector (query_id, q), exactly. The stated queries meet all vectors in blocks of ``block``."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)

    v = vectors.select("vec_id", "embedding", F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("nv"))
    q = queries.select("query_id", "q", F.sqrt(dot(F.col("q"), F.col("q"))).alias("nq"))
    x = reduce(DataFrame.unionByName, [v.join(b, F.col("vec_id") != F.col("query_id")) for b in in_blocks(q, ["query_id"], block)])
    x = x.select("query_id", "vec_id", (dot(F.col("embedding"), F.col("q")) / (F.col("nv") * F.col("nq"))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "vec_id")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(groups: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, span key, score): rank of each distinct span in each group, summed 1 / (k + rank)."""
    parts = []
    for name, g in sorted(groups.items()):
        best = g.groupBy("query_id", *SPAN).agg(F.max("score").alias("score"))
        parts.append(stable_rank(best.withColumn("score", F.round("score", 9)), "score", "r", ["query_id"]).select("query_id", *SPAN, F.lit(name).alias("group"), "r", "score"))
    x = reduce(DataFrame.unionByName, parts)
    return x.groupBy("query_id", *SPAN).agg(
        F.sum(1 / (k + F.col("r"))).alias("rrf"), F.array_sort(F.collect_list("group")).alias("selection_reasons"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("group", "score")))).alias("score_components")
    )


def duplicate_span_ratio(groups: dict[str, DataFrame]) -> DataFrame:
    """Share of (group, span) entries beyond the first of each span, per query."""
    x = reduce(DataFrame.unionByName, [g.select("query_id", *SPAN) for g in groups.values()])
    x = x.groupBy("query_id", *SPAN).agg(F.count("*").alias("c")).groupBy("query_id").agg(F.sum("c").alias("n"), F.count("*").alias("d"))
    return x.select("query_id", ((F.col("n") - F.col("d")) / F.col("n")).alias("duplicate_ratio"))


def token_blocks(texts: DataFrame, block: int) -> DataFrame:
    """Blocks of a fixed number of white-space tokens, not aligned with lines: ``source, block, start, end``."""
    n = T.token_count(F.col("text"))
    x = texts.select("source", n.alias("n")).filter(F.col("n") > 0)
    x = x.select("source", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))).alias("block"))
    return x.select("source", "block", (F.col("block") * block).alias("start"), F.least((F.col("block") + 1) * block, F.col("n")).alias("end"))


def camel_words(c: Column) -> Column:
    """Lower-case words of at least two characters, camel case split, as often as they occur."""
    split = F.regexp_replace(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.regexp_extract_all(F.lower(split), F.lit("([a-z0-9]+)"), 1), lambda t: F.length(t) > 1)


def tf_bm25(chunks: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` best chunks of each question by BM25 with term frequencies over camel-case-split words: ``query_id, chunk, score, rank``. Ties by chunk."""
    index = score.numbered_spans(chunks, camel_words(F.col("text")), key=["chunk"])
    found = [score.top(index, score.Bm25(index, q, k1, b, repeated=True), k) for q in score.question_blocks(queries, F.array_distinct(camel_words(F.col("query_text"))))]
    if not found:
        return chunks.select(F.lit(0).cast("bigint").alias("query_id"), "chunk", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return reduce(DataFrame.unionByName, found).join(index.select("span_no", "chunk"), "span_no").select("query_id", "chunk", (F.col("points") / score.PLACES).alias("score"), "rank")
