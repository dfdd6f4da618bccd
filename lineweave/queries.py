"""Registry of the core's queries and their SQL. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineweave.functions import text as T
from lineweave.operators import accounting, chunk, evalkit, graph, pack, rank, review, search, select, symbols, trace, trials
from lineweave.sources import workspace
from lineweave.sources.tables import table
from lineweave.streaming import usage

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- SQL building blocks -------------------------------------------------------------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_PROSE = "[" + ", ".join(f"'{w}'" for w in T.PROSE_WORDS) + "]"


def _cf(x: str) -> str:
    for a, b in T.FOLDS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"lower({x})"


def _plain(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({_cf(x)}, '{T.TERM}'), lambda t: trim(t, '.-')), lambda t: t <> '' and not list_contains({_STOP}, t)))"


def _kw(x: str) -> str:
    parts = "string_split_regex(k, '[.-]+')"
    each = f"list_concat([k], list_concat({parts}, flatten(list_transform({parts}, lambda p: string_split(p, '_')))))"
    return f"list_distinct(list_filter(flatten(list_transform({_plain(x)}, lambda k: {each})), lambda t: t <> '' and not list_contains({_STOP}, t)))"


def _pk(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all({_cf(x)}, '[A-Za-z0-9]+'), lambda t: not list_contains({_STOP}, t)))"


def _ident(xs: str) -> str:
    cut = r"regexp_replace(p, '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
    pieces = f"flatten(list_transform({xs}, lambda n: string_split_regex(n, '[_.\\-]+')))"
    return f"list_distinct(list_transform(flatten(list_transform({pieces}, lambda p: regexp_extract_all({cut}, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'))), lambda t: lower(t)))"


_FILES = "files_ as (select distinct relative_path as source, text from files where text is not null)"
_LINES = _FILES + r""", lines_ as (
  select source, unnest(range(1, len(l) + 1)) as line, unnest(l) as text from (
    select source, case when l[-1] = '' then l[:-2] else l end as l from (select source, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as l from files_))
), toks as (select *, len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda t: t <> ''))::int as n_tokens from lines_)"""
_QT = f"qt as (select query_id, len(k)::int as n_terms, unnest(k) as term from (select query_id, {_kw('query_text')} as k from queries))"
_SPANS = "spans as (select span_id, source, token_start, token_end, text from raw_spans where text is not null and token_end > token_start)"


# --- adapters ------------------------------------------------------------------------------------------------------------------------------------------


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable files, each delivered state once: ``source, text``."""
    return table(spark, sf_dir, "files").filter("text is not null").select(F.col("relative_path").alias("source"), "text").distinct()


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with tokens, one per span key: a span delivered twice counts once, by its least identifier."""
    s = table(spark, sf_dir, "raw_spans").filter("text is not null and token_end > token_start")
    return s.groupBy("source", "token_start", "token_end").agg(F.min_by("text", "span_id").alias("text"), F.min_by("line_start", "span_id").alias("line_start"))


_SPANS1 = "sp as (select source, token_start, token_end, arg_min(text, span_id) as text, arg_min(line_start, span_id) as line_start from raw_spans where text is not null and token_end > token_start group by 1, 2, 3)"


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions (no imports) with an ordinal."""
    s = table(spark, sf_dir, "symbols").filter("kind <> 'import'")
    return s.select(F.col("sym_name").alias("name"), "kind", "source", "line_start", "line_end", F.col("symbol_id").alias("ordinal"), "refs")


# --- sources and text ----------------------------------------------------------------------------------------------------------------------------------

_EXT = "(" + ", ".join(f"'{e}'" for e in workspace.EXTENSIONS) + ")"


@query(
    rf"""select distinct relative_path, lower(regexp_extract(relative_path, '(\.[^./]+)$', 1)) as ext from files
where lower(regexp_extract(relative_path, '(\.[^./]+)$', 1)) in {_EXT} and coalesce(size_bytes, 0) <= 200000 and not regexp_matches(relative_path, '(^|/)\.')
and not regexp_matches(relative_path, '^(venv|node_modules|dist|build|__pycache__)/')"""
)
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files", "relative_path", "size_bytes", "ingested_at")
    return workspace.discover(f).select("relative_path", "ext")


@query("select relative_path, count(*) as n from files where regexp_matches(relative_path, '/(src|lib)/') and relative_path like '%.py' group by 1")
def scan_by_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files", "relative_path")
    return f.filter(workspace.included(F.col("relative_path"), ["**/*/src/**/*.py", "*/src/**/*.py", "*/lib/**/*.py", "**/*/lib/**/*.py"])).groupBy("relative_path").agg(F.count("*").alias("n"))


@query("select file_id, sha256(replace(text, chr(13) || chr(10), chr(10))) as fingerprint, sha256(text) = fingerprint as agrees from files where text is not null")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files", "file_id", "text", "fingerprint").filter("text is not null")
    return f.select("file_id", T.fingerprint(F.col("text")).alias("fingerprint"), (F.sha2("text", 256) == F.col("fingerprint")).alias("agrees"))


@query(f"with {_LINES} select source, line, n_tokens, length(text)::int as n_chars from toks")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.lines(files(spark, sf_dir)).select("source", "line", "n_tokens", F.length("text").alias("n_chars"))


@query(f"select query_id, unnest({_kw('query_text')}) as term from queries")
def keyword_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "queries").select("query_id", F.explode(T.keywords(F.col("query_text"))).alias("term"))


@query(f"select doc_id, len({_plain('text')})::int as n_terms, len({_kw('text')})::int as n_expanded from documents where text is not null")
def document_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    return d.select("doc_id", F.size(T.plain_keywords(F.col("text"))).alias("n_terms"), F.size(T.keywords(F.col("text"))).alias("n_expanded"))


@query(f"select distinct relative_path, unnest({_pk('relative_path')}) as term from files")
def path_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files", "relative_path").distinct().select("relative_path", F.explode(T.path_keywords(F.col("relative_path"))).alias("term"))


@query(f"select symbol_id, unnest({_ident('[sym_name]')}) as part from symbols")
def identifier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols", "symbol_id", "sym_name").select("symbol_id", F.explode(T.identifier_terms(F.array("sym_name"))).alias("part"))


@query(
    r"""select cand_id, regexp_extract(p, '^(.+?):(\d+)(?:-(\d+))?$', 1) as path, regexp_extract(p, '^(.+?):(\d+)(?:-(\d+))?$', 2)::int as low,
coalesce(nullif(regexp_extract(p, '^(.+?):(\d+)(?:-(\d+))?$', 3), ''), regexp_extract(p, '^(.+?):(\d+)(?:-(\d+))?$', 2))::int as high
from (select cand_id, metadata.provenance as p from candidates) where regexp_matches(p, '^(.+?):(\d+)(?:-(\d+))?$')"""
)
def parse_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").select("cand_id", F.col("metadata.provenance").alias("p"))
    return workspace.parse_locators(c, "p").filter("low is not null").select("cand_id", "path", "low", "high")


@query("select distinct critical_source as relative_path from tasks where critical_source is not null and critical_source not in (select relative_path from files)")
def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tasks").filter("critical_source is not null").select(F.col("critical_source").alias("relative_path")).distinct()
    return workspace.split_missing(t, table(spark, sf_dir, "files", "relative_path"))[1]


@query(
    """with m as (select distinct critical_source as missing from tasks where critical_source is not null and critical_source not in (select relative_path from files)),
f as (select distinct relative_path as candidate from files),
x as (select missing, candidate, len(list_intersect(string_split(missing, '/'), string_split(candidate, '/')))::int as shared from m join f on string_split(missing, '/')[-1] = string_split(candidate, '/')[-1]),
r as (select *, row_number() over (partition by missing order by shared desc, candidate)::int as rank from x)
select missing, candidate, shared, rank from r where rank <= 3"""
)
def missing_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.suggest(missing_sources(spark, sf_dir), table(spark, sf_dir, "files", "relative_path"))


# --- chunks and windows --------------------------------------------------------------------------------------------------------------------------------


@query(
    f"""with recursive {_LINES}, pos as (
  select source, line, n_tokens, length(text) + 1 as n_chars from toks
), fold as (
  select source, line, 1 as block, n_tokens as pend from pos where line = 1
  union all
  select p.source, p.line, case when f.pend + p.n_tokens > 64 then f.block + 1 else f.block end, case when f.pend + p.n_tokens > 64 then p.n_tokens else f.pend + p.n_tokens end
  from fold f join pos p on p.source = f.source and p.line = f.line + 1
), b as (
  select source, block, min(line)::int as line_start, max(line)::int as line_end, sum(n_tokens) as n from fold join pos using (source, line) group by 1, 2
)
select source, line_start, line_end, (sum(n) over (partition by source order by block) - n)::bigint as token_start, (sum(n) over (partition by source order by block))::bigint as token_end from b"""
)
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_lines(files(spark, sf_dir), 64).select("source", "line_start", "line_end", "token_start", "token_end")


@query(f"with {_LINES} select source, ((line - 1) // 40)::bigint as \"window\", min(line)::int as line_start, max(line)::int as line_end, sum(n_tokens)::bigint as n_tokens from toks group by 1, 2")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.fixed_windows(chunk.lines(files(spark, sf_dir)), 40)


@query(
    f"""with {_LINES}, w as (select source, unnest(range(0, max(line) // 30 + 1)) as k from toks group by source)
select source, k::int as "window", min(line)::int as line_start, max(line)::int as line_end, sum(n_tokens)::bigint as n_tokens
from w join toks using (source) where line > k * 30 and line <= k * 30 + 40 group by 1, 2"""
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.sliding_windows(chunk.lines(files(spark, sf_dir)), 40, 30)


@query(
    """with r as (select source, line_start as low, line_end as high from raw_spans),
a as (select *, max(high) over (partition by source order by low, high rows between unbounded preceding and 1 preceding) as b from r),
i as (select *, sum(case when low <= b + 1 then 0 else 1 end) over (partition by source order by low, high rows unbounded preceding) as k from a)
select source, min(low) as low, max(high) as high from i group by source, k"""
)
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "raw_spans").select("source", F.col("line_start").alias("low"), F.col("line_end").alias("high"))
    return chunk.merge_ranges(r, ["source"], "low", "high").select("source", "low", "high")


@query(
    f"""with {_LINES}, u as (select source, line, sum(n_tokens) over (partition by source order by line) as used from toks)
select source, coalesce(max(line) filter (used <= 200), 0)::int as kept_lines, coalesce(max(used) filter (used <= 200), 0)::bigint as used_tokens, (min(line) filter (used > 200))::int as continue_at from u group by 1"""
)
def range_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.range_prefix(chunk.lines(files(spark, sf_dir)), 200)


@query(
    f"""with {_SPANS1}, x as (select *, token_end - token_start as n from sp), w as (
select source, token_start, token_end, n, coalesce(sum(n) over (partition by source order by token_start, token_end rows between unbounded preceding and 1 preceding), 0) as before,
coalesce(sum(n) over (partition by source order by token_start, token_end rows between 1 following and unbounded following), 0) as after, sum(n) over (partition by source) as total from x)
select source, token_start, token_end, case when total <= 256 or before < 128 then 'prefix' when after < 128 then 'tail' else 'middle' end as zone from w"""
)
def active_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).withColumn("n_tokens", F.col("token_end") - F.col("token_start"))
    return chunk.active_window(s, ["source"], F.struct("token_start", "token_end"), 128, 128).select("source", "token_start", "token_end", "zone")


@query(
    f"""with {_LINES}, h as (select source, greatest(line - 3, 1) as low, line + 3 as high from lines_ where text like '%ledger%' and regexp_matches(text, '\\bledger\\b')),
a as (select *, max(high) over (partition by source order by low, high rows between unbounded preceding and 1 preceding) as b from h),
i as (select *, sum(case when low <= b + 1 then 0 else 1 end) over (partition by source order by low, high rows unbounded preceding) as k from a)
select source, min(low)::int as low, max(high)::int as high from i group by source, k"""
)
def grep_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.neighbourhoods(search.usages(chunk.lines(files(spark, sf_dir)), "ledger"), 3).select("source", "low", "high")


# --- ranking -------------------------------------------------------------------------------------------------------------------------------------------


def _top(df: DataFrame, k: int, columns: list[str]) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "source", "token_start", "token_end")
    x = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return x.select("query_id", "rank", "source", "token_start", "token_end", *[F.round(c, 6).alias(c) for c in columns])


_RANKED = "row_number() over (partition by query_id order by round(score, 9) desc, source, token_start, token_end)::int as rank"
_BM25 = f"""{_SPANS1}, {_QT}, st as (select source, token_start, token_end, {_kw('text')} as k from sp), corpus as (select count(*) as n, avg(len(k)) as avgdl from st),
post as (select source, token_start, token_end, len(k) as dl, unnest(k) as term from st), df as (select term, count(*) as df from post group by 1),
bm as (select query_id, source, token_start, token_end, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
from qt join post using (term) join df using (term), corpus group by 1, 2, 3, 4 having score > 0)"""
_LEX = f"""{_SPANS1}, {_QT}, st as (select source, token_start, token_end, greatest(token_end - token_start, 1) as n_tokens, unnest({_kw('text')}) as term from sp),
hit as (select query_id, source, token_start, token_end, count(*) as hits from st join qt using (term) group by 1, 2, 3, 4),
pt as (select source, unnest({_pk('source')}) as term from (select distinct source from sp)), ph as (select query_id, source, count(*) as path_hits from pt join qt using (term) group by 1, 2),
both_ as (select query_id, source, token_start, token_end, hits, 0 as path_hits from hit union all select query_id, source, token_start, token_end, 0, path_hits from ph join sp using (source)),
lex as (select query_id, source, token_start, token_end, sum(hits) as hits, sum(hits) / max(n_terms) as lexical_coverage, sum(hits) / greatest(token_end - token_start, 1) as lexical_density, 0.5 * sum(path_hits) / max(n_terms) as path_bonus
from both_ join (select distinct query_id, n_terms from qt) using (query_id) group by 1, 2, 3, 4), ls as (select *, lexical_coverage + lexical_density + path_bonus as score from lex)"""


@query(f"with {_BM25}, r as (select *, {_RANKED} from bm) select query_id, rank, source, token_start, token_end, round(score, 6) as score from r where rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(rank.bm25(spans(spark, sf_dir), table(spark, sf_dir, "queries"), top_k=10), 10, ["score"])


@query(
    f"""with {_LEX}, r as (select *, {_RANKED} from ls)
select query_id, rank, source, token_start, token_end, round(lexical_coverage, 6) as lexical_coverage, round(lexical_density, 6) as lexical_density, round(path_bonus, 6) as path_bonus, round(score, 6) as score from r where rank <= 10"""
)
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(rank.lexical_top(spans(spark, sf_dir), table(spark, sf_dir, "queries"), 10), 10, ["lexical_coverage", "lexical_density", "path_bonus", "score"])


_FUSED = f"""with {_BM25}, {_LEX.split(_QT + ',')[1].replace('st as', 'st2 as').replace('from st join', 'from st2 join')},
g as (select 'bm25' as grp, query_id, source, token_start, token_end, {_RANKED} from bm union all select 'lexical', query_id, source, token_start, token_end, {_RANKED} from ls)"""


@query(
    f"""{_FUSED}, f as (select query_id, source, token_start, token_end, sum(1 / (60 + rank)) as score, count(*) as n_signals from g group by 1, 2, 3, 4), r as (select *, {_RANKED} from f)
select query_id, rank, source, token_start, token_end, round(score, 6) as score, n_signals from r where rank <= 10"""
)
def rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = rank.fused_top(spans(spark, sf_dir), table(spark, sf_dir, "queries"), 10).withColumnRenamed("rrf", "score").withColumn("n_signals", F.col("n_signals").cast("bigint"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), *rank.SPAN)
    return f.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("query_id", "rank", *rank.SPAN, F.round("score", 6).alias("score"), "n_signals")


@query(f"{_FUSED}, d as (select query_id, source, token_start, token_end, count(*) as c from g group by 1, 2, 3, 4) select query_id, round((sum(c) - count(*)) / sum(c), 6) as duplicate_ratio from d group by 1")
def duplicate_span_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.duplicate_ratio(spans(spark, sf_dir), table(spark, sf_dir, "queries")).select("query_id", F.round("duplicate_ratio", 6).alias("duplicate_ratio"))


@query()
def subword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by hashed sub-word cosine, their 256 heaviest features."""
    return _top(rank.subword_top(spans(spark, sf_dir), table(spark, sf_dir, "queries"), 5), 5, ["score"])


@query(
    """with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 20 = 0), x as (
select query_id, vec_id, list_cosine_similarity(q::double[], embedding::double[]) as score from q join embeddings on vec_id <> query_id),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id)::int as rank from x)
select query_id, vec_id, rank, round(score, 5) as score from r where rank <= 10"""
)
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose identifier is divisible by 20 against all."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return rank.dense_top_k(e, q, 10).select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


@query(
    r"""with t as (select doc_id as source, len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda t: t <> '')) as n from documents where text is not null),
b as (select source, n, unnest(range(0, (n - 1) // 100 + 1)) as block from t where n > 0)
select source, block::int as block, (block * 100)::int as start, least((block + 1) * 100, n)::int as "end" from b"""
)
def token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("source"), "text")
    return rank.token_blocks(d, 100)


@query(
    r"""with c as (select span_id as chunk, text from raw_spans where text is not null),
w as (select chunk, list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(text, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+'), lambda t: length(t) > 1) as w from c),
k as (select count(*) as n, avg(len(w)) as avgdl from w), tf as (select chunk, dl, term, count(*) as tf from (select chunk, len(w) as dl, unnest(w) as term from w) group by 1, 2, 3),
df as (select term, count(*) as df from tf group by 1),
q as (select query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(query_text, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+'), lambda t: length(t) > 1))) as term from queries),
s as (select query_id, chunk, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from q join tf using (term) join df using (term), k group by 1, 2),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk)::int as rank from s) select query_id, chunk, rank, round(score, 6) as score from r where rank <= 5"""
)
def tf_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "raw_spans").filter("text is not null").select(F.col("span_id").alias("chunk"), "text")
    return rank.tf_bm25(c, table(spark, sf_dir, "queries"), 5).select("query_id", "chunk", "rank", F.round("score", 6).alias("score"))


# --- packing -------------------------------------------------------------------------------------------------------------------------------------------


def candidate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored candidates as packing input; a candidate delivered twice counts once, one without a usable score not at all."""
    c = table(spark, sf_dir, "candidates").filter("rank_score is not null and not isnan(rank_score) and tok_end > tok_start")
    c = c.groupBy("query_id", "source", F.col("tok_start").alias("start"), F.col("tok_end").alias("end"))
    return c.agg(F.min_by("rank_score", "cand_id").alias("rank_score"), F.min_by("text", "cand_id").alias("text"), F.min_by(F.col("metadata.line_start"), "cand_id").alias("line_start"))


@query(
    """with recursive c as (select query_id, source, tok_start as start, tok_end as "end", arg_min(rank_score, cand_id) as s from candidates
where rank_score is not null and not isnan(rank_score) and tok_end > tok_start group by 1, 2, 3, 4),
r as (select *, row_number() over (partition by query_id order by s desc, source, start, "end") as k, "end" - start as n from c), f as (
select query_id, k, case when n <= 300 then n else 0 end as used, n <= 300 as kept from r where k = 1
union all select r.query_id, r.k, case when f.used + r.n <= 300 then f.used + r.n else f.used end, f.used + r.n <= 300 from f join r on r.query_id = f.query_id and r.k = f.k + 1 where r.k <= 64)
select query_id, k::int as rank, source, start, "end", n as n_tokens from f join r using (query_id, k) where kept"""
)
def pack_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack_prefix(candidate_spans(spark, sf_dir), 300)


@query()
def pack_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(candidate_spans(spark, sf_dir), table(spark, sf_dir, "queries"), 600, "score")


@query()
def pack_by_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(candidate_spans(spark, sf_dir), table(spark, sf_dir, "queries"), 600, "coverage")


@query()
def assemble_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank spans for every question by BM25 and coverage, fuse, and pack under a budget with provenance."""
    s = spans(spark, sf_dir)
    f = rank.fused_top(s, table(spark, sf_dir, "queries")).join(s, rank.SPAN)
    c = f.select("query_id", "source", F.col("token_start").alias("start"), F.col("token_end").alias("end"), F.col("rrf").alias("rank_score"), "text", "line_start")
    return pack.pack(c, table(spark, sf_dir, "queries"), 600)


_RANGES = "rg as (select distinct source, line_start as low, line_end as high from raw_spans where span_id % 20 = 0 and line_start is not null and line_end is not null)"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated set of requested ranges: the lines of every twentieth span."""
    s = table(spark, sf_dir, "raw_spans").filter("span_id % 20 = 0 and line_start is not null and line_end is not null")
    return s.select("source", F.col("line_start").alias("low"), F.col("line_end").alias("high")).distinct()


def _scoped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Spans with their repository as scope, and questions asked in one."""
    s = table(spark, sf_dir, "raw_spans").filter("text is not null and token_end > token_start")
    first = F.min_by(F.struct("text", "line_start", "line_end"), "span_id").alias("x")
    s = s.groupBy("source", "token_start", "token_end").agg(first).select(F.split_part("source", F.lit("/"), F.lit(1)).alias("scope"), "source", "token_start", "token_end", "x.*")
    return s, table(spark, sf_dir, "queries").select("query_id", "query_text", F.col("repo").alias("scope"))


@query()
def select_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context for every question out of its repository: all of it within 3000 tokens, else the active window and the packed best. Tested by brute force."""
    return select.select_context(*_scoped(spark, sf_dir), definitions(spark, sf_dir), 3000)


flagship = select_context


_SCOPED = """sp as (select split_part(source, '/', 1) as scope, source, token_start, token_end, arg_min(text, span_id) as text from raw_spans where text is not null and token_end > token_start group by 2, 3, 4),
tot as (select scope, sum(token_end - token_start) as total from sp group by 1)"""


@query(
    f"""with {_SCOPED}, q as (select query_id, repo as scope from queries join tot on repo = scope where total <= 3000)
select query_id, source, token_start as "start", token_end as "end", row_number() over (partition by query_id order by source, token_start, token_end)::int as position from q join sp using (scope)"""
)
def lossless_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions whose whole scope fits."""
    x = select.select_context(*_scoped(spark, sf_dir), definitions(spark, sf_dir), 3000)
    return x.filter("route = 'lossless'").select("query_id", "source", "start", "end", "position")


@query(
    """with x as (select *, case when lag(char_end) over (partition by source order by char_start, char_end) = char_start then 0 else 1 end as n from (select distinct source, char_start, char_end, line_start, line_end from raw_spans where char_start is not null)),
y as (select *, sum(n) over (partition by source order by char_start, char_end rows unbounded preceding) as run from x)
select source, min(line_start) as line_start, max(line_end) as line_end, min(char_start) as char_start, max(char_end) as char_end, count(*) as n_spans from y group by source, run"""
)
def lossless_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "raw_spans", "source", "char_start", "char_end", "line_start", "line_end").filter("char_start is not null").distinct()
    return select.lossless_groups(s)


@query(
    f"""with {_LINES}, {_RANGES}, r as (select source, low, high, row_number() over (order by source, low, high)::int as place from rg where source in (select source from rg)),
x as (select 0 as request_id, place, r.source, line, n_tokens + (line = low)::int as cost from r join toks t on t.source = r.source and t.line between low and high),
y as (select *, sum(cost) over (order by place, line rows unbounded preceding) as used from x), z as (select *, used <= 5000 as fits from y)
select r.place, r.source as path, r.low, r.high, max(line) filter (fits)::int as read_to, coalesce(sum(cost) filter (fits), 0)::bigint as n_tokens, min(line) filter (not fits)::int as continue_at from r left join z using (place) group by 1, 2, 3, 4"""
)
def read_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for the lines of every twentieth span in order, up to 5000 tokens, and where to continue."""
    r = _ranges(spark, sf_dir)
    w = Window.orderBy("source", "low", "high")  # one request's ranges
    r = r.select(F.lit(0).alias("request_id"), F.row_number().over(w).alias("place"), F.col("source").alias("path"), "low", "high")
    x = select.read_ranges(chunk.lines(files(spark, sf_dir)), r, 5000).drop("request_id")
    return x.withColumns({"read_to": F.col("read_to").cast("int"), "continue_at": F.col("continue_at").cast("int")})


@query(
    f"""with {_SCOPED.replace('text from raw', 'text from raw')}, c as (select distinct query_id, source, tok_start as "start", tok_end as "end", token_count::bigint as n_tokens from candidates where tok_start is not null and tok_end is not null),
k as (select *, row_number() over (partition by query_id order by n_tokens desc, source, "start", "end") as n from c), s as (select * from k where n <= 3),
d as (select c.query_id, count(*) as n_dropped from (select distinct query_id, source, "start", "end" from c) c where not exists (select 1 from s where s.query_id = c.query_id and s.source = c.source and s."start" <= c."start" and c."end" <= s."end") group by 1),
g as (select query_id, count(*) as n_kept, sum(n_tokens)::bigint as kept_tokens, list_sort(list(source || '#tokens=' || "start" || ':' || "end")) as kept from s group by 1)
select query_id, n_kept, kept_tokens, kept, coalesce(n_dropped, 0) as n_dropped, sha256(query_id || chr(10) || array_to_string(kept, chr(10))) as receipt_id from g left join d using (query_id)"""
)
def selection_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of a selection that keeps each question's three largest candidates."""
    c = table(spark, sf_dir, "candidates").filter("tok_start is not null and tok_end is not null")
    c = c.select("query_id", "source", F.col("tok_start").alias("start"), F.col("tok_end").alias("end"), F.col("token_count").cast("bigint").alias("n_tokens")).distinct()
    w = Window.partitionBy("query_id").orderBy(F.col("n_tokens").desc(), "source", "start", "end")
    kept = c.withColumn("n", F.row_number().over(w)).filter("n <= 3").drop("n")
    return select.receipts(c, kept)


@query(
    """select cand_id, query_id, coalesce(metadata.provenance, source || ':' || case when metadata.line_start = metadata.line_end then metadata.line_start::varchar else metadata.line_start || '-' || metadata.line_end end) as provenance,
source || '#tokens=' || tok_start || ':' || tok_end as span_id, token_count, selection_reasons, rank_score, text from candidates"""
)
def response_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.response(table(spark, sf_dir, "candidates"))


@query(
    """with c as (select distinct query_id, source, tok_start, tok_end from candidates where tok_start is not null), t as (select * from c where tok_start = 0)
select query_id, source, tok_start as "start", tok_end as "end" from c where not exists (select 1 from t where t.query_id = c.query_id and t.source = c.source and c.tok_start < t.tok_end and t.tok_start < c.tok_end)"""
)
def outside_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that overlap no candidate at the head of its file."""
    c = table(spark, sf_dir, "candidates").filter("tok_start is not null").select("query_id", "source", F.col("tok_start").alias("start"), F.col("tok_end").alias("end")).distinct()
    return select.without(c, c.filter("start = 0"))


@query(
    """with r as (select distinct query_id as request_id, source as path, metadata.line_start as low, metadata.line_end as high, cand_id as place from candidates where metadata.line_start is not null and metadata.line_end >= metadata.line_start),
s as (select *, case when low <= max(high) over (partition by request_id, path order by low, high rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as n from r),
i as (select *, sum(n) over (partition by request_id, path order by low, high rows unbounded preceding) as k from s), m as (select request_id, path, min(low) as low, max(high) as high from i group by request_id, path, k),
f as (select request_id, path, min(place) as first from r group by 1, 2)
select request_id, row_number() over (partition by request_id order by first, path, low)::int as place, path, low, high from m join f using (request_id, path)"""
)
def resolve_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges that a question's candidates name, as one request each: files in the order asked for, touching ranges united."""
    c = table(spark, sf_dir, "candidates").filter("metadata.line_start is not null and metadata.line_end >= metadata.line_start")
    r = c.select(F.col("query_id").alias("request_id"), F.col("cand_id").alias("place"), F.col("source").alias("path"), F.col("metadata.line_start").alias("low"), F.col("metadata.line_end").alias("high"))
    return select.resolve(r, r.select("request_id", "path").limit(0), 10_000)


@query()
def symbol_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map of the definitions of each question's repository within 200 tokens. Tested by brute force."""
    d = definitions(spark, sf_dir).withColumn("scope", F.split_part("source", F.lit("/"), F.lit(1)))
    return select.symbol_map(d, table(spark, sf_dir, "queries").select("query_id", "query_text", F.col("repo").alias("scope")), 200)


# --- search --------------------------------------------------------------------------------------------------------------------------------------------


@query(
    f"""with q as (select query_id, regexp_full_match(trim(query_text), '[A-Za-z0-9_./\\\\:-]+') as literal, query_text from queries where trim(query_text) <> ''),
t as (select query_id, literal, case when literal then list_distinct(regexp_extract_all({_cf('query_text')}, '[a-z0-9]+')) else {_kw('query_text')} end as k from q),
qt as (select query_id, literal, len(k) as n, unnest(k) as term from t),
w as (select distinct relative_path as path, unnest(regexp_extract_all({_cf('relative_path')}, '[a-z0-9]+')) as term from files),
x as (select query_id, path, count(*) / n as match_score from w join qt using (term) where literal or not list_contains({_STOP}, term) group by query_id, path, n),
r as (select *, row_number() over (partition by query_id order by match_score desc, path)::int as rank from x) select query_id, path, round(match_score, 6) as match_score, rank from r where rank <= 30"""
)
def find_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").select(F.col("relative_path").alias("path"))
    return search.find_files(f, table(spark, sf_dir, "queries")).select("query_id", "path", F.round("match_score", 6).alias("match_score"), "rank")


@query(f"with {_LINES} select source, line::int as line, text from lines_ where text like '%ledger%' and regexp_matches(text, '\\bledger\\b')")
def usages_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.usages(chunk.lines(files(spark, sf_dir)), "ledger").select("source", "line", "text")


_OWNER = """pts as (select distinct source, metadata.line_start as line from candidates where metadata.line_start is not null),
defs as (select sym_name as name, kind, source, line_start, line_end, symbol_id from symbols where kind <> 'import'),
j as (select p.source, p.line, d.kind, d.name, d.line_start, d.line_end, row_number() over (partition by p.source, p.line order by d.line_start desc, d.symbol_id) as k
from pts p left join defs d on d.source = p.source and p.line between d.line_start and d.line_end)"""


@query(f"with {_OWNER} select source, line, kind, name, line_start from j where k = 1")
def innermost_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "candidates").select("source", F.col("metadata.line_start").alias("line")).filter("line is not null").distinct()
    o = search.owners(p, definitions(spark, sf_dir), ["source", "line"])
    return o.select("source", "line", "owner.kind", "owner.name", "owner.line_start")


@query(
    f"""with {_OWNER}, n as (select source, max(line_end) as n_lines from raw_spans group by 1),
fs as (select source, line_start as ls, line_end as le from symbols where kind in ('function', 'method')),
a as (select p.source, p.line, n_lines, ls, le, row_number() over (partition by p.source, p.line order by le - ls nulls last, ls, le) as k
from pts p join n using (source) left join fs on fs.source = p.source and p.line between ls and le)
select source, line, case when le - ls < 40 then ls else greatest(line - 8, 1) end as read_from, case when le - ls < 40 then le else least(line + 8, n_lines) end as read_to from a where k = 1"""
)
def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "candidates").select("source", F.col("metadata.line_start").alias("line")).filter("line is not null").distinct()
    n = table(spark, sf_dir, "raw_spans").groupBy("source").agg(F.max("line_end").alias("n_lines"))
    return search.read_lines(p.join(n, "source"), definitions(spark, sf_dir).filter("kind in ('function', 'method')"))


_EV = f"""{_FILES}, et as (select query_id, len(k) as n_terms, unnest(k) as term from (select query_id, list_filter({_kw('query_text')}, lambda t: not list_contains({_PROSE}, t)) as k from queries)),
fl as (select source, {_cf('text')} as t, greatest(len(case when l[-1] = '' then l[:-2] else l end), 1) as n_lines from (select source, text, string_split(text, chr(10)) as l from files_)),
pr as (select source, n_lines, term from fl, (select distinct term from et) where contains(t, term)), tot as (select count(*) as n from files_), df as (select term, count(*) as df from pr group by 1),
idf as (select term, case when df <= greatest(1, floor(n * 0.2)) then ln(1 + (n - df + 0.5) / (df + 0.5)) else 0 end as idf from df, tot),
fs as (select query_id, source, n_lines, sum(idf) as rarity, count(*) as m, max(n_terms) as n_terms from pr join idf using (term) join et using (term) group by 1, 2, 3),
sc as (select query_id, source, (case when regexp_matches(lower(source), '(^|/)(test_data|testdata|fixtures|fixture|__snapshots__|snapshots)/') then 0.35 when regexp_matches(lower(source), '(\\.md|\\.rst|\\.txt|\\.adoc)$') then 0.7 else 1.0 end)
  * (rarity + m / (n_terms + 1)) / (0.5 + 0.5 * n_lines / avg(n_lines) over (partition by query_id)) as score from fs)"""


@query(f"with {_EV}, r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, source)::int as rank from sc) select query_id, source, rank, round(score, 6) as score from r where rank <= 20")
def evidence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = search.evidence_files(files(spark, sf_dir), table(spark, sf_dir, "queries"), 20)
    return x.select("query_id", "source", "rank", F.round("score", 6).alias("score"))


_W = "regexp_extract_all(text, '[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*')"
_WP = f"flatten(list_transform({_W}, lambda w: string_split(w, '_')))"


@query(
    f"""with {_LINES}, {_EV.replace(_FILES + ', ', '', 1)},
lw as (select source, line, text, unnest(list_distinct(list_concat(list_transform({_W}, lambda w: lower(w)), list_concat(list_transform({_WP}, lambda w: lower(w)), {_ident(_WP)})))) as term from lines_),
w as (select query_id, source, line, any_value(text) as text, sum(idf) as worth from lw join pr using (source, term) join idf using (term) join et using (term) group by 1, 2, 3),
b as (select *, row_number() over (partition by query_id, source order by round(worth, 9) desc, line) as k from w),
r as (select query_id, source, line, text, row_number() over (partition by query_id order by round(score, 9) desc, source, line)::int as rank from b join sc using (query_id, source) where k <= 2)
select query_id, rank, source, line::int as line, substr(trim(text), 1, 160) as text from r where rank <= 30"""
)
def evidence_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return search.evidence_hits(f, chunk.lines(f), table(spark, sf_dir, "queries"))


@query()
def evidence_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by rarity of terms, their first 250 moved by sub-word similarity and by who refers to whom among them. Tested against brute force."""
    f, q = files(spark, sf_dir), table(spark, sf_dir, "queries")
    x = search.rerank(f, definitions(spark, sf_dir), q, search.evidence_files(f, q, search.RERANK))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "source")
    return x.withColumn("rank", F.row_number().over(w)).filter("rank <= 20").select("query_id", "source", "rank", F.round("score", 6).alias("score"))


@query()
def find_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best lines of the re-ranked files, two a file."""
    f = files(spark, sf_dir)
    return search.evidence_hits(f, chunk.lines(f), table(spark, sf_dir, "queries"), definitions(spark, sf_dir))


@query(
    f"""with q0 as (select query_id, {_kw('query_text')} as k, list_distinct(regexp_extract_all(query_text, '[A-Za-z0-9_]+')) as words, regexp_full_match(trim(query_text), '[A-Za-z0-9_]+') as single, query_text from queries where query_text is not null),
q as (select query_id, words, case when single then [{_cf('trim(query_text)')}] else k end as names, list_filter({_ident('list_concat(k, words)')}, lambda t: not list_contains({_STOP}, t)) as parts from q0),
s as (select sym_name as name, kind, source, line_start, line_end, {_cf('sym_name')} as folded, {_ident('[sym_name]')} as own from symbols where kind <> 'import' and sym_name <> '' and sym_name <> '<anonymous>'),
x as (select *, list_contains(names, folded) as exact, case when len(parts) > 0 then len(list_intersect(parts, own)) / len(parts) else 0 end as overlap from q, s),
y as (select *, exact::int::double * 2 + (exact and list_contains(words, name))::int::double + (case when lower(kind) in ('impl', 'module', 'mod') then 0.0 else 0.5 end)::double + overlap as score,
  len(names) = 1 and bool_or(exact) over (partition by query_id) as decisive from x where exact or overlap > 0),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, source, line_start, line_end, name)::int as rank from y where not decisive or exact)
select query_id, rank, name, kind, source, line_start, line_end, round(score, 6) as score from r where rank <= 30"""
)
def find_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_symbols(definitions(spark, sf_dir), table(spark, sf_dir, "queries")).withColumn("score", F.round("score", 6))


@query()
def parsed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.parse_symbols(files(spark, sf_dir)).select("source", "ordinal", "name", "kind", "line_start", "line_end", "is_import")


@query(
    f"""with q as (select query_id, {_kw('query_text')} as qt, regexp_extract_all(query_text, '[A-Za-z0-9_]+') as qw from queries where len({_kw('query_text')}) > 0),
s as (select symbol_id, sym_name as name, kind, {_ident("list_filter(list_concat(coalesce(defines, []), coalesce(refs, [])), lambda x: x is not null)")} as st, {_kw("coalesce(text, '')")} as lt from symbols where char_end > char_start),
x as (select query_id, symbol_id, name, len(list_intersect(qt, st)) / len(qt) + len(list_intersect(qt, lt)) / len(qt) as score, (kind <> 'import' and list_contains(qw, name) and not list_contains({_STOP}, {_cf('name')}))::int::double as symbol_name_match
from q, s where len(list_intersect(qt, st)) > 0 or len(list_intersect(qt, lt)) > 0),
r as (select *, row_number() over (partition by query_id order by symbol_name_match desc, round(score, 9) desc, symbol_id)::int as rank from x)
select query_id, rank, symbol_id, name, round(score, 6) as score, symbol_name_match from r where rank <= 20"""
)
def symbol_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "symbols").withColumnsRenamed({"sym_name": "name", "char_start": "start", "char_end": "end"})
    return symbols.top_candidates(s, table(spark, sf_dir, "queries"), 20).withColumn("score", F.round("score", 6))


# --- graph ---------------------------------------------------------------------------------------------------------------------------------------------

_EDGES = f"""{_FILES}, nm as (select distinct source as src, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}')) as name from files_),
dd as (select distinct sym_name as name, source as dst from symbols where kind <> 'import' and sym_name <> '' and sym_name <> '<anonymous>'),
ed as (select distinct src, dst from nm join dd using (name) where src <> dst and dst in (select source from files_))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return graph.reference_edges(f, definitions(spark, sf_dir)).join(f.select(F.col("source").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


@query(f"with {_EDGES} select src, dst from ed")
def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


def _rank_sql(steps: int = 12) -> str:
    step = """, r{j} as (select a.node, 0.15 * a.start + coalesce(m.gain, 0) + 0.85 * i.idle / a.n as rank from nodes a left join (
  select dst, sum(0.85 * rank / outs) as gain from ed join r{i} on r{i}.node = ed.src join nodes using (node) group by 1) m on m.dst = a.node, (select coalesce(sum(rank), 0) as idle from r{i} join nodes using (node) where outs is null) i)"""
    head = f"""with {_EDGES}, cnt as (select count(distinct source) as n from files_),
nodes as materialized (select node, 1.0::double / n as start, n, outs from (select distinct source as node from files_) left join (select src as node, count(*) as outs from ed group by 1) using (node), cnt),
r0 as (select node, start as rank from nodes)"""
    return head + "".join(step.format(i=i, j=i + 1) for i in range(steps)) + f" select node, round(rank, 9) as rank from r{steps}"


@query(_rank_sql().replace("ed as (", "ed as materialized ("))
def reference_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = files(spark, sf_dir).groupBy(F.col("source").alias("node")).agg(F.lit(1.0).alias("score"))
    return graph.pagerank(seed, edges(spark, sf_dir)).select("node", F.round("rank", 9).alias("rank"))


def _reach(callers: bool) -> str:
    a, b = ("dst", "src") if callers else ("src", "dst")
    return f"""with recursive {_EDGES}, roots as (select distinct source as node from files_ where source in (select source from (select source, row_number() over (partition by query_id order by rank_score desc, cand_id) as k from candidates where rank_score is not null and not isnan(rank_score)) where k = 1)),
w as (select node, 0 as depth from roots union select e.{b}, w.depth + 1 from w join ed e on e.{a} = w.node where w.depth < 4) select node, min(depth)::int as depth from w group by 1"""


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").filter("rank_score is not null and not isnan(rank_score)")
    best = c.groupBy("query_id").agg(F.max_by("source", F.struct("rank_score", -F.col("cand_id"))).alias("node"))
    stated = best.select("node").distinct()
    return files(spark, sf_dir).select(F.col("source").alias("node")).distinct().join(stated, "node", "left_semi")


@query(_reach(False))
def closure_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_roots(spark, sf_dir), edges(spark, sf_dir), 4)


@query(_reach(True))
def closure_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_roots(spark, sf_dir), graph.callers(edges(spark, sf_dir)), 4)


def _traceable(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "symbols").filter("sym_name is not null and line_start is not null and source is not null")
    return s.select(F.col("sym_name").alias("name"), "kind", "source", "line_start", "line_end", "defines", "refs", F.col("symbol_id").alias("ordinal"), T.token_count(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_tokens"))


def _asked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that the questions hold as words."""
    return table(spark, sf_dir, "queries").select(F.explode(F.regexp_extract_all("query_text", F.lit("([A-Za-z0-9_]+)"), 1)).alias("name")).distinct()


_TRACE = r"""with recursive s as (select sym_name as name, source, line_start, arg_max({'kind': kind, 'defines': defines, 'refs': refs, 'n': len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda t: t <> ''))}, symbol_id) as x
  from symbols where sym_name is not null and line_start is not null and source is not null group by 1, 2, 3),
d as (select row_number() over (order by source, name, line_start) as id, source, name, line_start, x.n as n, list_distinct(list_filter(coalesce(x.refs, []), lambda r: r is not null and r <> '')) as uses,
  case when x.kind in ('import', 'variable') and len(list_filter(coalesce(x.defines, []), lambda r: r is not null and r <> '')) > 0 then list_distinct(list_filter(x.defines, lambda r: r is not null and r <> '')) else [name] end as known from s),
u as (select id, unnest(uses) as nm from d), k as (select id, unnest(known) as nm from d),
roots as (select distinct unnest(regexp_extract_all(query_text, '[A-Za-z0-9_]+')) as nm from queries),
w as (select distinct id, 0 as depth from k join roots using (nm) union select b.id, w.depth + 1 from w join {lead} a on a.id = w.id join {meet} b on b.nm = a.nm where w.depth < {depth}),
r as (select id, min(depth)::int as depth from w group by 1)"""


def _trace_sql(direction: str, depth: int = 4) -> str:
    lead, meet = ("u", "k") if direction == "dependencies" else ("k", "u")
    return _TRACE.replace("{lead}", lead).replace("{meet}", meet).replace("{depth}", str(depth))


@query(_trace_sql("dependencies") + " select source, name, line_start, depth, n::bigint as n_tokens from r join d using (id)")
def trace_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the definitions that questions name depend on, to a depth of 4."""
    return trace.trace(_traceable(spark, sf_dir), _asked_names(spark, sf_dir))[0].select("source", "name", "line_start", "depth", "n_tokens")


@query(_trace_sql("callers") + " select source, name, line_start, depth, n::bigint as n_tokens from r join d using (id)")
def trace_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.trace(_traceable(spark, sf_dir), _asked_names(spark, sf_dir), direction="callers")[0].select("source", "name", "line_start", "depth", "n_tokens")


@query(
    _trace_sql("dependencies", 2)
    + """, t as (select count(*) as definitions, coalesce(sum(n), 0)::bigint as tokens, coalesce(max(depth), 0) as depth from r join d using (id) where depth <= 1), i as (select count(*) as index_definitions, sum(n)::bigint as index_tokens from d)
select definitions, tokens, depth, index_definitions, index_tokens, round(1 - tokens / index_tokens, 4) as token_reduction, (select count(*) > 0 from r where depth = 2) as truncated_by_depth, tokens > 4000 as over_budget from t, i"""
)
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of one step in figures; what a second step would add makes it truncated."""
    d = _traceable(spark, sf_dir)
    return trace.summary(*trace.trace(d, _asked_names(spark, sf_dir), 1), d)


@query(_trace_sql("dependencies", 1) + ", p as (select source, name, line_start, n, sum(n) over (order by source, line_start, name) as used from r join d using (id)) select source, name, line_start, n::bigint as n_tokens from p where used <= 4000")
def trace_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of one step in the order of source and line, up to the first definition that overflows 4000 tokens."""
    return trace.pack_trace(trace.trace(_traceable(spark, sf_dir), _asked_names(spark, sf_dir), 1)[0], 4000).select("source", "name", "line_start", "n_tokens")


@query(f"with {_LINES}, {_RANGES} select source, line::int as line, case when source not in (select source from rg) or exists (select 1 from rg where rg.source = l.source and line between low and high) then text else '' end as text from lines_ l")
def blanked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all files, those outside requested ranges emptied."""
    return trace.blank_outside(chunk.lines(files(spark, sf_dir)).select("source", "line", "text"), _ranges(spark, sf_dir)).withColumn("line", F.col("line").cast("int"))


@query(
    r"""with d as (select distinct source, sym_name as name, line_start as ls, line_end as le from symbols where kind <> 'import' and sym_name is not null and line_start is not null and line_end is not null),
n as (select full_, list_filter(string_split_regex(full_, '::|->|[./]'), lambda p: p <> '') as want from (select distinct regexp_replace(regexp_extract(source, '[^/]+$'), '\.[^./]+$', '') || '.' || sym_name as full_ from symbols where kind <> 'import' and symbol_id % 20 = 0)),
x as (select full_, want, d.source, d.name, d.ls, list_sort(list(distinct {'s': o.ls, 'e': -o.le, 'n': o.name}) filter (o.name is not null)) as outs from n join d on d.name = want[-1]
  left join d o on o.source = d.source and o.ls <= d.ls and o.le >= d.le and (o.ls <> d.ls or o.le <> d.le) where len(want) > 1 group by 1, 2, 3, 4, 5),
y as (select *, list_concat(string_split(regexp_replace(source, '\.[^./]+$', ''), '/'), list_concat(list_transform(coalesce(outs, []), lambda o: o.n), [name])) as own from x)
select full_ as "full", source, name, ls as line_start from y where len(own) >= len(want) and own[len(own) - len(want) + 1:] = want"""
)
def qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions meant by a module and a name, for every twentieth definition."""
    s = table(spark, sf_dir, "symbols").filter("kind <> 'import' and sym_name is not null")
    base = F.regexp_replace(F.regexp_extract("source", "([^/]+)$", 1), r"\.[^./]+$", "")
    names = s.filter("symbol_id % 20 = 0").select(F.concat(base, F.lit("."), "sym_name").alias("full")).distinct()
    d = s.filter("line_start is not null and line_end is not null").select("source", F.col("sym_name").alias("name"), "line_start", "line_end")
    return trace.qualified(d, names)


@query(
    r"""with f as (select distinct relative_path as path, string_split(relative_path, '/') as p from files), e as (select path, array_to_string(p[i:], '/') as token from (select path, p, unnest(range(1, len(p) + 1)) as i from f)),
o as (select token, min(path) as path from e group by 1 having count(*) = 1), q as (select query_id, unnest(list_transform(regexp_extract_all(query_text, '[A-Za-z0-9_./-]+'), lambda t: trim(t, './'))) as token from named)
select distinct query_id, path from q join o using (token) where contains(token, '.')""".replace("from named", "from (select item_id as query_id, query_text || ' see ' || critical_source || ', ' || regexp_extract(critical_source, '[^/]+$') as query_text from tasks)")
)
def named_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that texts name: the evaluation questions with their critical source and its base name."""
    t = table(spark, sf_dir, "tasks")
    text = F.concat("query_text", F.lit(" see "), "critical_source", F.lit(", "), F.regexp_extract("critical_source", "([^/]+)$", 1))
    return trace.named_paths(t.select(F.col("item_id").alias("query_id"), text.alias("query_text")), table(spark, sf_dir, "files").select(F.col("relative_path").alias("path")))


# --- review --------------------------------------------------------------------------------------------------------------------------------------------

_DEF = "d as (select distinct sym_name as name, kind, source, line_start, line_end from symbols where kind <> 'import')"


def _defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definitions(spark, sf_dir).select("name", "kind", "source", "line_start", "line_end").distinct()


def _hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_spans").select(F.col("source").alias("path"), F.col("line_start").alias("start"), F.lit(1).alias("len"))


_TOUCHED = f"with {_DEF}, t as (select * from d where exists (select 1 from raw_spans h where h.source = d.source and d.line_start <= h.line_start and d.line_end >= h.line_start))"


@query(_TOUCHED + " select * from t")
def hunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.touched(_defs(spark, sf_dir), _hunks(spark, sf_dir))


@query(_TOUCHED + " select * from t where not exists (select 1 from t i where i.source = t.source and t.line_start <= i.line_start and t.line_end >= i.line_end and (t.line_start <> i.line_start or t.line_end <> i.line_end))")
def innermost_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.innermost(review.touched(_defs(spark, sf_dir), _hunks(spark, sf_dir)))


# --- accounting ----------------------------------------------------------------------------------------------------------------------------------------


def _any(signals: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(q, '{s}')" for s in signals) + ")"


@query(
    f"""select query_id, case when coalesce(n, 0) < 2 then 'unknown' when {_any(accounting.TRACE_SIGNALS)} then 'trace' when {_any(accounting.AGGREGATION_SIGNALS)} then 'aggregation' else 'localized' end as predicted, query_class
from (select query_id, query_class, {_cf('query_text')} as q, len({_kw('query_text')}) as n from queries)"""
)
def classify_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "queries")
    return q.select("query_id", accounting.query_class(F.col("query_text")).alias("predicted"), "query_class")


@query(
    f"""with c0 as (select query_id, query_text, list_filter(list_transform(string_split_regex(query_text, '[.!?;\\n]+'), lambda x: trim(x)), lambda x: x <> '') as l from queries where query_text is not null),
c1 as (select query_id, case when len(l) > 0 then l else [trim(query_text)] end as l from c0), c2 as (select query_id, unnest(range(1, len(l) + 1))::int as claim_no, unnest(l) as claim from c1),
c as (select *, {_plain('claim')} as k from c2), have as (select distinct query_id, unnest(list_concat({_plain("coalesce(text, '')")}, {_pk("coalesce(source, '')")})) as term from candidates),
a as (select query_id, claim_no, count(h.term) as m from (select query_id, claim_no, unnest(k) as term from c) x left join have h using (query_id, term) group by 1, 2)
select query_id, claim_no, claim, len(k)::int as n_keywords, coalesce(m, 0)::bigint as n_matched, round(case when len(k) > 0 then coalesce(m, 0) / len(k) end, 6) as coverage,
case when len(k) = 0 then 'not_evaluable' when m = len(k) then 'supported' when m > 0 then 'partial' else 'unsupported' end as status from c left join a using (query_id, claim_no)"""
)
def claim_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "queries").filter("query_text is not null")
    return accounting.claims(q, table(spark, sf_dir, "candidates")).withColumn("coverage", F.round("coverage", 6))


_CLAIMED = f"""c0 as (select query_id, query_text, list_filter(list_transform(string_split_regex(query_text, '[.!?;\\n]+'), lambda x: trim(x)), lambda x: x <> '') as l from queries where query_text is not null),
c1 as (select query_id, case when len(l) > 0 then l else [trim(query_text)] end as l from c0), c2 as (select query_id, unnest(range(1, len(l) + 1))::int as claim_no, unnest(l) as claim from c1),
c as (select *, {_plain('claim')} as k from c2), have as (select distinct query_id, unnest(list_concat({_plain("coalesce(text, '')")}, {_pk("coalesce(source, '')")})) as term from candidates),
a as (select query_id, claim_no, count(h.term) as m from (select query_id, claim_no, unnest(k) as term from c) x left join have h using (query_id, term) group by 1, 2),
e as (select query_id, count(*) as claims, count(*) filter (len(k) > 0 and m = len(k)) as supported, count(*) filter (len(k) > 0 and m > 0 and m < len(k)) as partial, count(*) filter (len(k) > 0 and coalesce(m, 0) = 0) as unsupported,
count(*) filter (len(k) = 0) as not_evaluable, case when sum(len(k)) > 0 then sum(coalesce(m, 0)) / sum(len(k)) else 1.0 end as coverage from c left join a using (query_id, claim_no) group by 1)"""


@query(f"with {_CLAIMED} select query_id, claims, supported, partial, unsupported, not_evaluable, round(coverage, 6) as coverage from e")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the claims of each question are supported by its candidates."""
    q = table(spark, sf_dir, "queries").filter("query_text is not null")
    return accounting.evidence_summary(accounting.claims(q, table(spark, sf_dir, "candidates"))).withColumn("coverage", F.round("coverage", 6))


@query(
    f"""with {_CLAIMED}, s as (select query_id, avg((len(selection_reasons) >= 2)::int) as multi_signal, count(*) as n_scored, count(*) filter (rank_score is null or isnan(rank_score)) as n_skipped, sum(token_count) <= 3000 as lossless from candidates group by 1)
select query_id, lossless, round(coverage, 6) as coverage, round(case when lossless then 0.95 else least(greatest((0.5 * coverage + 0.3 * multi_signal + 0.2 * (1 - n_skipped / (n_scored + n_skipped))) * case when query_id % 7 = 0 then 0.8 else 1 end
* case when query_class = 'aggregation' then 0.6 when query_class = 'trace' then 0.85 when query_class = 'unknown' then 0.7 else 1 end, 0), 1) end, 6) as confidence from s join queries using (query_id) join e using (query_id)"""
)
def selection_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence in a selection that keeps all of a question's candidates; for every seventh question as if its window had been dropped."""
    c, q = table(spark, sf_dir, "candidates"), table(spark, sf_dir, "queries")
    bad = F.col("rank_score").isNull() | F.isnan("rank_score")
    s = c.groupBy("query_id").agg(F.avg((F.size("selection_reasons") >= 2).cast("int")).alias("multi_signal"), F.count("*").alias("n_scored"), F.sum(bad.cast("bigint")).alias("n_skipped"), (F.sum("token_count") <= 3000).alias("lossless"))
    e = accounting.evidence_summary(accounting.claims(q.filter("query_text is not null"), c)).select("query_id", "coverage")
    s = s.join(q.select("query_id", "query_class"), "query_id").join(e, "query_id").withColumn("window_dropped", F.col("query_id") % 7 == 0)
    return s.select("query_id", "lossless", F.round("coverage", 6).alias("coverage"), F.round(accounting.confidence(s), 6).alias("confidence"))


@query(
    f"""with h as (select query_id, list_distinct(flatten(list({_kw("coalesce(text, '')")}))) as held from candidates group by 1), q as (select query_id, {_kw('query_text')} as k from queries where query_text is not null)
select query_id, list_sort(list_filter(k, lambda x: list_contains(held, x))) as covered, list_sort(list_filter(k, lambda x: not list_contains(held, x))) as uncovered from q join h using (query_id)"""
)
def keyword_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keywords of each question that its candidates hold, and those that none does."""
    words = table(spark, sf_dir, "candidates").select("query_id", F.explode(T.keywords(F.coalesce("text", F.lit("")))).alias("w")).distinct().groupBy("query_id").agg(F.collect_list("w").alias("held"))
    every = table(spark, sf_dir, "candidates", "query_id").distinct().join(words, "query_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    q = table(spark, sf_dir, "queries").filter("query_text is not null").select("query_id", T.keywords(F.col("query_text")).alias("k")).join(every, "query_id")
    return q.withColumn("x", accounting.keyword_cover(F.col("k"), F.col("held"))).select("query_id", "x.covered", "x.uncovered")


_LEDGER = "l as (select strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as ts, case when value >= 5 then floor(value * 10)::bigint end as tokens_in, floor(value)::bigint as tokens_out, (json_extract(props, '$.k'))::int as round_trips_saved from events)"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ledger rows; small values are unmeasured."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.when(F.col("value") >= 5, F.floor(F.col("value") * 10)).alias("tokens_in"), F.floor("value").alias("tokens_out"), F.get_json_object("props", "$.k").cast("int").alias("round_trips_saved")
    )


@query(
    f"""with {_LEDGER}, x as (select *, case when tokens_in is not null and tokens_out is not null then tokens_in - tokens_out end as saved, coalesce(nullif(substr(ts, 1, 10), ''), 'unknown') as day from l)
select day, count(*) as calls, count(*) filter (saved is null) as unmeasured, case when count(tokens_in) = count(*) then sum(tokens_in)::bigint end as tokens_in, case when count(tokens_out) = count(*) then sum(tokens_out)::bigint end as tokens_out,
case when count(saved) = count(*) then sum(saved)::bigint end as tokens_saved, sum(coalesce(round_trips_saved, 0))::bigint as round_trips_saved,
round(case when count(saved) = count(*) and sum(tokens_in) > 0 then sum(saved) / sum(tokens_in) end, 6) as reduction, round(case when count(saved) = count(*) then sum(saved) * 3.0 / 1e6 end, 6) as usd from x group by grouping sets ((), (day))"""
)
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = accounting.ledger_summary(ledger(spark, sf_dir), price_per_million=3.0)
    return x.withColumns({"reduction": F.round("reduction", 6), "usd": F.round("usd", 6)})


_STATES = """a as (select relative_path as source, arg_min(fingerprint, file_id) as old from files where file_id % 10 <> 3 group by 1),
b as (select relative_path as source, arg_min(sha256(case when file_id % 10 = 1 then text || 'x' else text end), file_id) as new from files where text is not null and file_id % 10 <> 2 group by 1)"""


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the files: between them a tenth was changed, a tenth removed and a tenth added."""
    f = table(spark, sf_dir, "files", "file_id", "relative_path", "fingerprint", "text").withColumnRenamed("relative_path", "source")
    a = f.filter("file_id % 10 <> 3").groupBy("source").agg(F.min_by("fingerprint", "file_id").alias("fingerprint"))
    now = F.sha2(F.when(F.col("file_id") % 10 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256)
    b = f.filter("text is not null and file_id % 10 <> 2").groupBy("source").agg(F.min_by(now, "file_id").alias("fingerprint"))
    return a, b


@query(f"with {_STATES} select source, case when old is null then 'added' when new is null then 'removed' else 'changed' end as change from a full join b using (source) where old is distinct from new")
def source_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.drift(*_states(spark, sf_dir))


@query(f"with {_STATES} select source from a left join b using (source) where new is null or new <> old")
def pack_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved sources whose file has changed, is gone or can't be read."""
    return accounting.stale(*_states(spark, sf_dir))


# --- evaluation ----------------------------------------------------------------------------------------------------------------------------------------


@query("select l_returnflag, l_linestatus, count(*) as n, round(avg(l_quantity), 6) as l_quantity, round(avg(l_discount), 6) as l_discount from lineitem group by grouping sets ((l_returnflag), (l_returnflag, l_linestatus))")
def arm_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = evalkit.arm_rollup(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["l_quantity", "l_discount"])
    return x.select("l_returnflag", "l_linestatus", "n", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_discount", 6).alias("l_discount"))


@query(
    """with r as (select l_returnflag as arm, l_orderkey as task_id, avg(l_quantity) as v from lineitem group by 1, 2)
select a.task_id, round(a.v - b.v, 6) as delta from r a join r b using (task_id) where a.arm = 'A' and b.arm = 'N'"""
)
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_orderkey").alias("task_id")).agg(F.avg("l_quantity").alias("v"))
    return evalkit.paired(r, "arm", "A", "N", "task_id", "v").select("task_id", F.round("delta", 6).alias("delta"))


@query()
def non_inferiority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap intervals of the mean paired difference in candidate score, per query class."""
    c = table(spark, sf_dir, "candidates").filter("rank_score is not null and not isnan(rank_score)")
    c = c.groupBy("query_id", F.array_contains("selection_reasons", "symbol").alias("arm")).agg(F.max("rank_score").alias("v"))
    d = evalkit.paired(c, "arm", True, False, "query_id", "v").join(table(spark, sf_dir, "queries", "query_id", "query_class"), "query_id")
    return evalkit.intervals(d.select("query_class", "query_id", F.round("delta", 9).alias("delta")), ["query_class"], "query_id")


@query("select o_orderpriority, count(o_totalprice) as n, round(avg(o_totalprice), 4) as mean, round(quantile_cont(o_totalprice, 0.5), 4) as median, round(quantile_cont(o_totalprice, 0.95), 4) as p95 from orders group by 1")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = evalkit.distribution(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return x.select("o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "p95")])


@query(
    """with want as (select c_custkey as task_id, unnest(['F', 'O', 'P']) as arm from customer), have as (select o_custkey as task_id, o_orderstatus as arm, count(*) as n from orders group by 1, 2)
select task_id, arm, coalesce(n, 0) as n from want left join have using (task_id, arm) where coalesce(n, 0) <> 1"""
)
def matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderstatus").alias("arm"))
    return evalkit.missing_cells(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id")), ["F", "O", "P"], rows)


@query(
    """with t as (select user_id as run, event_id as turn, floor(value)::bigint as p from events)
select run, turn, greatest(p - coalesce(lag(p) over (partition by run order by turn), 0), 0) as growth, (sum(p) over (partition by run order by turn))::bigint as total from t"""
)
def transcript_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("turn"), F.floor("value").alias("prompt_tokens"))
    return evalkit.transcript_cost(t)


@query("select item_id, list_bool_and(list_transform(answer_keywords, lambda k: contains(lower(answer), lower(k)))) and critical_source is not null as success from tasks")
def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tasks").select("item_id", evalkit.grounded(F.col("answer"), F.col("answer_keywords"), F.col("critical_source").isNotNull()).alias("success"))


@query(
    """with c as (select distinct query_id, source, tok_start, tok_end, token_count from candidates where tok_start is not null and token_count is not null), x as (select *, (sum(token_count) over (partition by query_id order by source, tok_start, tok_end rows unbounded preceding)) as used from c)
select query_id, source, tok_start, tok_end, token_count::bigint as n_tokens from x where used <= 1000"""
)
def pack_until_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's candidates in the order of their places up to the first that overflows."""
    c = table(spark, sf_dir, "candidates", "query_id", "source", "tok_start", "tok_end", "token_count").filter("tok_start is not null and token_count is not null").distinct()
    return trials.pack_until(c, ["query_id"], [F.col(x) for x in ("source", "tok_start", "tok_end")], F.col("token_count"), 1000).drop("token_count")


_DOCS = r"""d as (select source, doc_id, (len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda t: t <> '')))::bigint as n from documents where text is not null)"""


@query(f"with {_DOCS}, x as (select *, (sum(n) over (partition by source order by doc_id rows unbounded preceding)) - n as before from d) select source, doc_id, least(n, 2000 - before)::bigint as n_tokens from x where before < 2000")
def pack_and_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each source in order within 2000 tokens, the last one cut."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("source", "doc_id", T.token_count(F.col("text")).alias("n"))
    return trials.pack_until(d, ["source"], [F.col("doc_id")], F.col("n"), 2000, clip=True).select("source", "doc_id", "n_tokens")


@query(
    f"""with {_FILES}, p as (select source, (len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda t: t <> '')))::bigint as n, (contains({_cf('source')}, '/test') or contains({_cf('source')}, 'test_') or contains({_cf('source')}, '_test.') or contains({_cf('source')}, '/tests/') or contains({_cf('source')}, 'conftest'))::int * 2
+ (suffix({_cf('source')}, '.md') or suffix({_cf('source')}, '.rst') or suffix({_cf('source')}, '.txt'))::int as priority from files_), x as (select *, (sum(n) over (order by priority, source, n rows unbounded preceding)) - n as before from p)
select source, priority, least(n, 60000 - before)::bigint as n_tokens from x where before < 60000"""
)
def broad_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files, code first, within 60000 tokens."""
    f = files(spark, sf_dir).select("source", trials.source_priority(F.col("source")).alias("priority"), T.token_count(F.col("text")).alias("n"))
    return trials.pack_until(f, [], [F.col("priority"), F.col("source"), F.col("n")], F.col("n"), 60_000, clip=True).select("source", "priority", "n_tokens")


@query(
    f"""with {_FILES}, f as (select split_part(source, '/', 1) as scope, source, {_cf('text')} as t, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda t: t <> '')) as n from files_),
q as (select query_id, repo as scope, unnest({_kw('query_text')}) as term from queries where repo is not null),
x as (select query_id, source, sum((length(t) - length(replace(t, term, ''))) // length(term))::bigint as hits, any_value(n) as n from q join f using (scope) group by 1, 2 having hits > 0),
r as (select *, row_number() over (partition by query_id order by hits desc, source)::int as place from x) select query_id, place, source, hits, least(n, 4000)::int as n_tokens from r where place <= 6"""
)
def native_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("scope", F.split_part("source", F.lit("/"), F.lit(1)))
    return trials.native_search(f, table(spark, sf_dir, "queries").select("query_id", "query_text", F.col("repo").alias("scope")))


@query(f"with {_LINES}, m as (select *, row_number() over (partition by source order by line) as n from lines_ where regexp_matches(text, '(?i)ledger|queue')) select source, line::int as line, substr(trim(text), 1, 200) as text from m where n <= 5 order by source, line limit 40")
def grep_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.grep(chunk.lines(files(spark, sf_dir)), "ledger|queue").withColumn("line", F.col("line").cast("int"))


_ATTEMPTS = "a as (select event_type as arm, event_id, value >= 5 as supported, value < 1 as failed, case when event_id % 97 <> 0 or event_type = 'click' then floor(value * 100)::bigint end as tokens, case when event_type <> 'view' or event_id % 53 <> 0 then round(value, 2) end as cost, round(value, 2) + 1 as bound from events)"


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts, some of unknown usage or cost."""
    known = (F.col("event_id") % 97 != 0) | (F.col("event_type") == "click")
    priced = (F.col("event_type") != "view") | (F.col("event_id") % 53 != 0)
    cost = F.round("value", 2)
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("arm"), "event_id", (F.col("value") >= 5).alias("supported"), (F.col("value") < 1).alias("failed"), F.when(known, F.floor(F.col("value") * 100)).alias("tokens"), F.when(priced, cost).alias("cost"), (cost + 1).alias("bound")
    )


@query(
    f"""with {_ATTEMPTS}, g as (select arm, count(*) as n, sum(supported::int)::bigint as supported, sum(failed::int)::bigint as failed, count(*) filter (tokens is null) as unknown_usage, count(*) filter (cost is null) as unknown_cost, coalesce(sum(tokens), 0)::bigint as tokens_at_least,
case when count(tokens) = count(*) then sum(tokens)::bigint end as tokens, case when count(cost) = count(*) then sum(cost) end as cost, sum(bound) as cost_at_most from a group by 1)
select arm, n, supported, failed, unknown_usage, unknown_cost, tokens_at_least, tokens, round(cost, 4) as cost, round(cost_at_most, 4) as cost_at_most, round(tokens / nullif(supported, 0), 4) as tokens_per_supported, round(cost / nullif(supported, 0), 4) as cost_per_supported, round(cost / n, 4) as mean_cost from g"""
)
def attempts_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = trials.attempts_summary(_attempts(spark, sf_dir), ["arm"])
    return x.withColumns({c: F.round(c, 4) for c in ("cost", "cost_at_most", "tokens_per_supported", "cost_per_supported", "mean_cost")})


@query()
def paired_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over the questions of each class: candidates found by names against those that were not. Bootstrap draws are tested against the generator."""
    c = table(spark, sf_dir, "candidates").filter("rank_score is not null and not isnan(rank_score)")
    arm = lambda a, flag: c.filter(F.array_contains("selection_reasons", "symbol") == flag).groupBy("query_id").agg(
        (F.max("rank_score") > 0.5).cast("int").alias(f"supported_{a}"), (F.min("rank_score") < 0).cast("int").alias(f"errors_{a}"), F.sum("token_count").cast("double").alias(f"tokens_{a}")
    )
    rows = arm("a", True).join(arm("b", False), "query_id").join(table(spark, sf_dir, "queries", "query_id", "query_class"), "query_id")
    return trials.paired_gate(rows, ["query_class"], "query_id", 2000)


@query(
    """with t as (select user_id as run, event_id as turn, 100 as fixed, floor(value)::bigint as output, case when event_type <> 'view' then floor(value * 3)::bigint end as reply from events),
x as (select *, fixed + coalesce(sum(output + coalesce(reply, 0)) over (partition by run order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as prompt from t)
select run, turn, prompt, (sum(prompt + output) over (partition by run order by turn rows unbounded preceding))::bigint as total from x"""
)
def replay_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.when(F.col("event_type") != "view", F.floor(F.col("value") * 3))
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("turn"), F.lit(100).cast("bigint").alias("fixed"), F.floor("value").alias("output"), reply.alias("reply"))
    return trials.replay(t)


@query(
    """with c as (select cand_id as cite_id, source, metadata.line_start as low, metadata.line_end as high from candidates where metadata.line_start is not null and metadata.line_end >= metadata.line_start),
d as (select distinct source, line_start as low, line_end as high from raw_spans where line_end >= line_start and span_id % 2 = 0), cl as (select distinct source, unnest(range(low, high + 1)) as line from d),
x as (select cite_id, high - low + 1 as n, (select count(*) from cl where cl.source = c.source and line between c.low and c.high) as m from c) select cite_id, case when m = n then 'whole' when m > 0 then 'fragment' else 'never' end as delivery from x"""
)
def cited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the lines that candidates cite lie within every second span, as delivered."""
    c = table(spark, sf_dir, "candidates").filter("metadata.line_start is not null and metadata.line_end >= metadata.line_start")
    d = table(spark, sf_dir, "raw_spans").filter("span_id % 2 = 0").select("source", F.col("line_start").alias("low"), F.col("line_end").alias("high"))
    return trials.citations(c.select(F.col("cand_id").alias("cite_id"), "source", F.col("metadata.line_start").alias("low"), F.col("metadata.line_end").alias("high")), d)


@query("with want as (select distinct c_custkey as task_id, unnest(['F', 'O', 'P']) as arm from customer) select task_id, arm from want anti join (select distinct o_custkey as task_id, o_orderstatus as arm from orders) using (task_id, arm)")
def pending_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderstatus").alias("arm"))
    return trials.pending(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id")), ["F", "O", "P"], done)


@query(
    f"""with p as (select query_class, case when coalesce(n, 0) < 2 then 'unknown' when {_any(accounting.TRACE_SIGNALS)} then 'trace' when {_any(accounting.AGGREGATION_SIGNALS)} then 'aggregation' else 'localized' end as predicted
from (select query_class, {_cf('query_text')} as q, len({_kw('query_text')}) as n from queries) where query_class is not null)
select query_class, count(*) as n, round(avg((predicted = query_class)::int), 6) as accuracy from p group by grouping sets ((), (query_class))"""
)
def router_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "queries").withColumn("predicted", accounting.query_class(F.col("query_text")))
    return trials.router_accuracy(q, "predicted", "query_class").withColumn("accuracy", F.round("accuracy", 6))


@query(
    """with s as (select item_id, list(source) as sources from (select distinct query_id, source from candidates) join (select item_id, row_number() over (order by item_id) as k from tasks) on k % 200 = query_id % 200 group by 1)
select item_id, case when critical_source is not null then len(list_filter(sources, lambda x: contains(x, critical_source))) > 0 end as hit, len(list_filter(answer_keywords, lambda w: contains(w, '_') or regexp_matches(w, '^.+[A-Z]'))) as name_like from tasks join s using (item_id)"""
)
def source_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sources found for a question hold a task's critical source, and how many of its keywords look like names."""
    t = table(spark, sf_dir, "tasks").withColumn("k", F.row_number().over(Window.orderBy("item_id")) % 200)  # 320 tasks
    c = table(spark, sf_dir, "candidates", "query_id", "source").distinct().withColumn("k", F.col("query_id") % 200).groupBy("k").agg(F.collect_set("source").alias("sources"))
    x = t.join(c, "k")
    return x.select("item_id", trials.source_hit(F.col("sources"), F.col("critical_source")).alias("hit"), F.size(F.filter("answer_keywords", trials.name_like)).cast("bigint").alias("name_like"))


def _weighted_sql(steps: int = 12) -> str:
    step = """, r{j} as (select a.node, (0.15 + 0.85 * i.idle) * a.start + coalesce(m.gain, 0) as rank from nodes a left join (
  select dst, sum(0.85 * rank * w / outs) as gain from we join r{i} on r{i}.node = we.src join nodes using (node) group by 1) m on m.dst = a.node, (select coalesce(sum(rank), 0) as idle from r{i} join nodes using (node) where outs is null) i)"""
    head = f"""with {_FILES}, nm as (select source as src, name, sqrt(count(*)) as w from (select source, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}')) as name from files_) group by 1, 2),
dd as (select distinct sym_name as name, source as dst from symbols where kind <> 'import' and sym_name <> '' and sym_name <> '<anonymous>'),
we as materialized (select src, dst, sum(w) as w from nm join dd using (name) where src <> dst and dst in (select source from files_) group by 1, 2), cnt as (select count(distinct source) as n from files_),
nodes as materialized (select node, 1.0::double / n as start, n, outs from (select distinct source as node from files_) left join (select src as node, sum(w) as outs from we group by 1) using (node), cnt), r0 as (select node, start as rank from nodes)"""
    return head + "".join(step.format(i=i, j=i + 1) for i in range(steps)) + f" select node, round(rank, 9) as rank from r{steps}"


@query(_weighted_sql())
def weighted_reference_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by who names their definitions, an edge weighing the square root of the mentions."""
    f = files(spark, sf_dir)
    seed = f.groupBy(F.col("source").alias("node")).agg(F.lit(1.0).alias("score"))
    d = definitions(spark, sf_dir).filter("name <> '' and name <> '<anonymous>'").select("name", F.col("source").alias("dst")).distinct()
    n = f.select(F.col("source").alias("src"), F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z_][A-Za-z0-9_]{2,})"), 1)).alias("name")).groupBy("src", "name").agg(F.sqrt(F.count("*")).alias("weight"))
    e = n.join(d, "name").filter("src <> dst").join(seed.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "weight")
    return graph.weighted_pagerank(seed, e).select("node", F.round("rank", 9).alias("rank"))


# --- usage over time -----------------------------------------------------------------------------------------------------------------------------------


@query("select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as calls, round(sum(value), 4) as value from events group by 1, 2")
def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.daily_usage(table(spark, sf_dir, "events")).withColumns({"value": F.round("value", 4), "day": F.col("day").cast("string")})


@query(
    """with e as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minutes, true)::int as fresh from events),
g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e)
select user_id, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) as n from g group by user_id, k"""
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.sessions(table(spark, sf_dir, "events"))
