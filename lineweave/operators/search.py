"""Searching files, lines and definitions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineweave.functions import text as T
from lineweave.functions.keywords import casefold, physical_lines
from lineweave.functions.subword import SubwordFeatures
from lineweave.operators import score
from lineweave.plans.durable import durable

# Names for one kind of definition.
KIND_ALIASES = {"fn": "function", "func": "function", "method": "function", "def": "function", "class": "struct", "interface": "trait", "var": "variable", "const": "variable", "static": "variable", "mod": "module", "type_alias": "type"}
# Kinds that extend a type rather than declare it; folders of test data; endings of prose.
CONTAINER_KINDS = ("impl", "module", "mod")
FIXTURE_DIRS = ("test_data", "testdata", "fixtures", "fixture", "__snapshots__", "snapshots")
PROSE_SUFFIXES = (".md", ".rst", ".txt", ".adoc")


def kind_of(kind: Column) -> Column:
    k = F.lower(kind)
    table = F.create_map(*[F.lit(x) for kv in KIND_ALIASES.items() for x in kv])
    return F.coalesce(table[k], k)


def path_prior(path: Column) -> Column:
    """1 for code, 0.7 for prose, 0.35 below a folder of test data."""
    low = F.lower(F.translate(path, "\\", "/"))
    fixture = low.rlike("(^|/)(" + "|".join(FIXTURE_DIRS) + ")/")
    prose = low.rlike("(" + "|".join(re.escape(s) for s in PROSE_SUFFIXES) + ")$")
    return F.when(fixture, 0.35).when(prose, 0.7).otherwise(1.0)


def find_files(files: DataFrame, queries: DataFrame, top_k: int = 30) -> DataFrame:
    """Files whose path holds words of the query: ``query_id, path, match_score, rank``, ranked by the share of words, then path. Scored where the paths lie.

    A query that is one path or identifier is taken literally: all its words count, stop words too.
    """
    trimmed = F.trim("query_text")
    literal = trimmed.rlike("^[A-Za-z0-9_./\\\\:-]+$")
    typed = F.array_distinct(F.regexp_extract_all(T.casefold(F.col("query_text")), F.lit("([a-z0-9]+)"), 1))
    terms = F.when(literal, typed).otherwise(T.keywords(F.col("query_text")))
    words = F.array_distinct(F.regexp_extract_all(T.casefold(F.col("path")), F.lit("([a-z0-9]+)"), 1))
    index = score.numbered_spans(files.select("path").filter("path is not null").distinct(), words, key=["path"])
    found = [score.top(index, _Share(q), top_k) for q in score.question_blocks(queries.filter(trimmed != ""), terms)]
    if not found:
        return index.select(F.lit(0).cast("bigint").alias("query_id"), "path", F.lit(0.0).alias("match_score"), F.lit(0).alias("rank")).limit(0)
    x = reduce(DataFrame.unionByName, found).join(index.select("span_no", "path"), "span_no")
    return x.select("query_id", "path", (F.col("points") / score.PLACES).alias("match_score"), "rank")


class _Share:
    """Share of a question's terms that a row holds."""

    columns = ("span_no", "terms")

    def __init__(self, q: score.Questions):
        self.q = q

    def channels(self, b: pa.RecordBatch) -> list[score.Postings]:
        return [score.Postings(*score._postings(b.column("terms"), pa.array(self.q.terms, pa.string())), None, b.num_rows, len(self.q.terms))]

    def scores(self, b: pa.RecordBatch) -> Callable[[int, list[np.ndarray]], np.ndarray]:
        return lambda i, sums: sums[0] / self.q.sizes[i]


def owners(points: DataFrame, definitions: DataFrame, key: list[str], bin_lines: int = 64) -> DataFrame:
    """The innermost definition around each line (``source, line``): greatest first line, then least ordinal; null where there is none.

    An interval join made equal: definitions are put into the bins of 64 lines they touch, lines into theirs.
    """
    d = definitions.select("source", "line_start", "line_end", "name", "kind", "ordinal", F.explode(F.sequence(F.floor(F.col("line_start") / bin_lines), F.floor(F.col("line_end") / bin_lines))).alias("bin"))
    p = points.withColumn("bin", F.floor(F.col("line") / bin_lines))
    inside = (F.col("line") >= F.col("line_start")) & (F.col("line") <= F.col("line_end"))
    d = d.withColumnsRenamed({"source": "d_source", "bin": "d_bin"})
    x = p.join(d, (F.col("source") == F.col("d_source")) & (F.col("bin") == F.col("d_bin")) & inside, "left")
    best = F.max_by(F.struct("kind", "name", "line_start", "line_end"), F.struct("line_start", -F.col("ordinal"))).alias("owner")
    return x.groupBy(*key).agg(best)


def read_lines(points: DataFrame, functions: DataFrame, longest: int = 40, reach: int = 8) -> DataFrame:
    """Lines worth reading around each hit: the shortest function around it if it has at most 40 lines, else 8 lines to either side (``n_lines`` bounds it)."""
    f = functions.select(F.col("source").alias("f_source"), F.col("line_start").alias("ls"), F.col("line_end").alias("le"))
    around = (F.col("source") == F.col("f_source")) & F.col("line").between(F.col("ls"), F.col("le"))
    x = points.join(f, around, "left").groupBy("source", "line", "n_lines").agg(F.min(F.when(F.col("ls").isNotNull(), F.struct((F.col("le") - F.col("ls")).alias("len"), "ls", "le"))).alias("f"))
    short = F.col("f.len") < longest
    return x.select("source", "line", F.when(short, F.col("f.ls")).otherwise(F.greatest(F.col("line") - reach, F.lit(1))).alias("read_from"), F.when(short, F.col("f.le")).otherwise(F.least(F.col("line") + reach, "n_lines")).alias("read_to"))


def usages(line_rows: DataFrame, name: str) -> DataFrame:
    """Lines with ``name`` as a whole word; the cheap test for the literal comes first."""
    return line_rows.filter(F.contains("text", F.lit(name))).filter(F.col("text").rlike(r"\b\Q" + name + r"\E\b"))


def find_usages(line_rows: DataFrame, definitions: DataFrame, name: str, top_k: int = 30) -> DataFrame:
    """Usages with the definition around them; definitions of the name first, then by source and line. A qualified name without hits is asked for by its last
    part."""
    hits = usages(line_rows, name)
    last = re.split(r"::|->|\.", name)[-1]
    if last != name and hits.isEmpty():
        hits, name = usages(line_rows, last), last
    o = owners(hits.select("source", "line"), definitions, ["source", "line"])
    own = definitions.filter(F.col("name") == name).select("source", F.col("line_start").alias("line"), F.lit("definition").alias("role")).distinct()
    x = hits.join(o, ["source", "line"]).join(own, ["source", "line"], "left")
    x = x.select("source", "line", F.substring(F.trim("text"), 1, 160).alias("text"), F.coalesce("role", F.lit("usage")).alias("role"), F.when(F.col("owner.kind").isNull(), "(module level)").otherwise(F.concat_ws(" ", "owner.kind", "owner.name")).alias("within"))
    return x.orderBy(F.col("role") != "definition", "source", "line").limit(top_k)


def evidence_terms(queries: DataFrame) -> DataFrame:
    """Query terms that content search uses: keywords without common English words."""
    k = F.filter(T.keywords(F.col("query_text")), lambda t: ~t.isin(*T.PROSE_WORDS))
    return queries.select("query_id", k.alias("k")).select("query_id", F.size("k").alias("n_terms"), F.explode("k").alias("term"))


#: Words of one automaton.
AUTOMATON = 200_000


def _substrings(words: list[str]):
    """Which of the words each text (the last column) holds as substrings of its case folding, by one Aho-Corasick automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = ahocorasick.Automaton()
        for w in words:
            auto.add_word(w, w)
        auto.make_automaton()
        for b in batches:
            held = [sorted({w for _, w in auto.iter(casefold(t))}) if t and words else [] for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(held, pa.list_(pa.string()))], names=[*b.schema.names[:-1], "terms"])

    return run


class _Rarity:
    """Score of a file for a question: rarity of the terms it holds and their share, by its path's prior and its length."""

    columns = ("span_no", "terms", "n_lines", "prior")

    def __init__(self, index: DataFrame, q: score.Questions, share: float, length_norm: float):
        self.q, self.norm = q, length_norm
        s = score.statistics(index, q)
        common = max(1, int(s.n * share))
        self.idf = np.where(s.holders <= common, np.log(1 + (s.n - s.holders + 0.5) / (s.holders + 0.5)), 0.0)
        self.mean, self.files = np.ones(len(q.ids)), np.zeros(len(q.ids), dtype=np.int64)
        for r in index.select(*self.columns).mapInArrow(self._lengths, "i bigint, n bigint, lines double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("lines").alias("lines")).collect():  # a row a question
            self.mean[r.i], self.files[r.i] = r.lines / r.n, r.n

    def _lengths(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, lines, walk = np.zeros(len(self.q.ids), dtype=np.int64), np.zeros(len(self.q.ids)), score.Walk(self.q)
        for b, _ in score._chunks(batches):
            n_lines = b.column("n_lines").to_numpy(zero_copy_only=False).astype(np.float64)
            for i, sums in walk.over([self._postings(b, None)], b.num_rows):
                some = np.minimum(sums[0], 1.0)
                n[i] += int(some.sum())
                lines[i] += some @ n_lines
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(lines[at])], names=["i", "n", "lines"])

    def _postings(self, b: pa.RecordBatch, weights: np.ndarray | None) -> score.Postings:
        rows, terms = score._postings(b.column("terms"), pa.array(self.q.terms, pa.string()))
        return score.Postings(rows, terms, None if weights is None else weights[terms], b.num_rows, len(self.q.terms))

    def channels(self, b: pa.RecordBatch) -> list[score.Postings]:
        return [self._postings(b, self.idf), self._postings(b, None)]

    def scores(self, b: pa.RecordBatch) -> Callable[[int, list[np.ndarray]], np.ndarray]:
        n_lines, prior = (b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("n_lines", "prior"))
        return lambda i, sums: prior * (sums[0] + sums[1] / (self.q.sizes[i] + 1)) / (1 - self.norm + self.norm * n_lines / self.mean[i])


@dataclass
class Evidence:
    """A block of questions against all files: the files' terms, the ranker, and which question is which."""

    index: DataFrame
    ranker: _Rarity

    def head(self, depth: int) -> DataFrame:
        """``query_id, source, score, rank`` of the first ``depth`` files of each question."""
        x = score.top(self.index, self.ranker, depth).join(self.index.select("span_no", "source"), "span_no")
        return x.select("query_id", "source", (F.col("points") / score.PLACES).alias("score"), "rank")

    def terms(self) -> DataFrame:
        """``query_id, term, idf`` of the block's questions."""
        q = self.ranker.q
        at = np.repeat(np.arange(len(q.terms)), np.diff(q.start))
        rows = [(int(q.ids[i]), q.terms[t], float(self.ranker.idf[t])) for t, i in zip(at, q.of)]
        return self.index.sparkSession.createDataFrame(rows, "query_id bigint, term string, idf double")


def evidence(files: DataFrame, queries: DataFrame, share: float = 0.2, length_norm: float = 0.5) -> Iterator[Evidence]:
    """Blocks of questions ready to be ranked over all files (source, text).

    A file holds a term if its folded text does as a substring; terms in more than a fifth of all files weigh nothing. One automaton of the terms of all
    blocks finds all of them in one pass over each text; files are then scored in place, and only the best of each task are shuffled.
    """
    k = F.filter(T.keywords(F.col("query_text")), lambda t: ~t.isin(*T.PROSE_WORDS))
    x = score.numbered(files.select("source", "text"), ["source"])
    x = x.select("source", "span_no", F.greatest(F.size(T.physical_lines(F.col("text"))), F.lit(1)).alias("n_lines"), path_prior(F.col("source")).alias("prior"), "text")

    def held(words: list[str]) -> DataFrame:
        return durable(x.mapInArrow(_substrings(words), "source string, span_no bigint, n_lines int, prior double, terms array<string>"), "evidence-files")

    words = [r.t for r in queries.select(F.explode(k).alias("t")).distinct().limit(AUTOMATON + 1).collect()]
    every = held(sorted(words)) if 0 < len(words) <= AUTOMATON else None  # else one automaton a block
    for q in score.question_blocks(queries, k):
        index = held(q.terms) if every is None else every
        yield Evidence(index, _Rarity(index, q, share, length_norm))


#: Files of a question's ranking that are compared again, and lines of a block that is compared.
RERANK, RERANK_LINES = 250, 60
_RANKED = "query_id bigint, source string, bonus double"


def _similar(blocks: list[score.Questions]):
    """``query_id, source, similarity`` of each file with the questions that have it in their head: the best of its blocks. A question's words each meet a
    file's blocks once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = SubwordFeatures()
        known: dict[int, tuple[list[int], float]] = {}
        words: list[str] = []
        for q in blocks:
            terms = np.repeat(np.arange(len(q.terms)), np.diff(q.start)) + len(words)
            order = np.argsort(q.of, kind="stable")
            cut = np.searchsorted(q.of[order], np.arange(len(q.ids) + 1))
            own = terms[order].tolist()
            known |= {i: (own[cut[j] : cut[j + 1]], q.sizes[j]) for j, i in enumerate(q.ids.tolist())}
            words += q.terms
        for b in batches:
            out: list[tuple] = []
            for source, text, asking in zip(*(b.column(i).to_pylist() for i in range(3))):
                asking = [i for i in asking if i in known]
                if not asking:
                    continue
                lines, folded = physical_lines(casefold(text)), casefold(source)
                blocks_ = [features.sparse(f"{folded}\n" + "\n".join(lines[c : c + RERANK_LINES])) for c in range(0, max(len(lines), 1), RERANK_LINES)]
                x = np.zeros((features.dims, len(blocks_)))
                for n, (at, weights) in enumerate(blocks_):
                    x[at, n] = weights
                met: dict[int, np.ndarray] = {}
                for i in asking:
                    own, length = known[i]
                    for t in own:
                        if t not in met:
                            at, weights = features.word(words[t])
                            met[t] = weights @ x[at]
                    out.append((i, source, float(sum(met[t] for t in own).max()) / length))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.float64()))], names=["query_id", "source", "similarity"])

    return run


def _head_rank(head: pa.Table) -> pa.Table:
    """Similarity and reference rank of one question's head (at most 250 files), each over its largest value, added."""
    n = head.num_rows

    def named(column: str) -> tuple[np.ndarray, np.ndarray]:
        x = pa.concat_arrays(head.column(column).chunks)
        return pc.list_parent_indices(x).to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False)

    (files, mentioned), (holders, defined) = named("mentions"), named("defines")
    order = np.argsort(defined, kind="stable")
    holders, defined = holders[order], defined[order]
    first = np.searchsorted(defined, mentioned)
    many = np.searchsorted(defined, mentioned, side="right") - first
    at = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    out = np.zeros((n, n))
    out[np.repeat(files, many), holders[at]] = 1.0
    np.fill_diagonal(out, 0.0)
    degree = out.sum(axis=1)
    moves = np.where(degree[:, None] > 0, out / np.maximum(degree, 1)[:, None], 1.0 / n)
    lexical, similar = (pc.fill_null(head.column(c), 0.0).to_numpy() for c in ("lexical", "similarity"))
    start = lexical / (lexical.sum() or 1.0)
    rank = start
    for _ in range(12):
        rank = 0.15 * start + 0.85 * (rank @ moves)
    scaled = lambda x: x / x.max() if n and x.max() > 0 else np.zeros(n)
    return pa.table({"query_id": head.column("query_id"), "source": head.column("source"), "bonus": scaled(similar) + scaled(rank)})


def rerank(files: DataFrame, definitions: DataFrame, queries: DataFrame, first: DataFrame) -> DataFrame:
    """``first`` (query_id, source, score: the head of each question's ranking) with the score of each file over the question's largest, plus its sub-word
    similarity and its rank in the graph of files that name what another defines, each over its largest. A question with one file keeps its score.

    Only the head is compared again, and as nothing is taken away, what lies beyond can't overtake it. The head of a question is one bounded group;
    features and names are computed once a file, wherever it is asked for. Names travel as hashes.
    """
    w = Window.partitionBy("query_id")
    scores = durable(first.select("query_id", "source", "score").withColumns({"lexical": F.coalesce(F.col("score") / F.max("score").over(w), F.lit(0.0)), "__files": F.count("*").over(w)}), "rerank-scores")
    first = scores.filter("__files > 1").select("query_id", "source", "lexical")
    asking = first.groupBy("source").agg(F.collect_list("query_id").alias("asking"))  # at most the stated questions
    texts = files.select("source", "text").join(asking, "source")
    near = texts.mapInArrow(_similar(list(score.subword_questions(queries))), "query_id bigint, source string, similarity double")
    named = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z_][A-Za-z0-9_]{2,})"), 1)), lambda n: F.xxhash64(n))
    defined = definitions.filter((F.col("name") != "") & (F.col("name") != "<anonymous>")).select("source", F.xxhash64("name").alias("h"))
    names = files.select("source", F.explode(named).alias("h")).join(defined.select("h").distinct(), "h", "left_semi").groupBy("source").agg(F.collect_list("h").alias("mentions"))
    nodes = first.join(near, ["query_id", "source"], "left").join(names, "source", "left").join(defined.groupBy("source").agg(F.collect_set("h").alias("defines")), "source", "left")
    bonus = nodes.select("query_id", "source", "lexical", "similarity", "mentions", "defines").groupBy("query_id").applyInArrow(_head_rank, _RANKED)
    x = scores.join(bonus, ["query_id", "source"], "left")
    blended = F.when(F.col("__files") > 1, F.col("lexical") + F.coalesce("bonus", F.lit(0.0))).otherwise(F.col("score"))
    return x.withColumn("score", blended).drop("lexical", "__files", "bonus")


def evidence_files(files: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """``query_id, source, score, rank``: the best files of each question by rarity of terms, prior and length; ties by source."""
    found = [e.head(top_k) for e in evidence(files, queries)]
    if not found:
        return files.select(F.lit(0).cast("bigint").alias("query_id"), "source", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return reduce(DataFrame.unionByName, found)


#: Files a line asked for of which lines are taken at first.
FEW = 2


def _lines_of_best(line_rows: DataFrame, scores: DataFrame, terms: DataFrame, index: DataFrame, per_file: int, top_k: int) -> DataFrame:
    """Lines of the best ``FEW * top_k`` files of each question, and of all its files where those hold fewer than ``top_k`` lines that no other can precede."""
    x = scores.withColumn("best", F.max(F.round("score", 9)).over(Window.partitionBy("query_id", "source")))
    x = durable(x.withColumn("place", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.col("best").desc(), "source"))), "evidence-places")
    head = x.filter(F.col("place") <= FEW * top_k)
    few = durable(_best_lines(line_rows, head.drop("best", "place"), terms, index, per_file), "evidence-few")
    sure = few.join(head.select("query_id", "source", "best").distinct(), ["query_id", "source"]).filter(F.round("score", 9) == F.col("best"))  # none beyond comes before
    sure = durable(sure.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= top_k).select("query_id"), "evidence-sure")
    rest = _best_lines(line_rows, x.drop("best", "place").join(sure, "query_id", "left_anti"), terms, index, per_file)
    return few.join(sure, "query_id", "left_semi").unionByName(rest)


def _best_lines(line_rows: DataFrame, head: DataFrame, terms: DataFrame, index: DataFrame, per_file: int) -> DataFrame:
    """The ``per_file`` lines of each (query_id, source, score) with the rarest words of the question."""
    held = index.select("source", F.explode("terms").alias("term")).join(head.select("source").distinct(), "source", "left_semi")
    wanted = head.join(held, "source").join(terms, ["query_id", "term"]).select("query_id", "source", "score", "term", "idf")
    lines = line_rows.join(head.select("source").distinct(), "source", "left_semi")
    words = lines.select("source", "line", "text", F.explode(T.line_words(F.col("text"))).alias("term"))
    x = words.join(wanted, ["source", "term"]).groupBy("query_id", "source", "line", "score").agg(F.sum("idf").alias("worth"), F.first("text").alias("text"))
    w = Window.partitionBy("query_id", "source").orderBy(F.round("worth", 9).desc(), "line")
    return x.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_file).drop("n", "worth")


def evidence_hits(files: DataFrame, line_rows: DataFrame, queries: DataFrame, definitions: DataFrame | None = None, top_k: int = 30, per_file: int = 2, head: int = RERANK) -> DataFrame:
    """The best lines of the best files: a line's worth is the rarity of the question's terms among its words; ``per_file`` lines of a file, files by score.
    With ``definitions`` the first ``head`` files are re-ranked.

    The first ``head`` files of a question nearly always hold ``top_k`` lines; for the questions where they don't, eight times as many are looked at, and
    so on to the last file, so the result is that over all files.
    """
    parts = []
    for e in evidence(files, queries):
        terms, depth = durable(e.terms(), "evidence-terms"), head
        open_, most = queries.select("query_id").distinct(), int(e.ranker.files.max(initial=0))
        while True:
            x = durable(e.head(depth).join(open_, "query_id", "left_semi"), "evidence-head")
            first = x.filter(F.col("rank") <= head)
            scores = x.select("query_id", "source", "score")
            if definitions is not None:
                moved = rerank(files, definitions, queries, first)
                rest = x.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("query_id"))).filter(F.col("rank") > head)
                scores = moved.select("query_id", "source", "score").unionByName(rest.select("query_id", "source", "score"))
            best = durable(_lines_of_best(line_rows, scores, terms, e.index, per_file, top_k), "evidence-lines")
            if depth >= most:
                parts.append(best)
                break
            short = x.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= depth).select("query_id")
            short = short.join(best.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= top_k), "query_id", "left_anti")
            short = durable(short, "evidence-short")
            parts.append(best.join(short, "query_id", "left_anti"))
            if short.isEmpty():
                break
            open_, depth = short, depth * 8
    if not parts:
        return line_rows.select(F.lit(0).cast("bigint").alias("query_id"), F.lit(0).alias("rank"), "source", "line", "text").limit(0)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "source", "line")
    x = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
    return x.select("query_id", "rank", "source", "line", F.substring(F.trim("text"), 1, 160).alias("text"))


def find_symbols(symbols: DataFrame, queries: DataFrame, kinds: list[str] | None = None, top_k: int = 30) -> DataFrame:
    """Definitions whose name answers a query: 2 for the name itself, 1 more for its exact case, 0.5 for a declaration, plus the share of the query's words in
    the name. If a query is one name and it is found exactly, partial matches are dropped.

    ``symbols`` has ``name, kind, source, line_start, line_end``. They are scored where they lie, and only the best of each task are shuffled. An exact match
    has 2 at least and any other 1.5 at most, so whether there is one is seen from the best.
    """
    words = F.array_distinct(F.regexp_extract_all(F.col("query_text"), F.lit("([A-Za-z0-9_]+)"), 1))
    single = F.trim("query_text").rlike("^[A-Za-z0-9_]+$")
    k = T.keywords(F.col("query_text"))
    names = F.when(single, F.array(T.casefold(F.trim("query_text")))).otherwise(k)
    parts = F.filter(T.identifier_terms(F.concat(k, words)), lambda t: ~t.isin(*T.STOPWORDS))
    marked = lambda mark, c: F.transform(c, lambda t: F.concat(F.lit(mark), t))
    q = queries.filter("query_text is not null").select("query_id", F.concat(marked(_PART, parts), marked(_NAME, names), marked(_CASE, words)).alias("terms"), F.size(names).alias("n_names"))
    s = symbols.filter((F.col("name") != "") & (F.col("name") != "<anonymous>"))
    if kinds:
        s = s.filter(kind_of(F.col("kind")).isin(*{KIND_ALIASES.get(x.casefold(), x.casefold()) for x in kinds}))
    key = ["source", "line_start", "line_end", "name"]
    terms = F.concat(marked(_PART, T.identifier_terms(F.array("name"))), F.array(F.concat(F.lit(_NAME), T.casefold(F.col("name"))), F.concat(F.lit(_CASE), F.col("name"))))
    declared = F.when(F.lower("kind").isin(*CONTAINER_KINDS), 0.0).otherwise(0.5)
    index = score.numbered_spans(s.select("name", "kind", "source", "line_start", "line_end"), terms, {"kind": F.col("kind"), "declared": declared}, key)
    found = [score.top(index, _Named(b), top_k) for b in score.question_blocks(q, F.col("terms"))]
    if not found:
        return s.select(F.lit(0).cast("bigint").alias("query_id"), F.lit(0).alias("rank"), "name", "kind", "source", "line_start", "line_end", F.lit(0.0).alias("score")).limit(0)
    x = reduce(DataFrame.unionByName, found).join(q.select("query_id", "n_names"), "query_id").withColumn("score", F.col("points") / score.PLACES)
    exact = F.col("score") >= 2
    decisive = (F.col("n_names") == 1) & F.max(exact).over(Window.partitionBy("query_id"))
    x = x.withColumn("keep", ~decisive | exact).filter("keep").join(index.select("span_no", "name", "kind", "source", "line_start", "line_end"), "span_no")
    return x.select("query_id", "rank", "name", "kind", "source", "line_start", "line_end", "score")


# Marks of what a term of a definition is: a part of its name, its folded name, its name.
_PART, _NAME, _CASE = "p:", "n:", "c:"


class _Named:
    """Score of a definition for a question by its name."""

    columns = ("span_no", "terms", "declared")

    def __init__(self, q: score.Questions):
        self.q = q
        part = np.array([t.startswith(_PART) for t in q.terms], dtype=bool)
        self.parts = np.zeros(len(q.ids))
        np.add.at(self.parts, q.of, np.repeat(part, np.diff(q.start)).astype(np.float64))

    def channels(self, b: pa.RecordBatch) -> list[score.Postings]:
        rows, terms = score._postings(b.column("terms"), pa.array(self.q.terms, pa.string()))
        some = [(marks := np.array([t.startswith(m) for t in self.q.terms], dtype=bool)[terms], rows[marks], terms[marks])[1:] for m in (_PART, _NAME, _CASE)]
        return [score.Postings(r, t, None, b.num_rows, len(self.q.terms)) for r, t in some]

    def scores(self, b: pa.RecordBatch) -> Callable[[int, list[np.ndarray]], np.ndarray]:
        declared = b.column("declared").to_numpy(zero_copy_only=False)

        def of(i: int, sums: list[np.ndarray]) -> np.ndarray:
            shared, exact, case = sums
            x = shared * (1 / self.parts[i]) if self.parts[i] else np.zeros(len(shared))
            x += declared
            x[(shared == 0) & (exact == 0)] = 0.0
            if len(at := np.flatnonzero(exact)):
                x[at] += 2 + (case[at] > 0)
            return x

        return of
