"""Scoring every span for a stated set of questions without shuffling a posting.

The questions come in blocks of a fixed size that are sent to the tasks; each task sums the columns of a question's terms over slabs of its own spans, what
questions have in common once (``Walk``), and keeps the best of each question. What is shuffled are at most ``k`` rows a question and task, so a term that
stands in every span costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineweave.functions import text as T
from lineweave.functions.keywords import Keywords, casefold, path_keywords
from lineweave.functions.subword import DIMS, SubwordFeatures
from lineweave.plans.durable import durable

#: Questions of a block, spans that are scored at once, and those of them that give a first bound.
BLOCK, CHUNK, FIRST = 4096, 16384, 1024
#: Columns of a slab that are kept ready.
KEPT = 256
#: Scores are compared to so many places.
PLACES = 1e9
SPAN = ["source", "token_start", "token_end"]


@dataclass(frozen=True)
class Questions:
    """A block of questions: which ask for which term (``of[start[t] : start[t + 1]]`` ask for term t), and how many terms each has."""

    ids: np.ndarray
    terms: list[str]
    start: np.ndarray
    of: np.ndarray
    sizes: np.ndarray
    scopes: list[str] | None = None


def question_blocks(queries: DataFrame, terms: Column, block: int = BLOCK) -> Iterator[Questions]:
    """The questions (query_id and a column of terms) in blocks of about ``block``; those without terms are left out. Only one block is held at a time."""
    scoped = "scope" in queries.columns
    q = queries.select("query_id", terms.alias("k"), *(["scope"] if scoped else [])).filter(F.size("k") > 0)
    n = q.count()
    parts = max(1, -(-n // block))
    for i in range(parts):
        rows = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).collect() if n else []
        if not rows:
            continue
        rows.sort(key=lambda r: r.query_id)
        words = sorted({t for r in rows for t in r.k})
        at = {t: j for j, t in enumerate(words)}
        pairs = np.array(sorted((at[t], j) for j, r in enumerate(rows) for t in set(r.k)), dtype=np.int64).reshape(-1, 2)
        start = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
        yield Questions(np.array([r.query_id for r in rows], dtype=np.int64), words, start, pairs[:, 1], np.array([len(r.k) for r in rows], dtype=np.float64), [r.scope for r in rows] if scoped else None)


def numbered(rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """``rows`` with ``span_no``, whose order is that of their keys. What is computed from the result runs within the ranges of keys, once a row."""
    cols = [F.col(c) for c in key or SPAN]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("span_no", F.monotonically_increasing_id())


def numbered_spans(spans: DataFrame, terms: Column, more: dict[str, Column] | None = None, key: list[str] | None = None) -> DataFrame:
    """Spans numbered in the order of their keys, with their terms: written once, read by every pass."""
    x = numbered(spans, key).select(*(key or SPAN), "span_no", terms.alias("terms"), *[c.alias(n) for n, c in (more or {}).items()])
    return durable(x, "score-numbered")


def _postings(lists: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and term of each asked term of a list column."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    found = pc.index_in(lists.flatten(), value_set=terms)
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    have = found.is_valid().to_numpy(zero_copy_only=False)
    return rows[have].astype(np.int64), found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)


def _spread(q: Questions, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
    """Sum of the weights of shared terms: a table of questions by rows."""
    many = q.start[terms + 1] - q.start[terms]
    first = np.repeat(q.start[terms], many)
    step = np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
    cells = q.of[first + step] * n + np.repeat(rows, many)
    return np.bincount(cells, weights=None if weights is None else np.repeat(weights, many), minlength=len(q.ids) * n).reshape(len(q.ids), n).astype(np.float64)


class Postings:
    """Weights of terms in a slab of ``n`` rows, added to sums a term at a time."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray | None, n: int, n_terms: int):
        cells, back = np.unique(terms * n + rows, return_inverse=True)
        self.rows, self.n = cells % n, n
        self.weights = np.bincount(back, weights, len(cells)).astype(np.float64)
        self.start = np.searchsorted(cells, np.arange(n_terms + 1) * n)
        self.has = np.diff(self.start) > 0
        self.ready: dict[int, np.ndarray] = {}

    def add(self, t: int, before: np.ndarray, out: np.ndarray) -> None:
        a, b = self.start[t], self.start[t + 1]
        if (b - a) * 8 < self.n:
            out[:] = before
            if b > a:
                out[self.rows[a:b]] += self.weights[a:b]
            return
        if (column := self.ready.get(t)) is None:
            column = np.zeros(self.n)
            column[self.rows[a:b]] = self.weights[a:b]
            if len(self.ready) < KEPT:
                self.ready[t] = column
        np.add(before, column, out=out)


class Walk:
    """A block's questions in the order of their terms, the most asked first, so that what consecutive questions have in common is summed once."""

    def __init__(self, q: Questions, only: np.ndarray | None = None):
        many = np.diff(q.start)
        place = np.empty(len(many), dtype=np.int64)
        place[np.argsort(-many, kind="stable")] = np.arange(len(many))
        terms = np.repeat(np.arange(len(many)), many)
        order = np.lexsort((place[terms], q.of))
        asked, start = terms[order].tolist(), np.searchsorted(q.of[order], np.arange(len(q.ids) + 1))
        some = range(len(q.ids)) if only is None else only.tolist()
        self.questions = sorted(((i, asked[start[i] : start[i + 1]]) for i in some), key=lambda x: [place[t] for t in x[1]])

    def over(self, channels: list[Postings], n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Each question's place and the sums of its terms in each channel over ``n`` rows; the arrays hold until the next step."""
        has = np.any([c.has for c in channels], axis=0).tolist()
        sums = [[np.zeros(n) for _ in channels]]
        last: list[int] = []
        for i, asked in self.questions:
            terms = [t for t in asked if has[t]]
            same = 0
            for a, b in zip(last, terms):
                if a != b:
                    break
                same += 1
            for d in range(same, len(terms)):
                if len(sums) == d + 1:
                    sums.append([np.empty(n) for _ in channels])
                for c, before, out in zip(channels, sums[d], sums[d + 1]):
                    c.add(terms[d], before, out)
            last = terms
            yield i, sums[len(terms)]


@dataclass(frozen=True)
class Statistics:
    """Of all spans: how many, mean number of terms, and for each asked term in how many spans it stands."""

    n: int
    mean: float
    holders: np.ndarray


def statistics(index: DataFrame, q: Questions, repeated: bool = False) -> Statistics:
    """One pass over the spans; each task sends one sum a term. ``repeated``: the lists hold a term as often as it occurs."""
    terms = pa.array(q.terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = length = 0
        held = np.zeros(len(terms), dtype=np.int64)
        for b in batches:
            rows, at = _postings(b.column(0), terms)
            if repeated:
                rows, at = np.unique(np.stack([rows, at]), axis=1)
            held += np.bincount(at, minlength=len(terms))
            n += b.num_rows
            length += len(pc.list_flatten(b.column(0)))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[n, length], held[some]]))], names=["t", "c"])

    got = {r.t: r.c for r in index.select("terms").mapInArrow(run, "t bigint, c bigint").groupBy("t").agg(F.sum("c").alias("c")).collect()}  # a row a term of the block
    n = got.get(-2, 0)
    return Statistics(n, got.get(-1, 0) / n if n else 0.0, np.array([got.get(i, 0) for i in range(len(q.terms))], dtype=np.float64))


class Ranker(Protocol):
    """Scores from sums of terms: which columns it reads, the weights of terms in a slab, and a question's scores from their sums."""

    q: Questions
    columns: Any

    def channels(self, b: pa.RecordBatch) -> list[Postings]: ...

    def scores(self, b: pa.RecordBatch) -> Callable[[int, list[np.ndarray]], np.ndarray]: ...


class Bm25:
    """BM25; with ``repeated`` a term counts as often as it occurs, else once."""

    def __init__(self, index: DataFrame, q: Questions, k1: float = 1.5, b: float = 0.75, repeated: bool = False):
        self.q, self.k1, self.b, self.repeated = q, k1, b, repeated
        self.columns = ("span_no", "terms") if q.scopes is None else ("span_no", "terms", "scope")
        s = statistics(index, q, repeated)
        self.mean = s.mean
        self.idf = np.log(1 + (s.n - s.holders + 0.5) / (s.holders + 0.5))

    def channels(self, b: pa.RecordBatch) -> list[Postings]:
        rows, terms = _postings(b.column("terms"), pa.array(self.q.terms, pa.string()))
        often = 1.0
        if self.repeated:
            both, often = np.unique(np.stack([rows, terms]), axis=1, return_counts=True)
            rows, terms = both
        size = pc.fill_null(pc.list_value_length(b.column("terms")), 0).to_numpy(zero_copy_only=False).astype(np.float64)
        norm = self.k1 * (1 - self.b + self.b * size[rows] / (self.mean or 1.0))
        return [Postings(rows, terms, self.idf[terms] * often * (self.k1 + 1) / (often + norm), b.num_rows, len(self.q.terms))]

    def scores(self, b: pa.RecordBatch) -> Callable[[int, list[np.ndarray]], np.ndarray]:
        return lambda i, sums: sums[0]


class Coverage:
    """Share of a question's terms in the text, their density, and half the share in the path."""

    def __init__(self, index: DataFrame, q: Questions):
        self.q = q
        self.columns = ("span_no", "terms", "path_terms", "n_tokens") + (() if q.scopes is None else ("scope",))

    def parts(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        asked = pa.array(self.q.terms, pa.string())
        hits = _spread(self.q, *_postings(b.column("terms"), asked), None, b.num_rows)
        path = _spread(self.q, *_postings(b.column("path_terms"), asked), None, b.num_rows)
        return hits, hits / self.q.sizes[:, None], hits / b.column("n_tokens").to_numpy(zero_copy_only=False)[None, :], 0.5 * path / self.q.sizes[:, None]

    def channels(self, b: pa.RecordBatch) -> list[Postings]:
        asked = pa.array(self.q.terms, pa.string())
        return [Postings(*_postings(b.column(c), asked), None, b.num_rows, len(asked)) for c in ("terms", "path_terms")]

    def scores(self, b: pa.RecordBatch) -> Callable[[int, list[np.ndarray]], np.ndarray]:
        density = 1 / b.column("n_tokens").to_numpy(zero_copy_only=False)
        gain = {n: 1 / n + density for n in set(self.q.sizes.tolist())}
        return lambda i, sums: sums[0] * gain[self.q.sizes[i]] + sums[1] * (0.5 / self.q.sizes[i])


class Subword:
    """Cosine of hashed sub-word features; spans keep their heaviest. What is at most ``floor`` counts as nothing.

    A question's vector is the sum of its words' over its length, so each word meets the spans once and a question adds up its words.
    """

    columns = ("span_no", "buckets", "weights")

    def __init__(self, q: Questions, floor: float = 0.02):
        self.q, self.floor = q, floor  # sizes are the lengths of the questions' vectors

    def channels(self, b: pa.RecordBatch) -> list[Postings]:
        return [_WordPostings(self.q.terms, b)]

    def scores(self, b: pa.RecordBatch) -> Callable[[int, list[np.ndarray]], np.ndarray]:
        def of(i: int, sums: list[np.ndarray]) -> np.ndarray:
            x = sums[0] / self.q.sizes[i]
            x[x <= self.floor] = 0.0
            return x

        return of


class _WordPostings(Postings):
    """Products of the words' features with a slab's, summed when a word is asked for."""

    def __init__(self, words: list[str], b: pa.RecordBatch):
        lists = b.column("buckets")
        rows, buckets = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(buckets, kind="stable")
        self.n, self.rows, self.weights = b.num_rows, rows[order], b.column("weights").flatten().to_numpy(zero_copy_only=False)[order]
        self.start = np.searchsorted(buckets[order], np.arange(DIMS + 1))
        features = SubwordFeatures()
        self.words = [features.word(w) for w in words]
        self.has = np.ones(len(words), dtype=bool)
        self.ready = {}

    def add(self, t: int, before: np.ndarray, out: np.ndarray) -> None:
        if (column := self.ready.get(t)) is None:
            cuts = [(slice(self.start[k], self.start[k + 1]), v) for k, v in zip(*self.words[t])]
            column = np.bincount(np.concatenate([self.rows[c] for c, _ in cuts]), np.concatenate([self.weights[c] * v for c, v in cuts]), self.n)
            if len(self.ready) < KEPT:
                self.ready[t] = column
        np.add(before, column, out=out)


def subword_index(spans: DataFrame) -> DataFrame:
    """Numbered spans with the buckets and weights of their heaviest sub-word features, computed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = SubwordFeatures()
        for b in batches:
            found = [features.sparse(casefold(t or "")) for t in b.column(len(SPAN) + 1).to_pylist()]
            at = pa.array(np.concatenate([[0], np.cumsum([len(k) for k, _ in found])]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([x[j] for x in found]), t)) for j, t in enumerate((pa.int32(), pa.float64()))] if found else [pa.array([], pa.list_(t)) for t in (pa.int32(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(SPAN) + 1], *lists], names=[*SPAN, "span_no", "buckets", "weights"])

    kinds = dict(spans.dtypes)
    x = numbered(spans.select(*SPAN, "text")).select(*SPAN, "span_no", "text")
    return durable(x.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in SPAN) + ", span_no bigint, buckets array<int>, weights array<double>"), "score-features")


def subword_questions(queries: DataFrame, block: int = BLOCK) -> Iterator[Questions]:
    """Blocks of questions by their words, as often as they occur; ``sizes`` are the lengths of their feature vectors."""
    q = queries.filter("query_text is not null").select("query_id", T.casefold(F.col("query_text")).alias("t"))
    parts = max(1, -(-q.count() // block))
    features = SubwordFeatures()
    for i in range(parts):
        found = [(r.query_id, features.words(r.t)) for r in sorted(q.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).collect(), key=lambda r: r.query_id)]
        if not (found := [x for x in found if x[1]]):
            continue
        words = sorted({w for _, x in found for w in x})
        at = {w: j for j, w in enumerate(words)}
        pairs = np.array(sorted((at[w], j) for j, (_, x) in enumerate(found) for w in x), dtype=np.int64)
        yield Questions(np.array([x for x, _ in found], dtype=np.int64), words, np.searchsorted(pairs[:, 0], np.arange(len(words) + 1)), pairs[:, 1], np.array([features.length(x) for _, x in found]))


def subword_blocks(queries: DataFrame, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of questions (query_id, query_text): their identifiers and their feature vectors, a row each."""
    q = queries.filter("query_text is not null").select("query_id", T.casefold(F.col("query_text")).alias("t"))
    parts = max(1, -(-q.count() // block))
    features = SubwordFeatures()
    for i in range(parts):
        rows = sorted(q.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).collect(), key=lambda r: r.query_id)
        if rows:
            yield np.array([r.query_id for r in rows], dtype=np.int64), np.stack([features.dense(r.t, None) for r in rows])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slabs of the batches with the spans' numbers in order."""

    def slabs() -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held, rows = [*held, b], rows + b.num_rows
            if rows >= CHUNK:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches(CHUNK)
                held, rows = [], 0
        if rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(CHUNK)

    for b in slabs():
        b = b.take(pc.sort_indices(b.column("span_no")))
        yield b, b.column("span_no").to_numpy(zero_copy_only=False)


def _scores(walk: Walk, ranker: Ranker, b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """Each question's place, its scores over a slab, and the rows of its scope where it has one (the scores are theirs then)."""
    q, score = ranker.q, ranker.scores(b)
    rows: dict[str, np.ndarray] = {}
    if q.scopes is not None:
        every = b.column("scope").dictionary_encode()
        at = pc.fill_null(every.indices, -1).to_numpy(zero_copy_only=False)
        rows = {s: np.flatnonzero(at == k) for k, s in enumerate(every.dictionary.to_pylist())}
    none = np.empty(0, dtype=np.int64)
    for i, sums in walk.over(ranker.channels(b), b.num_rows):
        if q.scopes is None:
            yield i, score(i, sums), None
        elif len(own := rows.get(q.scopes[i], none)):
            yield i, score(i, sums)[own], own


def top(index: DataFrame, ranker: Ranker, k: int) -> DataFrame:
    """``query_id, span_no, points``: the ``k`` best spans of each question with a score above 0; ``points`` is the score times 1e9 as a whole number.

    What lies below the ``k``-th best score so far is passed over; in a first slab the ``k``-th best of its first rows is the bound.
    """
    q = ranker.q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, none = Walk(q), np.empty(0, dtype=np.int64)
        best, number, low = [none] * len(q.ids), [none] * len(q.ids), np.zeros(len(q.ids))
        for b, numbers in _chunks(batches):
            for i, s, own in _scores(walk, ranker, b):
                bound = low[i]
                if not bound and k < FIRST < len(s):
                    bound = max(0.0, np.partition(s[:FIRST], FIRST - k)[FIRST - k] - 2 / PLACES)
                at = np.flatnonzero(s > bound)
                if not len(at):
                    continue
                points = np.concatenate([best[i], np.rint(s[at] * PLACES).astype(np.int64)])
                where = np.concatenate([number[i], numbers[at if own is None else own[at]]])
                if len(points) > k:
                    order = np.lexsort((where, -points))[:k]
                    points, where = points[order], where[order]
                    low[i] = max(0.0, (points[-1] - 1) / PLACES)
                best[i], number[i] = points, where
        points, where = (np.concatenate([none, *x]) for x in (best, number))
        ids = np.repeat(q.ids, [len(x) for x in best])
        some = points > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(where[some]), pa.array(points[some])], names=["query_id", "span_no", "points"])

    found = index.select(*ranker.columns).mapInArrow(run, "query_id bigint, span_no bigint, points bigint")
    w = Window.partitionBy("query_id").orderBy(F.col("points").desc(), "span_no")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def places(index: DataFrame, ranker: Ranker, asked: DataFrame) -> DataFrame:
    """``query_id, span_no, points, rank`` for the asked pairs (query_id, span_no): the rank among all spans, found by counting those that come before.

    ``asked`` holds a bounded number of spans of each question of the ranker's block. Pairs with a score of 0 have no rank and give no row.
    """
    q = ranker.q

    def by_question(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(who, q.ids), np.searchsorted(who, q.ids, side="right")

    pairs = asked.select("query_id", "span_no").distinct().toArrow()  # a block's questions times a bounded number of spans
    who, span = (pairs.column(i).to_numpy().astype(np.int64) for i in range(2))
    order = np.lexsort((span, who))
    who, span = who[order], span[order]
    cut = by_question(who)
    wanted = np.unique(span)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(q, np.flatnonzero(cut[1] > cut[0]))
        for b, numbers in _chunks(batches):
            keep = np.flatnonzero(np.isin(numbers, wanted))
            if len(keep):
                b, numbers, out = b.take(pa.array(keep)), numbers[keep], []
                for i, s, own in _scores(walk, ranker, b):
                    at = np.flatnonzero(np.isin(numbers if own is None else numbers[own], span[cut[0][i] : cut[1][i]]) & (s > 0))
                    if len(at):
                        out.append((np.full(len(at), q.ids[i]), numbers[at if own is None else own[at]], np.rint(s[at] * PLACES).astype(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query_id", "span_no", "points"])

    scored = durable(index.select(*ranker.columns).mapInArrow(scores, "query_id bigint, span_no bigint, points bigint").filter("points > 0"), "score-asked")
    held = scored.select("query_id", "span_no", "points").toArrow()
    h_who, h_span, h_points = (held.column(i).to_numpy().astype(np.int64) for i in range(3))
    order = np.lexsort((h_span, -h_points, h_who))
    h_who, h_span, h_points = h_who[order], h_span[order], h_points[order]
    h_cut = by_question(h_who)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.zeros(len(h_who), dtype=np.int64)
        walk = Walk(q, np.flatnonzero(h_cut[1] > h_cut[0]))
        for b, numbers in _chunks(batches):
            limits = h_points * CHUNK + (CHUNK - 1 - np.searchsorted(numbers, h_span))  # ties go by place
            turned = CHUNK - 1 - np.arange(b.num_rows)
            for i, s, own in _scores(walk, ranker, b):
                mine = limits[h_cut[0][i] : h_cut[1][i]]
                keys = np.rint(s * PLACES).astype(np.int64) * CHUNK + (turned if own is None else turned[own])
                keys = np.sort(keys[keys > mine.min()])
                before[h_cut[0][i] : h_cut[1][i]] += len(keys) - np.searchsorted(keys, mine, side="right")
        yield pa.RecordBatch.from_arrays([pa.array(h_who), pa.array(h_span), pa.array(before)], names=["query_id", "span_no", "before"])

    ranks = index.select(*ranker.columns).mapInArrow(count, "query_id bigint, span_no bigint, before bigint").groupBy("query_id", "span_no").agg((F.sum("before") + 1).alias("rank"))
    return scored.join(ranks, ["query_id", "span_no"])


def fused_top(index: DataFrame, q: Questions, k: int = 64, rrf: int = 60) -> DataFrame:
    """``query_id, span_no, rrf, bm25, coverage`` of the ``k`` best spans by reciprocal rank fusion of BM25 and coverage over complete rankings.

    Exact without ranking everything: the best k of one ranking have at least 1 / (rrf + k), and a span beyond place D of both at most 2 / (rrf + D + 1),
    so with D = rrf + 2 k none of those is among the best k. Of the spans up to place D of only one, the exact rank in the other is counted if they would be
    among the best k with place D + 1 there.
    """
    depth = rrf + 2 * k
    rankers = {"bm25": Bm25(index, q), "coverage": Coverage(index, q)}
    heads = {n: durable(top(index, r, depth), f"fuse-{n}") for n, r in rankers.items()}
    one_over = lambda c: F.coalesce(1 / (rrf + F.col(c)), F.lit(0.0))
    a, b = (heads[n].select("query_id", "span_no", F.col("rank").alias(n)) for n in rankers)
    x = a.join(b, ["query_id", "span_no"], "full").withColumn("least", one_over("bm25") + one_over("coverage"))
    own = Window.partitionBy("query_id")
    x = x.withColumn("place", F.row_number().over(own.orderBy(F.col("least").desc()))).withColumn("kth", F.coalesce(F.max(F.when(F.col("place") == k, F.col("least"))).over(own), F.lit(0.0)))
    union = durable(x.withColumns({f"all_{n}": F.count(n).over(own) for n in rankers}).filter(F.col("least") + 1 / (rrf + depth + 1) >= F.col("kth") - 2 / PLACES), "fuse-union")
    parts = []
    for n, r in rankers.items():
        beyond = union.filter(F.col(n).isNull() & (F.col(f"all_{n}") >= depth))  # a shorter list is the whole ranking
        parts += [x.select("query_id", "span_no", F.lit(n).alias("group"), "points", F.col("rank").cast("bigint").alias("rank")) for x in (heads[n], places(index, r, beyond))]
    x = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    one = lambda n: F.max(F.when(F.col("group") == n, F.col("points") / PLACES))
    x = x.groupBy("query_id", "span_no").agg(F.sum(1 / (rrf + F.col("rank"))).alias("rrf"), one("bm25").alias("bm25"), one("coverage").alias("coverage"))
    w = Window.partitionBy("query_id").orderBy(F.round("rrf", 9).desc(), "span_no")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _with_keywords(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keywords of the first column's paths and of the last column's texts in place of the texts, as ``text`` gives them; each word is taken apart once."""
    words = Keywords()
    for b in batches:
        found = ((path_keywords, b.column(0)), (words.of, b.column(b.num_columns - 1)))
        lists = [pa.array([None if t is None else of(t) for t in c.to_pylist()], pa.list_(pa.string())) for of, c in found]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *lists], names=[*b.schema.names[:-1], "path_terms", "terms"])


def keyword_index(spans: DataFrame) -> DataFrame:
    """Numbered spans for BM25 and coverage; questions with a ``scope`` see only spans of the same."""
    n = F.greatest(F.col("token_end") - F.col("token_start"), F.lit(1)).cast("double")
    x = numbered(spans.select(*SPAN, *(["scope"] if "scope" in spans.columns else []), n.alias("n_tokens"), "text"))
    x = x.select(*[c for c in x.columns if c != "text"], "text")
    kinds = ", ".join(f"{c} {t}" for c, t in x.dtypes if c != "text")
    return durable(x.mapInArrow(_with_keywords, f"{kinds}, path_terms array<string>, terms array<string>"), "score-numbered")


def signal_counts(index: DataFrame, q: Questions) -> DataFrame:
    """``query_id, entries, spans``: how many entries the complete rankings by BM25 and coverage have, and how many different spans these are."""
    ranker = Coverage(index, q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, every = (np.zeros(len(q.ids), dtype=np.int64) for _ in range(2))
        for b, _ in _chunks(batches):
            hits, _, _, bonus = ranker.parts(b)
            covered = (hits > 0) | (bonus > 0)
            entries += (hits > 0).sum(axis=1) + covered.sum(axis=1)  # a shared term gives BM25 a score above 0
            every += covered.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(q.ids), pa.array(entries), pa.array(every)], names=["query_id", "entries", "spans"])

    x = index.select(*ranker.columns).mapInArrow(run, "query_id bigint, entries bigint, spans bigint")
    return x.groupBy("query_id").agg(F.sum("entries").alias("entries"), F.sum("spans").alias("spans")).filter("entries > 0")
