"""Packing ranked spans under a hard token budget.

A query's candidates are few after ranking (64 by default), so each query is one small group: the walk over them runs in a grouped map, and queries spread
over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineweave.functions import text as T


@dataclass
class Span:
    """A candidate in one query's packing. Lines are given where the span may be united with others of its source."""

    source: str
    start: int
    end: int
    score: float
    terms: frozenset[str]
    lines: tuple[str, ...] = ()
    line_start: int | None = None
    names: frozenset[str] = frozenset()
    needs: frozenset[str] = frozenset()
    named: bool = False
    parts: tuple[int, ...] = field(default=())

    @property
    def tokens(self) -> int:
        return self.end - self.start

    def holds(self, other: Span) -> bool:
        return self.source == other.source and self.start <= other.start and other.end <= self.end

    def meets(self, other: Span) -> bool:
        return self.source == other.source and self.start < other.end and other.start < self.end


def unite(a: Span, b: Span) -> Span | None:
    """The union of overlapping spans if the lines they share are the same, else None."""
    if a.line_start is None or b.line_start is None:
        return None
    if b.line_start < a.line_start:
        a, b = b, a
    skip = b.line_start - a.line_start
    shared = min(len(a.lines) - skip, len(b.lines))
    if shared <= 0 or a.lines[skip : skip + shared] != b.lines[:shared]:
        return None
    return Span(
        a.source, a.start, max(a.end, b.end), max(a.score, b.score), a.terms | b.terms, a.lines + b.lines[shared:], a.line_start, a.names | b.names, a.needs | b.needs, a.named or b.named, a.parts + b.parts
    )


def with_candidate(chosen: Sequence[Span], new: Span) -> list[Span] | None:
    """``chosen`` with ``new`` added, united with what it overlaps; None if it adds nothing or can't be united."""
    if any(c.holds(new) for c in chosen):
        return None
    out = []
    for c in chosen:
        if not new.meets(c):
            out.append(c)
        elif (u := unite(new, c)) is None:
            return None
        else:
            new = u
    return [*out, new]


def in_dependency_order(spans: Sequence[Span]) -> list[Span]:
    """Definitions before the spans that need them, else in the given order; members of cycles come last, in the given order."""
    waits = {i: {j for j, d in enumerate(spans) if j != i and d.names & s.needs} for i, s in enumerate(spans)}
    out: list[int] = []
    while len(out) < len(spans):
        free = next((i for i in range(len(spans)) if i not in out and waits[i] <= set(out)), None)
        if free is None:
            out += [i for i in range(len(spans)) if i not in out]
        else:
            out.append(free)
    return [spans[i] for i in out]


def pack_by_score(ranked: Sequence[Span], budget: int) -> list[Span]:
    """Walk down the ranking; what is too large, overlaps or overflows the budget is passed over."""
    out: list[Span] = []
    used = 0
    for s in ranked:
        if not any(s.meets(o) for o in out) and used + s.tokens <= budget:
            out.append(s)
            used += s.tokens
    return out


def pack_by_coverage(ranked: Sequence[Span], query: frozenset[str], budget: int) -> list[Span]:
    """Take, again and again, the span that fits and brings most: definitions asked for, then new query terms per token, new terms, a new source, rank."""
    chosen: list[Span] = []
    left = dict(enumerate(ranked))
    covered: set[str] = set()
    wanted = [(s.source, s.start, s.end) for s in ranked if s.named]
    got: set[tuple[str, int, int]] = set()

    def inside(s: Span) -> set[tuple[str, int, int]]:
        return {w for w in wanted if w[0] == s.source and s.start <= w[1] and w[2] <= s.end}

    while True:
        best = None
        used = sum(c.tokens for c in chosen)
        for i, s in left.items():
            after = with_candidate(chosen, s)
            if after is None:
                continue
            total = sum(c.tokens for c in after)
            if total <= used or total > budget:
                continue
            new = (s.terms & query) - covered
            gain = (len(inside(s) - got), len(new) / (total - used), len(new), s.source not in {c.source for c in chosen}, s.score, -i)
            if best is None or gain > best[0]:
                best = (gain, i, after)
        if best is None:
            return in_dependency_order(chosen)
        taken = left.pop(best[1])
        chosen = best[2]
        covered |= taken.terms & query
        for c in chosen:
            got |= inside(c)


def head(candidates: DataFrame, k: int = 64) -> DataFrame:
    """The first ``k`` candidates of each query by rank_score, source and range, as ``rank``."""
    w = Window.partitionBy("query_id").orderBy(F.col("rank_score").desc(), "source", "start", "end")
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


_PACKED = "query_id bigint, position int, source string, start bigint, end bigint, n_tokens bigint, n_united int"


def pack(candidates: DataFrame, queries: DataFrame, budget: int, strategy: str = "coverage", k: int = 64) -> DataFrame:
    """Selected spans of each query in order: ``query_id, position, source, start, end, n_tokens, n_united``.

    ``candidates`` has ``query_id, source, start, end, rank_score, text`` and may have ``line_start``, the ``names`` a span defines, those it ``needs`` and
    whether the question ``named`` one of them; ``queries`` has ``query_id, query_text`` and may have a ``budget`` of its own.
    """
    c = head(candidates, k).withColumn("terms", T.keywords(F.col("text")))
    if "line_start" not in c.columns:
        c = c.withColumn("line_start", F.lit(None).cast("int"))
    none = F.array().cast("array<string>")
    for name, absent in (("names", none), ("needs", none), ("named", F.lit(False))):
        if name not in c.columns:
            c = c.withColumn(name, absent)
    own = F.col("budget") if "budget" in queries.columns else F.lit(budget)
    q = queries.select("query_id", T.keywords(F.col("query_text")).alias("query_terms"), own.cast("bigint").alias("budget"))
    c = c.drop("budget").join(q, "query_id").select("query_id", "rank", "source", "start", "end", "rank_score", "terms", "query_terms", "line_start", "text", "names", "needs", "named", "budget")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        spans = [
            Span(r.source, int(r.start), int(r.end), r.rank_score, frozenset(r.terms), tuple((r.text or "").splitlines(keepends=True)), None if pd.isna(r.line_start) else int(r.line_start), frozenset(r.names), frozenset(r.needs), bool(r.named), (int(r.rank),))
            for r in pdf.itertuples()
        ]
        most = int(pdf.budget.iloc[0])
        out = pack_by_score(spans, most) if strategy == "score" else pack_by_coverage(spans, frozenset(pdf.query_terms.iloc[0]), most)
        rows = [(pdf.query_id.iloc[0], n, s.source, s.start, s.end, s.tokens, len(s.parts)) for n, s in enumerate(out, 1)]
        return pd.DataFrame(rows, columns=["query_id", "position", "source", "start", "end", "n_tokens", "n_united"])

    return c.groupBy("query_id").applyInPandas(run, _PACKED)


def pack_prefix(candidates: DataFrame, budget: int, k: int = 64) -> DataFrame:
    """Budget walk without overlap rule, as an ordered fold in the JVM: rows in rank order are kept if they still fit (skip and go on)."""
    c = head(candidates, k)
    items = c.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", (F.col("end") - F.col("start")).cast("bigint").alias("n"), "source", "start", "end"))).alias("x"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.slice("x", 1, 0).alias("kept"))
    fold = F.aggregate(
        "x", zero,
        lambda a, i: F.when(a["used"] + i["n"] <= budget, F.struct((a["used"] + i["n"]).alias("used"), F.concat(a["kept"], F.array(i)).alias("kept"))).otherwise(a),
        lambda a: a["kept"],
    )
    return items.select("query_id", F.explode(fold).alias("i")).select("query_id", "i.rank", "i.source", "i.start", "i.end", F.col("i.n").alias("n_tokens"))
