"""Splitting oversized texts by packing their structure tree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineweave.sources.tables import table

#: Tokens are maximal runs of characters other than space, tab, line feed and carriage return.
TOKEN = "[^ \\t\\n\\r]+"
_TOKEN = re.compile(TOKEN)
_HEADING = re.compile(r"(#{1,6})\s+\S|<h([1-6])[\s>]", re.I)
_UNDERLINE = re.compile(r"(=+|-+)\s*$")
_BLOCK_TAG = re.compile(r"</?(?:p|div|li|ul|ol|table|tr|section|article|pre|blockquote|body|head|html)\b", re.I)
_ITEM = re.compile(r"\s*(?:[-*+]|\d{1,9}[.)])\s+\S")
_FENCE = re.compile(r"\s*(```|~~~)")
_SENTENCE = re.compile(r"(?<=[.!?;])[\"')\]]*[ \t]+")
_SMALLER = re.compile(r"(?<=[;,{}()|])(?=\S)|(?<=[,:])[ \t]+")

#: Tree levels: 0 document, 1-6 sections, 7 block, 8 and more lines by indentation, then sentences, clauses and tokens.
_BLOCK, _LINE = 7, 8


def _levels(text: str) -> list[tuple[int, int]]:
    """(offset, level) of each physical line: the level at which a new node starts there."""
    out, at, fenced, blank = [], 0, False, True
    lines = re.findall("[^\n]*\n|[^\n]+", text)
    for i, line in enumerate(lines):
        body = line.rstrip("\r\n")
        heading = None if fenced else _HEADING.match(body)
        if _FENCE.match(body):
            fenced = not fenced
        indent = len(body.expandtabs(4)) - len(body.expandtabs(4).lstrip())
        if heading:
            level = len(heading[1]) if heading[1] else int(heading[2])
        elif not fenced and i + 1 < len(lines) and body.strip() and len(u := lines[i + 1].rstrip("\r\n")) >= 3 and _UNDERLINE.match(u):
            level = 1 if u[0] == "=" else 2
        elif not body.strip():
            level = 10**6  # blank lines stay with what comes before them
        elif blank or _BLOCK_TAG.match(body.lstrip()):
            level = _BLOCK + min(indent, 200) * 2
        else:
            level = _LINE + min(indent, 200) * 2 + (0 if _ITEM.match(body) else 1)
        blank = not body.strip()
        out.append((at, level))
        at += len(line)
    return out


class _Tree:
    """The structure of one text as nested spans of tokens; spans are (first token, end token)."""

    def __init__(self, text: str, limit: int):
        self.text, self.limit = text, limit
        self.tokens = [m.span() for m in _TOKEN.finditer(text)]
        first = {}
        t = 0
        for at, level in _levels(text):
            while t < len(self.tokens) and self.tokens[t][0] < at:
                t += 1
            if level < 10**6 and t < len(self.tokens):
                first.setdefault(t, level)
        self.starts = sorted(first.items())

    def pieces(self) -> list[tuple[int, int]]:
        return self._pack()

    def _merge(self, parts: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """Pieces of siblings in order. Neighbours that are whole (one piece each) are joined while they fit, and a node's own first line with whatever
        follows it; the pieces of an oversized sibling are joined with nothing else, so that a cut never lies beside a boundary it could have used."""
        out: list[tuple[int, int]] = []
        open_, head = False, False
        for n, pieces in enumerate(parts):
            whole = len(pieces) == 1
            for k, (a, b) in enumerate(pieces):
                if out and k == 0 and open_ and (whole or head) and b - out[-1][0] <= self.limit:
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
            if pieces:
                open_, head = whole, n == 0
        return out

    def _pack(self) -> list[tuple[int, int]]:
        """Pieces of the root. A node that fits is one piece; else its children's pieces are merged. Works off a stack, as nesting may be deep."""
        todo, done = [(0, len(self.starts), 0, len(self.tokens))], []
        while todo:
            i, j, a, b = todo.pop()
            if i < 0:  # all -i children are done
                parts = [done.pop() for _ in range(-i)]
                done.append(self._merge(parts[::-1]))
                continue
            if b - a <= self.limit:
                done.append([(a, b)] if b > a else [])
                continue
            while i < j and self.starts[i][0] <= a:
                i += 1
            if i == j:
                done.append(self._line(a, b))
                continue
            top = min(level for _, level in self.starts[i:j])
            cuts = [(i, a), *((k, self.starts[k][0]) for k in range(i, j) if self.starts[k][1] == top), (j, b)]
            todo.append((1 - len(cuts), 0, 0, 0))
            todo += [(k, m, x, y) for (k, x), (m, y) in zip(cuts, cuts[1:])][::-1]
        return done[0]

    def _line(self, a: int, b: int) -> list[tuple[int, int]]:
        """Pieces of an oversized line: by sentences, then clauses, then tokens."""
        for boundary in (_SENTENCE, _SMALLER):
            lo, hi = self.tokens[a][0], self.tokens[b - 1][1]
            ends = {m.end() for m in boundary.finditer(self.text, lo, hi)}
            cuts = [a, *(t for t in range(a + 1, b) if self.tokens[t][0] in ends), b]
            if len(cuts) > 2:
                return self._merge([[], *([(x, y)] if y - x <= self.limit else self._line(x, y) for x, y in zip(cuts, cuts[1:]))])
        return [(x, min(x + self.limit, b)) for x in range(a, b, self.limit)]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Cut ``text`` into pieces of at most ``limit`` tokens: (char start, char end, tokens, tokens shared with the piece before).

    A text within the limit is one piece. Otherwise each piece after the first begins with the last ``overlap`` tokens of what precedes it. Without
    these, the pieces are a partition of the text: white space after a piece belongs to it, white space before the first token to the first piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    if len(tokens) <= limit:
        return [(0, len(text), len(tokens), 0)]
    own = _Tree(text, limit - overlap).pieces()
    out = []
    for a, b in own:
        shared = min(overlap, a)
        start = tokens[a - shared][0] if a else 0
        out.append((start, tokens[b][0] if b < len(tokens) else len(text), b - a + shared, shared))
    return out


_PIECES = "origin string, row_id bigint, piece_no int, line_start int, line_end int, token_count int, shared_tokens int, text string"


def _cut(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for origin, row_id, first, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                line, at = first if first is not None else 1, 0
                for no, (a, b, tokens, shared) in enumerate(split_text(text, limit, overlap), 1):
                    line += text.count("\n", at, a) if a >= at else -text.count("\n", a, at)
                    at = a
                    piece = text[a:b]
                    rows.append((origin, row_id, no, line, line + piece.rstrip("\n").count("\n"), tokens, shared, piece))
                if len(rows) >= 2000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    names = [x.split()[0] for x in _PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def token_count(text):
    """Tokens of a text column, counted in the JVM."""
    return F.regexp_count(text, F.lit(TOKEN))


def split_oversized(rows: DataFrame, limit: int = 256, overlap: int = 32) -> DataFrame:
    """Pieces of every row of ``rows`` (origin, row_id, line_start, text) whose text holds more than ``limit`` tokens.

    The text's headings, blocks, list items and indented lines form a tree; sibling subtrees are merged bottom-up to the limit, and only oversized
    nodes are entered, down to sentences, clauses and at last single tokens. A token is never cut, so a piece is over no limit. Pieces are numbered
    from 1 and carry their line range, counted from ``line_start`` (from 1 where that is null) and the tokens they share with the piece before.

    Only oversized rows leave the JVM; there is no shuffle. Null, empty and small texts give no row; repeated rows give their pieces each; a null
    identifier is kept; other columns are ignored.
    """
    big = rows.select("origin", F.col("row_id").cast("bigint"), F.col("line_start").cast("int"), "text")
    big = big.filter(F.length("text") > 2 * limit).filter(token_count(F.col("text")) > limit)
    return big.mapInArrow(_cut(limit, overlap), _PIECES)


def oversized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "raw_spans").select(F.lit("raw_spans").alias("origin"), F.col("span_id").alias("row_id"), "line_start", "text")
    b = table(spark, sf_dir, "symbols").select(F.lit("symbols").alias("origin"), F.col("symbol_id").alias("row_id"), "line_start", "text")
    return a.unionByName(b)


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(oversized_rows(spark, sf_dir), 256, 32)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the operator cuts: each has exactly one second piece."""
    return p6_pieces(spark, sf_dir).filter(F.col("piece_no") == 2).select("origin", "row_id")


def p6_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each cut row must satisfy: without the tokens shared with the piece before they are the row's tokens in order, none is over the
    limit, and every later piece shares the asked overlap."""
    p = p6_pieces(spark, sf_dir)
    own = F.slice(F.regexp_extract_all("text", F.lit(f"({TOKEN})"), 1), F.col("shared_tokens") + 1, F.col("token_count"))
    before = F.sum(F.col("token_count") - F.col("shared_tokens")).over(Window.partitionBy("origin", "row_id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("own", own).withColumn("fits", (F.col("token_count") <= 256) & (F.col("shared_tokens") == F.least(F.lit(32), F.coalesce(before, F.lit(0)))) & (F.size("own") == F.col("token_count") - F.col("shared_tokens")))
    rows = p.groupBy("origin", "row_id").agg(F.bool_and("fits").alias("fits"), F.array_sort(F.collect_list(F.struct("piece_no", "own"))).alias("x"))
    tokens = F.flatten(F.transform("x", lambda y: y.own))
    return rows.select("origin", "row_id", F.size(tokens).cast("bigint").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("digest"), "fits")


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces, "p6_partition": p6_partition}
_BIG = r"""from (
  select 'raw_spans' as origin, span_id as row_id, regexp_extract_all(text, '[^ \t\n\r]+') as w from raw_spans
  union all select 'symbols', symbol_id, regexp_extract_all(text, '[^ \t\n\r]+') from symbols)
where len(w) > 256"""
SQL = {
    "p6_found": f"select origin, row_id {_BIG}",
    "p6_partition": f"select origin, row_id, len(w)::bigint as n_tokens, md5(array_to_string(w, ' ')) as digest, true as fits {_BIG}",
}
