"""Definitions and imports in source files."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.functions import text as T
from lineweave.functions.keywords import Keywords
from lineweave.operators import score
from lineweave.plans.durable import durable

_SCHEMA = "source string, ordinal int, name string, kind string, line_start int, line_end int, defines array<string>, refs array<string>, is_import boolean"
_ROW = tuple[str, str, int, int, list[str], list[str], bool]


def python_symbols(text: str) -> list[_ROW]:
    """Functions and classes at any depth, module-level assignments and imports. A file that doesn't parse has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[_ROW] = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            params = set()
            if not isinstance(node, ast.ClassDef):
                a = node.args
                params = {p.arg for p in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))}
            defines = {node.name, *params}
            refs = {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)} | {n.attr for n in ast.walk(node) if isinstance(n, ast.Attribute)}
            out.append((node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, node.end_lineno or node.lineno, sorted(defines), sorted(refs - defines), False))
    for node in tree.body:
        if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            names = sorted({t.id for t in targets if isinstance(t, ast.Name)})
            refs = {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)} - set(names)
            out.append((names[0] if names else "<assignment>", "variable", node.lineno, node.end_lineno or node.lineno, names, sorted(refs), False))
    for node in ast.walk(tree):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            local = sorted({(a.asname or a.name).split(".")[0] for a in node.names})
            out.append((local[0], "import", node.lineno, node.end_lineno or node.lineno, local, sorted({a.name for a in node.names}), True))
    return out


_BRACED = {
    "rs": [(r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)", "function"), (r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "struct"), (r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", "enum"),
           (r"(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)", "trait"), (r"impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)", "impl"), (r"(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(\w+)\s*:", "const"), (r"(?:pub\s+)?mod\s+(\w+)", "mod")],
    "js": [(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "function"), (r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "class"), (r"(?:export\s+)?interface\s+(\w+)", "interface"),
           (r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", "function"), (r"(?:export\s+)?(?:const|let|var)\s+(\w+)", "variable")],
    "go": [(r"func\s+(?:\([^)]*\)\s*)?(\w+)", "function"), (r"type\s+(\w+)\s+struct", "struct"), (r"(?:const|var)\s+(\w+)", "variable")],
    "java": [(r"(?:(?:public|private|protected|static|final|abstract)\s+)*class\s+(\w+)", "class"), (r"(?:(?:public|private|protected|static|final)\s+)+[\w<>\[\]]+\s+(\w+)\s*\(", "method")],
}
_LANGUAGE = {".py": "py", ".pyi": "py", ".rs": "rs", ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".ts": "js", ".tsx": "js", ".mts": "js", ".cts": "js", ".go": "go", ".java": "java"}
_NAME = re.compile(r"[A-Za-z_]\w*")


def braced_symbols(text: str, language: str) -> list[_ROW]:
    """Definitions of a language with braces, by the forms of their first lines; a definition ends where its braces close. Approximate."""
    lines = text.split("\n")
    forms = [(re.compile(r"^\s*" + p), k) for p, k in _BRACED[language]]
    out: list[_ROW] = []
    depth: list[int] = []
    level = 0
    for x in lines:
        bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)'|//.*", "", x)
        depth.append(level)
        level += bare.count("{") - bare.count("}")
    depth.append(level)
    for i, x in enumerate(lines):
        for form, kind in forms:
            if (m := form.match(x)) and (kind != "variable" or depth[i] == 0):
                end = i
                if "{" in x or (i + 1 < len(lines) and "{" in lines[i + 1] and ";" not in x):
                    end = next((j for j in range(i, len(lines)) if depth[j + 1] <= depth[i] and (j > i or "}" in x)), len(lines) - 1)
                body = set(_NAME.findall("\n".join(lines[i : end + 1])))
                out.append((m[1], kind, i + 1, end + 1, [m[1]], sorted(body - {m[1]}), False))
                break
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("source", pa.string()), ("ordinal", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("defines", pa.list_(pa.string())), ("refs", pa.list_(pa.string())), ("is_import", pa.bool_())])
    for batch in batches:
        out = []
        for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            language = _LANGUAGE.get("." + source.rsplit(".", 1)[-1].lower()) if source else None
            found = python_symbols(text) if language == "py" else braced_symbols(text, language) if language and text else []
            out += ((source, n, *x) for n, x in enumerate(found))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def parse_symbols(files: DataFrame) -> DataFrame:
    """Definitions and imports of every file (source, text); files of other languages have none. Python is exact, other languages approximate."""
    return files.filter("text is not null").select("source", "text").mapInArrow(_parse, _SCHEMA)


def symbol_candidates(symbols: DataFrame, queries: DataFrame, max_tokens: int | None = 160) -> DataFrame:
    """Definitions that share terms with a query by their names and references, or by their text: coverage of each and the name match.

    ``symbols`` has ``source, name, kind, start, end, defines, refs, text``; definitions of more than ``max_tokens`` white-space tokens are left out, none
    where it is None.
    """
    q = queries.select("query_id", T.keywords(F.col("query_text")).alias("qt"), F.regexp_extract_all("query_text", F.lit("([A-Za-z0-9_]+)"), 1).alias("qw")).filter(F.size("qt") > 0)
    s = symbols.filter(F.col("end") > F.col("start"))
    if max_tokens is not None:
        s = s.filter(T.token_count(F.coalesce("text", F.lit(""))) <= max_tokens)
    names = T.identifier_terms(F.filter(F.concat(F.coalesce("defines", F.array().cast("array<string>")), F.coalesce("refs", F.array().cast("array<string>"))), lambda x: x.isNotNull()))
    s = s.select("symbol_id", "source", "name", "kind", "start", "end", names.alias("st"), T.keywords(F.coalesce("text", F.lit(""))).alias("lt"))
    t = s.select("symbol_id", F.explode(F.array_distinct(F.concat("st", "lt"))).alias("term"), F.col("st"), F.col("lt"))
    t = t.select("symbol_id", "term", F.array_contains("st", F.col("term")).cast("int").alias("in_names"), F.array_contains("lt", F.col("term")).cast("int").alias("in_text"))
    asked = q.select("query_id", F.size("qt").alias("n"), F.explode("qt").alias("term"))
    x = t.join(asked, "term").groupBy("query_id", "symbol_id", "n").agg(F.sum("in_names").alias("names"), F.sum("in_text").alias("texts"))
    x = x.join(s.select("symbol_id", "source", "name", "kind", "start", "end"), "symbol_id").join(q.select("query_id", "qw"), "query_id")
    match = (F.col("kind") != "import") & F.array_contains("qw", F.col("name")) & ~T.casefold(F.col("name")).isin(*T.STOPWORDS)
    return x.select("query_id", "symbol_id", "source", "name", "start", "end", (F.col("names") / F.col("n")).alias("symbol_coverage"), (F.col("texts") / F.col("n")).alias("lexical_coverage"), match.cast("double").alias("symbol_name_match"))


def top_candidates(symbols: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of ``symbol_candidates`` without a bound of tokens, those whose name the query holds first, then by the sum of both coverages, then by
    symbol_id: ``query_id, rank, symbol_id, name, score, symbol_name_match``. Scored where the symbols lie; only the best of each task are shuffled."""
    keywords = T.keywords(F.col("query_text"))
    words = F.array_distinct(F.regexp_extract_all("query_text", F.lit("([A-Za-z0-9_]+)"), 1))
    q = queries.filter(F.size(keywords) > 0).select("query_id", F.concat(keywords, F.transform(words, lambda w: F.concat(F.lit(_CASE), w))).alias("terms"))
    s = symbols.filter(F.col("end") > F.col("start"))
    none = F.array().cast("array<string>")
    names = T.identifier_terms(F.filter(F.concat(F.coalesce("defines", none), F.coalesce("refs", none)), lambda x: x.isNotNull()))
    known = (F.col("kind") != "import") & ~T.casefold(F.col("name")).isin(*T.STOPWORDS)
    x = score.numbered(s.select("symbol_id", "name", "kind", "defines", "refs", "text"), ["symbol_id"])
    x = x.select("symbol_id", "name", "span_no", names.alias("names"), F.when(known, F.concat(F.lit(_CASE), F.col("name"))).alias("case"), F.coalesce("text", F.lit("")).alias("text"))
    index = durable(x.mapInArrow(_with_terms, "symbol_id bigint, name string, span_no bigint, names array<string>, case array<string>, terms array<string>"), "symbol-terms")
    found = [score.top(index, _Candidates(b), k) for b in score.question_blocks(q, F.col("terms"))]
    if not found:
        return s.select(F.lit(0).cast("bigint").alias("query_id"), F.lit(0).alias("rank"), "symbol_id", "name", F.lit(0.0).alias("score"), F.lit(0.0).alias("symbol_name_match")).limit(0)
    match = F.col("points") > _MATCH * score.PLACES
    points = F.col("points") - F.when(match, F.lit(int(_MATCH * score.PLACES))).otherwise(F.lit(0))
    x = reduce(DataFrame.unionByName, found).join(index.select("span_no", "symbol_id", "name"), "span_no")
    return x.select("query_id", "rank", "symbol_id", "name", (points / score.PLACES).alias("score"), match.cast("double").alias("symbol_name_match"))


# Mark of a name as it is written; what a name match adds, above any sum of coverages.
_CASE, _MATCH = "c:", 4.0


def _with_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Keywords()
    for b in batches:
        case = pa.array([None if x is None else [x] for x in b.column(4).to_pylist()], pa.list_(pa.string()))
        terms = pa.array([words.of(t) for t in b.column(5).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*b.columns[:4], case, terms], names=["symbol_id", "name", "span_no", "names", "case", "terms"])


class _Candidates:
    """Share of a question's keywords in a symbol's names and in its text, and ``_MATCH`` more where the question holds its name."""

    columns = ("span_no", "names", "terms", "case")

    def __init__(self, q: score.Questions):
        self.q = q
        self.words = np.zeros(len(q.ids))
        np.add.at(self.words, q.of, np.repeat([0.0 if t.startswith(_CASE) else 1.0 for t in q.terms], np.diff(q.start)))

    def channels(self, b: pa.RecordBatch) -> list[score.Postings]:
        asked = pa.array(self.q.terms, pa.string())
        a, b_, c = (score._postings(b.column(x), asked) for x in ("names", "terms", "case"))
        both = [np.concatenate([x, y]) for x, y in zip(a, b_)]
        return [score.Postings(*both, None, b.num_rows, len(asked)), score.Postings(*c, None, b.num_rows, len(asked))]

    def scores(self, b: pa.RecordBatch) -> Callable[[int, list[np.ndarray]], np.ndarray]:
        def of(i: int, sums: list[np.ndarray]) -> np.ndarray:
            x = sums[0] * (1 / self.words[i])
            if len(at := np.flatnonzero(sums[1])):
                at = at[x[at] > 0]
                x[at] += _MATCH
            return x

        return of
