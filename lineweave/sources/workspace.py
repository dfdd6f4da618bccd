"""Files of a workspace as a table: listing by glob patterns, exclusion rules, decoding."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.functions import text as T

# Endings of the files that are read.
EXTENSIONS = (
    ".csv", ".json", ".jsonl", ".md", ".mdx", ".rst", ".toml", ".txt", ".yaml", ".yml", ".ini", ".cfg", ".env", ".proto", ".graphql", ".sql", ".py", ".pyi", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts",
    ".vue", ".svelte", ".html", ".css", ".scss", ".sass", ".go", ".rs", ".java", ".kt", ".kts", ".rb", ".php", ".swift", ".scala", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".m", ".mm", ".lua", ".ex", ".exs", ".sh", ".bash",
    ".zsh", ".ps1", ".r", ".jl", ".dart", ".hs", ".clj", ".pl",
)
# What is never read.
EXCLUDES = (".git/**", ".hg/**", ".svn/**", ".mypy_cache/**", ".pytest_cache/**", ".ruff_cache/**", ".venv/**", "venv/**", "node_modules/**", "dist/**", "build/**", "__pycache__/**")


@dataclass(frozen=True)
class ScanConfig:
    max_bytes: int = 200_000
    hidden: bool = False
    git_ignore: bool = True
    extra_excludes: tuple[str, ...] = ()


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ``**`` spans any number of path segments, other segments match within theirs."""
    if not pattern or pattern.startswith("/") or re.match(r"^[A-Za-z]:", pattern) or ".." in pattern.replace("\\", "/").split("/"):
        raise ValueError(f"pattern must be relative and inside the workspace: {pattern!r}")
    parts = [p for p in pattern.replace("\\", "/").split("/") if p not in ("", ".")]
    out = ""
    for n, p in enumerate(parts):
        last = n == len(parts) - 1
        if p == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            seg = ""
            for c in re.split(r"(\*|\?|\[[^\]]*\])", p):
                seg += "[^/]*" if c == "*" else "[^/]" if c == "?" else c.replace("[!", "[^") if c.startswith("[") and c.endswith("]") else re.escape(c)
            out += seg + ("" if last else "/")
    return "^" + out + "$" if parts else "^.*$"


def included(path: Column, patterns: list[str]) -> Column:
    """Does the path match one of the patterns (files, folders or globs)?"""
    rules = []
    for p in patterns or ["."]:
        r = glob_regex(p)
        rules.append(r)
        if not re.search(r"[*?\[]", p):
            rules.append(r[:-1] + "/.*$")
    return path.rlike("|".join(f"(?:{r})" for r in dict.fromkeys(rules)))


def excluded(path: Column, config: ScanConfig = ScanConfig()) -> Column:
    """Hidden components (unless allowed) and the excluded globs, which match the whole path as file-name patterns do."""
    rules = [fnmatch.translate(p) for p in (*EXCLUDES, *config.extra_excludes)]
    java = [r.replace("(?s:", "(?s:").replace("\\z", "$").replace("\\Z", "$") for r in rules]
    out = path.rlike("|".join(f"^{r}" for r in java))
    return out | path.rlike(r"(^|/)\.") if not config.hidden else out


def discover(files: DataFrame, patterns: list[str] | None = None, config: ScanConfig = ScanConfig()) -> DataFrame:
    """The rows of ``files`` (relative_path, size_bytes, ...) that a scan reads, once per path, by one conjunction of filters.

    The filters use path and size only, so a scan of a listing never reads texts. Of rows with one path the newest (``ingested_at``, if there) stays.
    """
    path = F.col("relative_path")
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    x = files.filter(ext.isin(*EXTENSIONS) & included(path, patterns or ["."]) & ~excluded(path, config) & (F.coalesce("size_bytes", F.lit(0)) <= config.max_bytes))
    x = x.withColumn("ext", ext)
    if "ingested_at" not in x.columns:
        return x
    # the newest delivery of a path, by a partial maximum on its time and content; equal rows stay one
    rest = [c for c in x.columns if c not in ("relative_path", "ingested_at")]
    newest = F.max_by(F.struct(*rest), F.struct(F.col("ingested_at"), F.xxhash64(*rest))).alias("x")
    return x.groupBy("relative_path").agg(F.max("ingested_at").alias("ingested_at"), newest).select("relative_path", "ingested_at", "x.*")


def decode(content: Column) -> Column:
    """Text of bytes: UTF-8 with optional mark, line ends normalised; null for what can't be decoded or holds NUL."""
    t = F.try_validate_utf8(content.cast("string"))
    t = F.when(~F.contains(t, F.lit("\0")), F.regexp_replace(t, "^﻿", ""))
    return T.normalize_newlines(t)


def read_workspace(spark: SparkSession, root: str, patterns: list[str] | None = None, config: ScanConfig = ScanConfig()) -> DataFrame:
    """``relative_path, size_bytes, ext, text, fingerprint`` of a folder's files. Undecodable files are dropped; path and size are filtered before reading."""
    base = os.path.abspath(root)
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    x = x.filter(F.col("length") <= config.max_bytes)
    rel = F.substring(F.url_decode(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), r"\+", "%2B")), len(base) + 2, 100_000)
    x = discover(x.withColumn("relative_path", rel).withColumnRenamed("length", "size_bytes"), patterns, config)
    if config.git_ignore and os.path.isdir(os.path.join(base, ".git")):
        ignored = subprocess.run(["git", "-C", base, "ls-files", "-oi", "--exclude-standard", "-z"], capture_output=True, text=True, check=False).stdout.split("\0")
        gone = [p for p in ignored if p]
        if gone:
            x = x.join(spark.createDataFrame([(p,) for p in gone], "relative_path string"), "relative_path", "left_anti")
    x = x.select("relative_path", "size_bytes", "ext", decode(F.col("content")).alias("text")).filter("text is not null")
    return x.withColumn("fingerprint", F.sha2("text", 256))


def split_missing(requested: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested paths that exist, and those that don't."""
    have = files.select("relative_path").distinct()
    return requested.join(have, "relative_path", "left_semi"), requested.join(have, "relative_path", "left_anti")


def parse_locators(df: DataFrame, column: str) -> DataFrame:
    """``path:first-last`` as columns ``path, low, high``; without a range both are null."""
    c = F.col(column)
    m = r"^(.+?):(\d+)(?:-(\d+))?$"
    low = F.try_to_number(F.regexp_extract(c, m, 2), F.lit("999999999")).cast("int")
    high = F.try_to_number(F.regexp_extract(c, m, 3), F.lit("999999999")).cast("int")
    return df.withColumn("path", F.when(c.rlike(m), F.regexp_extract(c, m, 1)).otherwise(c)).withColumn("low", low).withColumn("high", F.coalesce(high, low))


def suggest(missing: DataFrame, files: DataFrame, top: int = 3) -> DataFrame:
    """For each missing path the files with the same base name that share most folders."""
    from pyspark.sql.window import Window

    base = lambda c: F.element_at(F.split(c, "/"), -1)
    m = missing.select(F.col("relative_path").alias("missing"), base(F.col("relative_path")).alias("b"))
    f = files.select(F.col("relative_path").alias("candidate"), base(F.col("relative_path")).alias("b")).distinct()
    x = m.join(f, "b").withColumn("shared", F.size(F.array_intersect(F.split("missing", "/"), F.split("candidate", "/"))))
    w = Window.partitionBy("missing").orderBy(F.col("shared").desc(), "candidate")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("missing", "candidate", "shared", "rank")
