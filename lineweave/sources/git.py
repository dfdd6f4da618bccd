"""Changes and pinned trees of a local git repository. Git runs on the driver; a repository's listing is small beside its texts, which come in blocks."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.sources.workspace import ScanConfig, discover

#: Bytes of texts that are handed over at once.
BLOCK = 32 << 20
_TREE = "relative_path string, size_bytes bigint, oid string"


def git(root: str | Path, *args: str, data: bytes | None = None) -> bytes:
    """Output of a git command; an error raises ValueError with git's own words."""
    done = subprocess.run(["git", "-C", str(root), *args], input=data, capture_output=True, check=False)
    if done.returncode:
        raise ValueError(done.stderr.decode("utf-8", "replace").strip() or f"git {args[0]} failed")
    return done.stdout


def commit_of(root: str | Path, revision: str) -> str:
    """The commit that a revision names."""
    if not revision or revision.startswith("-"):
        raise ValueError(f"bad revision: {revision!r}")
    return git(root, "rev-parse", "--verify", "--end-of-options", f"{revision}^{{commit}}").decode().strip()


def range_commits(root: str | Path, text: str) -> tuple[str, str]:
    """Both ends of ``A..B``, or of ``A...B`` the one merge base and B. An empty end is HEAD."""
    merge = "..." in text
    left, found, right = text.partition("..." if merge else "..")
    if not found:
        raise ValueError("a range is A..B or A...B")
    a, b = commit_of(root, left or "HEAD"), commit_of(root, right or "HEAD")
    if not merge:
        return a, b
    bases = git(root, "merge-base", "--all", a, b).decode().split()
    if len(bases) != 1:
        raise ValueError("the commits have no single merge base")
    return bases[0], b


@dataclass(frozen=True)
class Change:
    """A unified diff and the tree of its new side; without a tree that is the working folder."""

    diff: str
    tree: str | None
    kind: str


def read_change(root: str | Path, staged: bool = False, ref_range: str = "", diff: str | None = None) -> Change:
    """The change in the working folder, in the index, between two commits, or given as a diff; only one of these may be asked for."""
    if sum((staged, bool(ref_range), diff is not None)) > 1:
        raise ValueError("staged, ref_range and diff exclude each other")
    if diff is not None:
        return Change(diff, None, "external")
    tree = None
    if ref_range:
        base, last = range_commits(root, ref_range)
        tree, kind = git(root, "rev-parse", f"{last}^{{tree}}").decode().strip(), "commit"
    elif staged:
        base, tree, kind = commit_of(root, "HEAD"), git(root, "write-tree").decode().strip(), "index"
    else:
        base, kind = git(root, "write-tree").decode().strip(), "worktree"
    args = ["diff", "--no-color", "--no-ext-diff", "--no-textconv", "--src-prefix=a/", "--dst-prefix=b/", "--find-renames", "-U0", base, *([tree] if tree else [])]
    return Change(git(root, *args, "--", ".").decode("utf-8", "replace"), tree, kind)


def tree_files(spark: SparkSession, root: str | Path, tree: str, patterns: list[str] | None = None, config: ScanConfig = ScanConfig()) -> DataFrame:
    """``relative_path, size_bytes, ext, text`` of a pinned tree's regular files under the rules of a scan; links and submodules are never followed.

    Listing and rules see paths and sizes only; texts are read for what is left, in blocks. What isn't UTF-8 or holds NUL is left out.
    """
    rows = []
    for entry in git(root, "ls-tree", "-r", "-z", "-l", "--full-tree", tree).split(b"\0"):
        if entry:
            meta, path = entry.split(b"\t", 1)
            mode, kind, oid, size = meta.split()
            if kind == b"blob" and mode in (b"100644", b"100755"):
                rows.append((path.decode("utf-8", "replace"), int(size), oid.decode()))
    wanted = discover(spark.createDataFrame(rows, _TREE), patterns, config).orderBy("relative_path").collect()  # a repository's paths
    schema = "relative_path string, size_bytes bigint, ext string, text string"
    parts = [spark.createDataFrame(b, schema) for b in _blocks(root, wanted)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _blocks(root: str | Path, wanted: list) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in wanted:
        raw = git(root, "cat-file", "blob", r.oid)
        try:
            text = raw.decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            continue
        if "\0" in text:
            continue
        block.append((r.relative_path, r.size_bytes, r.ext, text))
        size += len(raw)
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def with_fingerprint(files: DataFrame) -> DataFrame:
    return files.withColumn("fingerprint", F.sha2("text", 256))
