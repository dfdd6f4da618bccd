"""Source files that nobody wrote by hand for their repository: generated, minified, vendored, or data saved as code."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.words import WordHashes, ngrams
from lineweave.plans.durable import durable
from lineweave.plans.skew import hot_split_join
from lineweave.sources.tables import table

#: Tokens in a shingle and the similarity from which two files are near copies.
SHINGLE, SIMILAR = 5, 0.8
#: (bands, rows a band) of the masked shingles' minima: files of similarity 0.8 meet in at least one band with probability 0.9993.
_MASKED = (24, 6)
#: 2-bit minima in the sketches of a file's shingles and of its names, and the estimated similarities below which two files are not compared exactly.
#: The estimates' deviations are 0.030 at a similarity of 0.8 and 0.057 at 0.5, however few shingles a file has.
_SKETCH, _MAYBE, _NAME_SKETCH, _MAYBE_NAMES = 256, 0.7, 128, 0.3
#: Pairs of a bucket that are looked at in one go.
_AT_ONCE = 1 << 20
#: Files with fewer tokens are not clustered; identifiers two vendored copies must share; members that make a family within a repository.
_LEAST, _NAMES, _FAMILY = 40, 0.5, 3

# File kinds. Configuration and prose are written by hand unless something else says otherwise.
CONFIG = ("yaml", "yml", "toml", "ini", "env", "cfg", "conf", "properties", "sh", "bash", "json", "xml", "sql")
PROSE = ("md", "rst", "txt", "adoc", "org", "tex")
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|[^\s\w]|\n")
# Words of programming languages, kept when identifiers are masked.
KEYWORDS = frozenset(
    "abstract and as assert async await bool boolean break byte case catch char class const continue crate def default defer del do double elif else enum except export extends false final finally float fn for from func function go if impl implements import in instanceof int interface is lambda let long loop match mod mut new nil none not null or package pass private protected pub public raise range ref return self short static str string struct super switch this throw throws trait true try type typeof undefined union unsafe use var void when where while with yield".split()
)
_LEAD = r"^[ \t]*(?:#+|//+|/\*+!?|\*+|--+|<!--|;+|%+|\"\"\"|'''|REM\b)[ \t]*"
# How comments say that a tool made the file, at the comment's start.
_GENERATED = re.compile(
    _LEAD
    + r"(?:</?auto-?generated\b|@generated\b|(?:code|source|this (?:file|code|module|source)|file)[ \t]+(?:was |is |has been )?(?:auto(?:matically)?[- ]?)?(?:generated|created|produced|emitted|written) (?:by|from|with|using|automatically)|this (?:file )?(?:was|is) (?:auto|machine|an? (?:auto[- ]?)?generated)|auto[- ]?generated\b|machine[- ]generated\b"
    r"|generated (?:at|by|from|on|with|using|code|file|automatically)\b|(?:produced|compiled|created|built|emitted|output) (?:from|with|by|using|of) [\w./-]+|do not (?:edit|modify|change)\b|\[[\w-]+\] output\b|[\w-]+ wrote this on \d|warning: this file (?:is|was) gen"
    r"|diese datei (?:wird|wurde|ist)\b.*(?:erzeugt|generiert)|(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)|fichier (?:produit|g[ée]n[ée]r[ée]|cr[ée][ée])\b|(?:archivo|fichero|c[óo]digo) (?:generado|creado|producido)\b|(?:arquivo|c[óo]digo) gerado\b|file generato\b)",
    re.I | re.M,
)
# How comments say that a file came from elsewhere.
_VENDORED = re.compile(
    _LEAD
    + r"(?:snapshot of \S+ as of|imported (?:from|verbatim)\b|(?:taken|copied|borrowed|lifted|vendored)\b[^\n]{0,40}?\b(?:from|out of|in)\b|bundled (?:copy|version|with)\b|vendored\b|upstream[ \t]*:|@license\b|@preserve\b|keep in sync with upstream|redistribution (?:permitted|and use)|see the licen[sc]e of the original|[\w.-]+ v?\d+(?:\.\d+)+ \| |third[- ]party (?:code|file|copy))",
    re.I | re.M,
)
# What authors say of files that only look like copies or products.
_BY_HAND = re.compile(_LEAD + r"[^\n]*\b(?:maintained by hand|written from scratch|hand[- ]written|edit freely|wrote (?:our|it) own|written by hand|von hand|[ée]crit [àa] la main|escrito a mano)\b", re.I | re.M)
# Folders that hold other people's code.
_VENDOR_DIR = re.compile(r"(?:^|/)(?:_?vendor(?:ed)?|third[_-]?party|3rd-?party|externals?|extern|deps|contrib|node_modules|bower_components|jspm_packages|site-packages|dist-packages|Pods|Carthage|Godeps)/[^/]+/", re.I)
# Folders that tools write into.
_TOOL_DIR = re.compile(r"(?:^|/)(?:gen|generated|__generated__|_generated|autogen|codegen_out|generated-src|generated_src)/", re.I)
# Names that tools give to files.
_TOOL_NAME = re.compile(
    r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h)|\.g(?:en)?\.(?:ts|js|cs|dart)|\.generated\.\w+|(?:^|/)zz_generated[._][^/]*|_generated\.\w+|\.designer\.cs|(?:^|/)\d{4}_auto_\d{8}_\d{3,6}\.py|(?:^|/)(?:package-lock|deps\.lock|[\w.-]*[.-]lock)\.json|(?:^|/)(?:yarn|poetry|cargo|gemfile|composer|pipfile)\.lock)$",
    re.I,
)
_SMALL_NAME = re.compile(r"(?:[.-](?:min|compressed|bundle|pack)\.(?:js|css|mjs)|(?:^|/)(?:bundle|all|vendor)\.(?:js|css)|(?:^|/)app\.[0-9a-f]{6,}\.(?:js|css)|-[0-9a-f]{8,}\.(?:js|css)|\.map)$", re.I)
#: Nobody types a source file of this size; only asked where the text is missing.
_TYPED = 200_000
#: A word of notes that fewer repositories use is taken for a name and masked.
_COMMON = 3
_EMACS = re.compile(r"-\*-.*buffer-read-only: t.*-\*-|\bmachine output of\b", re.I)


_COMMENT = re.compile(_LEAD + r"[^\n]*", re.M)


def telling_notes(text: str) -> tuple[list[tuple[str, str]], bool]:
    """The comment lines of a text that say something of their file, with what they say; and whether one says that it was written by hand."""
    lines = _COMMENT.findall(text)
    if not lines:
        return [], False
    notes = "\n".join(lines)
    if hand := bool(_BY_HAND.search(notes)):
        return [], True
    if "sourceMappingURL" not in text:
        if not (_GENERATED.search(notes) or _EMACS.search(notes) or _VENDORED.search(notes) or _HOLDER_FORM.search(notes)):
            return [], hand
    return [(x.strip(), kind) for x in dict.fromkeys(lines) if (kind := note_kind(x))], hand


_SLOT = re.compile(r"\S*\d\S*|\w+(?:[./_@-]\w+)+")


_MARKER = re.compile(_LEAD + r"|[ \t]*(?:\*+/|-->)[ \t]*$")


def note_words(note: str) -> list[str]:
    """Words and signs of a note without its comment marker; numbers are N, dotted, dashed and other joined names are I."""
    out: list[str] = []
    for x in _MARKER.sub("", note).split():
        bare = x.strip("()[]{}<>,;:.!?\"'")
        if "sourceMappingURL" in x:
            out.append("sourceMappingURL=I")
        elif bare and _SLOT.fullmatch(bare) and bare.lower() not in _JOINED_WORDS:
            out.append("N" if any(c.isdigit() for c in bare) else "I")
        else:
            out += re.findall(r"[^\W_]+(?:-[^\W_]+)*:?|[^\s\w]+", x)
    return out


# Joined words that are no names.
_JOINED_WORDS = frozenset("auto-generated machine-generated hand-written third-party buffer-read-only".split())


def note_kind(note: str) -> str | None:
    """What a note says of its file."""
    if "sourceMappingURL=" in note:
        return "minified: source map"
    if _GENERATED.search(note) or _EMACS.search(note):
        return "generated: note"
    if _VENDORED.search(note):
        return "vendored: note"
    return "holder" if _HOLDER_FORM.search(note) else None


_HOLDER_FORM = re.compile(_LEAD + r"(?:SPDX-FileCopyrightText:|copyright\b|\(? ?c ?\)|©|this file is part of)", re.I | re.M)


def path_marks(path: str, size: int | None, text: str | None) -> list[str]:
    """Parts of a path that can be shared with other repositories: folders, the name with its digits masked, the name's last two parts with and without the ending, and its first two."""
    *folders, name = path.split("/")
    zero = _NUMBER.sub(lambda m: "0" * len(m[0]), name)
    out = [f"{f}/I/" for f in folders[:-1]] + [f"{f}/I" for f in folders[-1:]] + [zero]
    if ending := re.search(r"[._-][A-Za-z0-9]+\.[A-Za-z0-9]+$", zero):
        out += ["I" + ending[0], "I" + ending[0].rsplit(".", 1)[0] + ".x"]
    if first := re.match(r"[A-Za-z0-9]+_[A-Za-z0-9]+[._]", zero):
        out.append(first[0] + "I")
    if not text:
        out = [x if x.endswith("/I/") else "?" + x for x in out]
        if size is not None and size >= _TYPED:
            out.append("!" + zero.rsplit(".", 1)[-1])
    return list(dict.fromkeys(out))


_NUMBER = re.compile(r"(?<![A-Za-z0-9])(?:\d+|(?=[a-f]*\d)[0-9a-f]{6,})(?![A-Za-z0-9])")


def mark_kind(mark: str) -> str | None:
    """What a part of a path says of its file. ``?`` marks names of files without text, ``!`` the kind of such a file of a size that nobody types."""
    if mark[0] == "!":
        return "data: size"
    bare = mark.lstrip("?")
    if bare.endswith("/I/") and _VENDOR_DIR.search(bare):
        return "vendored: path"
    if bare.endswith(("/I/", "/I")):
        return "generated: path" if _TOOL_DIR.search(bare + "/") else None
    if _TOOL_NAME.search(bare):
        return "generated: name"
    return "minified: name" if mark[0] == "?" and _SMALL_NAME.search(bare) else None


def dense(text: str, ext: str) -> bool:
    """Long lines of many signs and few spaces make up most of the text."""
    long = [x for x in text.split("\n") if len(x) > 300]
    if not long or ext not in ("js", "css", "mjs", "ts", "html", "svg", ""):
        return False
    found = [x for x in long if sum(map(x.count, " \t")) < 0.09 * len(x) and sum(map(x.count, ";{}(),=.:")) > 0.12 * len(x)]
    return sum(map(len, found)) > 0.5 * len(text)


def own_shape(path: str | None, size: int | None, text: str | None, repo: str | None) -> str | None:
    """What the parts of this file would say if other files shared them, or None. Not used to find files: there, a part counts only in a cluster."""
    path = path or ""
    said = [mark_kind(m) for m in path_marks(path, size, text)]
    ext = extension(path)
    if ext in PROSE:
        said = [k for k in said if k == "vendored: path"]
    elif text:
        said += [k if k != "holder" else None if says_own(x, repo, path) else "vendored: holder" for x, k in telling_notes(text)[0]]
        said.append("minified: density" if dense(text, ext) else None)
    return next((k for k in said if k), None)


def extension(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def says_own(note: str, repo: str | None, path: str) -> bool:
    """Does the note name the file's own repository?"""
    low = note.lower()
    own = {x.lower() for x in (repo or "", *path.split("/")[:2]) if x}
    return any(re.search(rf"(?<![a-z]){re.escape(o)}" + ("" if len(o) > 3 else "(?![a-z])"), low) for o in own)


def _kind(token: str) -> str:
    c = token[0]
    if c in "\"'`":
        return "S"
    if c.isdigit():
        return "N"
    if c.isalpha() or c in "_$":
        return token if token.lower() in KEYWORDS else "I"
    return token


class _Powers:
    """Powers of an odd number and of its inverse, as many as have been asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            base = 0x9E3779B97F4A7C15
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(2 * n, b, dtype=np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _segments(kinds: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of each non-empty run of kinds between breaks: differences of a running hash, shifted to the run's start."""
    at = np.flatnonzero(breaks)
    starts = np.concatenate(([0], at + 1))
    ends = np.concatenate((at, [len(kinds)]))
    some = ends > starts
    starts, ends = starts[some], ends[some]
    up, down = _POWERS.of(len(kinds) + 1)
    running = np.zeros(len(kinds) + 1, dtype=np.uint64)
    np.cumsum(kinds * up[:-1], dtype=np.uint64, out=running[1:])
    return starts, ends - starts, (running[ends] - running[starts]) * down[starts]


def repetition(text: str, literal: float, count: int, longest: int, config: bool, kinds: np.ndarray, breaks: np.ndarray) -> str | None:
    """Is the file mostly literals (their share and number, and the longest token), or are most of its lines (kinds between breaks) of one or two forms?"""
    if literal >= 0.65 and (len(text) >= 1000 or count >= 100) and not config:
        return "data: literals"
    if literal >= 0.6 and (count >= 150 or longest >= 1000) and config:
        return "data: literals"
    starts, _, forms = _segments(kinds, breaks)
    if len(forms) < 12:
        return None
    _, first, times = np.unique(forms, return_index=True, return_counts=True)
    top = np.argsort(-times, kind="stable")[:2]
    if config:
        k = starts[first[top[0]]]
        row = kinds[k : k + int(np.argmax(np.append(breaks[k:], True)))]
        return "data: rows" if times[top[0]] >= 0.7 * len(forms) and ((row == np.uint64(_S)) | (row == np.uint64(_N))).sum() >= 3 else None
    return "generated: repeated form" if times[top].sum() >= 0.75 * len(forms) else None


class _Tokens(dict):
    """Number of each token; arrays give the numbered tokens' kind hash, word hash and length. Forgotten when it has grown to a fixed size."""

    LIMIT = 1 << 20

    def __init__(self) -> None:
        super().__init__()
        self.kind, self.word, self.size = np.empty(self.LIMIT, dtype=np.uint64), np.empty(self.LIMIT, dtype=np.uint64), np.empty(self.LIMIT, dtype=np.int64)

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        if n < self.LIMIT:
            self.kind[n], self.word[n], self.size[n] = xxhash.xxh64_intdigest(_kind(token)), xxhash.xxh64_intdigest(token), len(token)
        return n

    def read(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if len(self) >= self.LIMIT:
            self.clear()
            if len(tokens) >= self.LIMIT:  # one text beyond the table: without it
                return (np.array([f(t) for t in tokens], dtype=d) for f, d in ((lambda t: xxhash.xxh64_intdigest(_kind(t)), np.uint64), (xxhash.xxh64_intdigest, np.uint64), (len, np.int64)))
            n = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        return self.kind[n], self.word[n], self.size[n]


_S, _N, _I = (xxhash.xxh64_intdigest(k) for k in "SNI")


_ROUND = np.random.RandomState(20_240_601)
_MUL, _ADD = (_ROUND.randint(0, 1 << 32, 512, dtype=np.uint32) for _ in range(2))
_MUL |= np.uint32(1)


def _minima(hashes: np.ndarray, n: int) -> np.ndarray:
    """MinHash by ``n`` hash functions, so that small sets are estimated as well as large ones; 0 for an empty set."""
    if not len(hashes):
        return np.zeros(n, dtype=np.uint64)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    out = []
    for i in range(0, len(short), 512):  # stays within a core's cache
        x = short[i : i + 512, None] * _MUL[:n]
        x += _ADD[:n]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out.append(x.min(axis=0))
    return np.min(out, axis=0).astype(np.uint64)


def _sketch(low: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, 32 minima a number."""
    bits = ((low >> np.uint64(7)) & np.uint64(3)).reshape(-1, 32)
    return (bits << _TWOS).sum(axis=1, dtype=np.uint64).view(np.int64)


_TWOS = np.arange(0, 64, 2, dtype=np.uint64)


def _shingles(hashes: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes in order."""
    x = ngrams(hashes, SHINGLE).view(np.uint64)
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def _grouped(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    return ngrams(low, rows)[::rows][:bands]


_OWN = "file_id bigint, repo bigint, path_key bigint, hand boolean, notes array<string>, marks array<string>, cls bigint, n bigint, keys array<bigint>, sketch array<bigint>, lit boolean, shape string, fcls bigint, fn bigint, fkeys array<bigint>, fsketch array<bigint>, alone boolean"
_LINE, _SHORT = (xxhash.xxh64_intdigest(k) for k in ("\n", "i"))
_STOPS = np.array([xxhash.xxh64_intdigest(k) for k in ";{}\n"], dtype=np.uint64)


def form_shingles(kinds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, bool]:
    """Distinct shingles of the statements' forms: character-level masks (a short name is one letter's form), shingles within a statement. And whether the
    two halves of the text are near copies of each other by them, counted as often as they occur."""
    kinds = np.where((kinds == np.uint64(_I)) & (sizes <= 2), np.uint64(_SHORT), kinds)
    stops = np.isin(kinds, _STOPS)
    starts, lengths, whole = _segments(kinds, stops)
    short = lengths < SHINGLE
    runs = ngrams(kinds, SHINGLE).view(np.uint64)
    before = np.concatenate(([0], np.cumsum(stops)))
    inside = np.flatnonzero(before[SHINGLE:] == before[: len(before) - SHINGLE]) if len(runs) else np.empty(0, dtype=np.int64)
    at = np.concatenate([starts[short], inside])
    hashes = np.concatenate([whole[short], runs[inside]])[np.argsort(at, kind="stable")]
    if not len(hashes):
        return np.empty(0, dtype=np.uint64), False
    every, of = np.unique(hashes, return_inverse=True)
    times = [np.bincount(x, minlength=len(every)) for x in (of[: len(of) // 2], of[len(of) // 2 :])]
    return every, bool(np.minimum(*times).sum() >= SIMILAR * np.maximum(*times).sum())


_NONE = np.empty(0, dtype=np.int64)


def _lists(arrays: Sequence[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit numbers as one list column."""
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def _class(shingles: np.ndarray, names: np.ndarray | None, view: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    bands, rows = _MASKED
    m = _minima(shingles, _SKETCH)
    more = _minima(names, _NAME_SKETCH) if names is not None else np.zeros(_NAME_SKETCH, dtype=np.uint64)
    key = view + shingles.tobytes() + (b"/" + names.tobytes() if names is not None else b"")
    return int(np.int64(xxhash.xxh64_intdigest(key) >> 1)), len(shingles), _grouped(m, bands, rows), np.concatenate([_sketch(m), _sketch(more)])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts by which each file can belong to a cluster: notes, marks of its path, masked shingles and names, and the forms of its statements."""
    known = _Tokens()
    longs = pa.list_(pa.int64())
    kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64(), longs, longs, pa.bool_(), pa.string(), pa.int64(), pa.int64(), longs, longs, pa.bool_())
    for batch in batches:
        out: list[tuple] = []
        for ident, repo, path, size, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            path = path or ""
            ext = extension(path)
            repo_key, path_key = xxhash.xxh64_intdigest(repo) >> 1, xxhash.xxh64_intdigest(path) >> 1
            hand, notes, lit, shape, alone = False, [], False, None, False
            body = form = (None, 0, _NONE, _NONE)
            if text and ext not in PROSE:
                told, hand = telling_notes(text)
                for x, kind in told:
                    if kind != "holder" or not says_own(x, repo, path):
                        notes.append(f"{'vendored: holder' if kind == 'holder' else kind}|{' '.join(note_words(x))}")
                tokens = _TOKEN.findall(text)
                if tokens:
                    config = ext in CONFIG
                    every, words_, sizes = known.read(tokens)
                    breaks = every == np.uint64(_LINE)
                    k, w, size_of = every[~breaks], words_[~breaks], sizes[~breaks]
                    if not len(k):
                        k, w, size_of = every[:0], words_[:0], np.ones(1, dtype=np.int64)
                    masked = _shingles(k) if len(k) >= SHINGLE else k[:0]
                    is_literal = (k == np.uint64(_S)) | (k == np.uint64(_N))
                    literal = float(size_of[: len(k)][is_literal].sum() / size_of.sum())
                    lit = literal >= 0.6 and not config
                    shape = repetition(text, literal, int(is_literal.sum()), int(size_of.max()), config, every, breaks)
                    if shape is None and dense(text, ext):
                        shape = "minified: density"
                    if shape:
                        shingles, alone = form_shingles(every, sizes)
                        form = _class(shingles, None, b"f")
                    if len(k) >= _LEAST and not config:
                        body = _class(masked, np.unique(w[k == np.uint64(_I)]), b"b")
            marks = path_marks(path, size, text)
            if ext in PROSE:
                marks = [m for m in marks if m.endswith("/I/")]
            marks = [f"{kind}|{m}" for m in marks if (kind := mark_kind(m)) and (ext not in PROSE or kind.startswith("vendored"))]
            out.append((ident, repo_key, path_key, hand, notes, marks, *body, lit, shape, *form, alone))
        if out:
            yield pa.RecordBatch.from_arrays([_lists(c) if t is longs else pa.array(c, t) for c, t in zip(zip(*out), kinds_)], names=[x.split()[0] for x in _OWN.split(", ")])


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches."""
    x = a ^ b
    x = (x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)
    same = 1 - np.bitwise_count(x).sum(axis=1) / (32 * a.shape[1])
    return (same - 0.25) / 0.75


_WORDS = _SKETCH // 32


def _bucket_pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """All pairs of classes within each whole bucket that can be near copies and of which one still needs a reason. Rows are sorted by key and size."""
    key, cls, n, repo, many, need, lit = cols[:7]
    sketch = np.stack([c.view(np.uint64) for c in cols[7:]], axis=1)
    bucket = np.cumsum(np.concatenate(([False], key[1:] != key[:-1]))).astype(np.int64) << 40
    at = np.arange(len(key))
    # similar sets have similar sizes, so a row's partners follow it closely; 1 more for hashes that fall together
    count = np.searchsorted(bucket | n, bucket | n * 5 // 4 + 1, side="right") - at - 1
    total = np.cumsum(count)
    lo = 0
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _AT_ONCE, side="right")))
        c = count[lo:hi]
        a = np.repeat(at[lo:hi], c)
        b = np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c) + a + 1
        lo = hi
        ok = need[a] | need[b]
        a, b = a[ok], b[ok]
        ok = _alike(sketch[a, :_WORDS], sketch[b, :_WORDS]) >= _MAYBE
        a, b = a[ok], b[ok]
        ok = (repo[a] == repo[b]) | many[a] | many[b] | lit[a] | lit[b]
        ok |= _alike(sketch[a, _WORDS:], sketch[b, _WORDS:]) >= _MAYBE_NAMES
        a, b = cls[a[ok]], cls[b[ok]]
        if len(a):
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each bucket. A bucket is held until its last row has come."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut or held and held[0][0][0] != cols[0][0]:
            whole = [*held, [c[:cut] for c in cols]]
            yield from _bucket_pairs([np.concatenate(x) for x in zip(*whole)])
            held = []
        held.append([c[cut:] for c in cols])
    if held:
        yield from _bucket_pairs([np.concatenate(x) for x in zip(*held)])


_COMPARED = "cls bigint, shingles array<bigint>, names array<bigint>"


def _note_shingles(note: str, known: WordHashes) -> np.ndarray:
    h = known.of(note.lower().split())
    return np.unique(ngrams(h, min(SHINGLE, len(h)))).view(np.uint64)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles, and names of a body, of one text a class."""
    known, words = _Tokens(), WordHashes()
    for batch in batches:
        out: list[tuple] = []
        for ident, text, view in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if view == "n":
                out.append((ident, _note_shingles(text, words).view(np.int64), _NONE))
                continue
            k, w, sizes = known.read(_TOKEN.findall(text))
            if view == "f":
                out.append((ident, form_shingles(k, sizes)[0].view(np.int64), _NONE))
            else:
                code = k != np.uint64(_LINE)
                out.append((ident, _shingles(k[code]).view(np.int64), np.unique(w[k == np.uint64(_I)]).view(np.int64)))
        if out:
            ids, shingles, names = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(shingles), _lists(names)], names=[x.split()[0] for x in _COMPARED.split(", ")])


_NOTED = "masked string, cls bigint, n bigint, keys array<bigint>, sketch array<bigint>"


def _note_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, bucket keys and sketch of each distinct masked note."""
    known = WordHashes()
    longs = pa.list_(pa.int64())
    for batch in batches:
        notes = batch.column(0).to_pylist()
        out = [(x, *_class(_note_shingles(x.split("|", 1)[1], known), None, b"n" + x.encode())) for x in notes]
        if out:
            yield pa.RecordBatch.from_arrays([_lists(c) if t is longs else pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), longs, longs))], names=[x.split()[0] for x in _NOTED.split(", ")])


def _masked_notes(own: DataFrame) -> DataFrame:
    """``masked, file_id, repo, path_key`` for each note that says something of its file; words that fewer than three repositories use are masked as names."""
    lines = own.select("file_id", "repo", "path_key", F.explode("notes").alias("note"))
    words = lines.select("repo", F.explode(F.array_distinct(F.split(F.split_part("note", F.lit("|"), F.lit(2)), " "))).alias("word")).distinct()
    rare = words.filter(F.col("word").rlike(r"^\p{L}")).groupBy("word").agg(F.count("*").alias("repos")).filter(F.col("repos") < _COMMON).select("word", F.lit(True).alias("rare"))
    parts = lines.select("note").distinct().select("note", F.posexplode(F.split(F.expr("substring(note, instr(note, '|') + 1)"), " ")).alias("at", "word"))
    word = F.when(F.col("rare"), F.lit("I")).otherwise(F.col("word"))
    masked = parts.join(rare, "word", "left").groupBy("note").agg(F.array_sort(F.collect_list(F.struct("at", word.alias("w")))).alias("x"))
    masked = masked.select("note", F.concat(F.split_part("note", F.lit("|"), F.lit(1)), F.lit("|"), F.array_join(F.transform("x", lambda y: y.w), " ")).alias("masked"))
    return lines.join(masked, "note").select("masked", "file_id", "repo", "path_key")


def not_handwritten(files: DataFrame) -> DataFrame:
    """The rows of ``files`` (file_id, repo, relative_path, size_bytes, text) that nobody wrote by hand: ``file_id, reason``, one row each.

    Every row comes out of a cluster. Four kinds of parts of a file are clustered: the masked shingles of its whole text (identifiers and literals
    masked, 5 tokens), the shingles of its statements' forms where it is dense, repetitive or literal (short names masked apart), the notes at its
    start and end (names and numbers masked), and parts of its path (digits masked). Equal parts are one class; classes meet by MinHash banding, in a
    bucket all are compared by size and sketch, and a similarity of 0.8 or more is checked exactly once.

    A cluster speaks for a file only if it holds another path. Near copies across repositories that also share half of their names are vendored; three
    near copies of a form within one repository are a generated family; near copies that consist of literals are data. A cluster of statements' forms
    tells minified, generated and data files; its pieces may lie in one file, if the file's halves are near copies. What a cluster of notes or paths
    means is checked by its wording, which alone finds nothing.

    A missing text is clustered by path, and by size beyond what anybody types. Rows delivered twice have one path and never count as copies of each
    other. Prose is clustered by folder only, configuration not by its whole text. Null paths count as empty. ``file_id`` must be unique. The work in a
    bucket grows with the square of its different classes, and a bucket is one task's; files clustered by their forms are not paired by their bodies; joins by a mark or note split keys that many files share.
    """
    files = files.select(F.col("file_id").cast("bigint"), F.coalesce("repo", F.lit("")).alias("repo"), F.col("relative_path"), F.col("size_bytes").cast("bigint"), "text")
    own = durable(files.mapInArrow(_own, _OWN), "files-own")
    where = F.struct("repo", "path_key")
    places = (F.min(where).alias("w1"), F.max(where).alias("w2"), F.count("*").alias("files"))
    elsewhere = F.col("w1.path_key") != F.col("w2.path_key")

    marks = own.select("file_id", "repo", "path_key", F.explode("marks").alias("mark"))
    shared = marks.groupBy("mark").agg(*places).filter(elsewhere).select("mark", "files")
    lines = durable(_masked_notes(own), "files-notes")
    noted = durable(lines.groupBy("masked").agg(*places), "files-noted")
    total = own.count()
    by_path = hot_split_join(marks, shared, ["mark"], "files", total).select("file_id", F.split_part("mark", F.lit("|"), F.lit(1)).alias("reason"))

    bodies = own.filter("cls is not null").groupBy("cls").agg(
        F.min("file_id").alias("one"), *places, F.max(F.col("shape").isNull()).alias("need"), F.max("lit").alias("lit"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"),
    )
    forms = own.filter("fcls is not null").groupBy(F.col("fcls").alias("cls")).agg(
        F.min("file_id").alias("one"), *places, F.min("alone").alias("alone"), F.first("fn").alias("n"), F.first("fkeys").alias("keys"), F.first("fsketch").alias("sketch"),
    )
    # a class that is a cluster by itself needs no partner
    forms = forms.withColumns({"need": ~F.col("alone") & ~elsewhere, "lit": F.lit(True)})
    notes = noted.select("masked").mapInArrow(_note_classes, _NOTED).join(noted, "masked")
    notes = durable(notes.select("cls", F.lit(None).cast("bigint").alias("one"), "w1", "w2", "files", (~elsewhere).alias("need"), F.lit(True).alias("lit"), "n", "keys", "sketch", "masked"), "files-note-classes")
    view = lambda df, v: df.select("cls", "one", "w1", "w2", "files", "need", "lit", "n", "keys", "sketch", F.lit(v).alias("view"))
    classes = durable(view(bodies, "b").unionByName(view(forms, "f")).unionByName(view(notes, "n")), "files-classes")

    words = [F.col("sketch")[i].alias(f"s{i}") for i in range((_SKETCH + _NAME_SKETCH) // 32)]
    rows = classes.select(F.posexplode("keys").alias("band", "h"), "view", "cls", "n", F.col("w1.repo").alias("repo"), (F.col("w1.repo") != F.col("w2.repo")).alias("many"), "need", "lit", *words)
    rows = rows.select(F.xxhash64("view", "band", "h").alias("key"), *[c for c in rows.columns if c not in ("band", "h", "view")])
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = rows.repartition(parts, "key").sortWithinPartitions("key", "n").mapInArrow(_candidates, "a bigint, b bigint").distinct()
    pairs = durable(pairs, "files-pairs")

    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    wanted = durable(classes.join(wanted, "cls", "left_semi").select(F.col("one").alias("file_id"), "cls", "view"), "files-wanted")
    texts = files.select("file_id", "text").join(wanted.filter("view <> 'n'"), "file_id").select("cls", "text", "view")
    said = notes.join(wanted.filter("view = 'n'").select("cls", "view"), "cls").select("cls", F.expr("substring(masked, instr(masked, '|') + 1)").alias("text"), "view")
    sides = durable(texts.unionByName(said).mapInArrow(_compared, _COMPARED), "files-compared")
    other = sides.select(F.col("cls").alias("b"), F.col("shingles").alias("shingles2"), F.col("names").alias("names2"))
    both = pairs.join(sides.withColumnRenamed("cls", "a"), "a").join(other, "b")

    def jaccard(x: str, y: str):
        common = F.size(F.array_intersect(x, y))
        return common / F.greatest(F.size(x) + F.size(y) - common, F.lit(1))

    near = durable(both.filter(jaccard("shingles", "shingles2") >= SIMILAR).select("a", "b", jaccard("names", "names2").alias("shared")), "files-near")
    same = classes.filter(elsewhere).select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("shared"))
    near = near.union(near.select("b", "a", "shared")).union(same)
    linked = durable(near.select(F.col("a").alias("cls")).distinct(), "files-linked")

    by_note = notes.join(linked, "cls", "left_semi").select("masked", "files")
    by_note = hot_split_join(lines, by_note, ["masked"], "files", total).select("file_id", F.split_part("masked", F.lit("|"), F.lit(1)).alias("reason"))
    shaped = own.filter("fcls is not null").select("file_id", "shape", "alone", F.col("fcls").alias("cls"))
    by_form = shaped.join(linked.withColumn("linked", F.lit(True)), "cls", "left").filter("alone or linked").select("file_id", F.col("shape").alias("reason"))

    need = own.filter("cls is not null").select("file_id", "repo", "path_key", F.col("cls").alias("a"), "lit", "hand")
    of = near.join(classes.filter("view = 'b'").select(F.col("cls").alias("b"), "w1", "w2"), "b").join(need, "a")
    # a path belongs to one repository, so the first and the last place of a class show whether it has another one
    away = [F.col(f"{w}.path_key") != F.col("path_key") for w in ("w1", "w2")]
    abroad = [F.col(f"{w}.repo") != F.col("repo") for w in ("w1", "w2")]
    data = F.max(F.col("lit") & (away[0] | away[1]))
    vendored = F.max((away[0] & abroad[0] | away[1] & abroad[1]) & (F.col("shared") >= _NAMES) & ~F.col("hand"))
    homes = own.filter("cls is not null").select(F.col("cls").alias("b"), "repo", F.col("path_key").alias("path2")).distinct()
    family = near.filter("shared < 1").join(need, "a").join(homes, ["b", "repo"]).filter("path2 != path_key")
    family = family.groupBy("file_id").agg((F.count_distinct("path2") >= _FAMILY - 1).alias("family"))
    seen = of.groupBy("file_id").agg(data.alias("data"), vendored.alias("vendored")).join(family, "file_id", "left")
    why = F.when(F.col("data"), "data: cluster").when(F.col("vendored"), "vendored: cluster").when(F.col("family"), "generated: family")
    by_body = seen.select("file_id", why.alias("reason")).filter("reason is not null")

    rank = lambda df, n: df.select("file_id", F.struct(F.lit(n).alias("n"), "reason").alias("x"))
    every = rank(by_path, 0).union(rank(by_note, 1)).union(rank(by_form, 2)).union(rank(by_body, 3))
    return every.groupBy("file_id").agg(F.min("x").alias("x")).select("file_id", F.col("x.reason").alias("reason"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_handwritten(table(spark, sf_dir, "files", "file_id", "repo", "relative_path", "size_bytes", "text")).select("file_id")


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each found file with the reason."""
    return not_handwritten(table(spark, sf_dir, "files", "file_id", "repo", "relative_path", "size_bytes", "text"))


QUERIES = {"p1_found": p1_found, "p1_reasons": p1_reasons}
SQL: dict[str, str] = {}
