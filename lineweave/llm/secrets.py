"""Credentials in source text: index of literals, owner counts, and a re-scan of every text for what was confirmed."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.credentials import HINT, literals, mask, structured, unmistakable
from lineweave.llm.words import bitmap, has_bit
from lineweave.plans.durable import durable
from lineweave.plans.skew import hot_split_join
from lineweave.sources.tables import table

#: A value in the files of more owners than this, and than this share of all owners, is a placeholder that people copy, however random it looks.
MAX_OWNERS, MAX_SHARE = 20, 0.02
#: Bits of each of the two filters of the re-scan: 4 MB, whatever the number of confirmed values.
_BITS = 1 << 25
#: Bytes at a value's end that the re-scan looks for first; shorter values are known only in context.
_TAIL = 8
#: Of longer values the re-scan looks for so many bytes at the end; the automaton then compares them whole.
_LONGEST = 400
_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def _poly(data: bytes) -> int:
    """Polynomial hash of bytes: what the difference of two running hashes gives for a slice."""
    h = 0
    for b in data:
        h = (h * _BASE + b + 1) & _M64
    return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _slot(h: int) -> int:
    return int(_mix(np.array([h], dtype=np.uint64))[0]) & (_BITS - 1)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _key(data: bytes) -> int:
    """By which a value and a slice of a text are joined."""
    return _signed(xxhash.xxh64_intdigest(data[-_LONGEST:]))


_INDEX = "owner string, h bigint, value string, n_bytes int, tail_slot bigint, full_slot bigint, known boolean, sure boolean"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Literals that may be credentials, one row each with the hashes that the re-scan needs."""
    for batch in batches:
        hinted = pc.fill_null(pc.match_substring_regex(batch.column(1), HINT), False)
        part = batch.filter(hinted)
        out: dict[tuple, None] = {}
        for owner, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            for f in literals(text):
                data = f.value.encode("utf-8", "surrogatepass")
                known = structured(f) and _TAIL <= len(data)
                end = data[-_LONGEST:]
                out[owner, _key(data), f.value, len(end), _slot(_poly(data[-_TAIL:])), _slot(_poly(end)), known, unmistakable(f)] = None
        if out:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in _INDEX.split(", ")])


_HITS = "origin string, row_id bigint, text string, hs array<bigint>"
_BLOCK = 1 << 21


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse() -> int:
    return pow(_BASE, -1, 1 << 64)


def _rescan(tails, fulls, lengths: list[int]):
    """Rows whose text holds a slice that both filters know, with the hashes of these slices; plus the values that the context rules see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_bits, full_bits = (np.frombuffer(x.value, dtype=np.uint8) for x in (tails, fulls))
        size = np.array(lengths, dtype=np.int64)
        for batch in batches:
            texts = batch.column(2)
            rows: dict[int, set[int]] = {}
            for i in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_numpy(zero_copy_only=False)).tolist():
                found = {_key(f.value.encode("utf-8", "surrogatepass")) for f in literals(texts[i].as_py())}
                if found:
                    rows[i] = found
            if len(size):
                for i, h in _slices(texts, tail_bits, full_bits, size):
                    rows.setdefault(i, set()).add(h)
            if rows:
                keep = sorted(rows)
                picked = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [picked.column(0), picked.column(1), picked.column(2), pa.array([sorted(rows[i]) for i in keep], pa.list_(pa.int64()))], names=["origin", "row_id", "text", "hs"]
                )

    return run


def _slices(texts: pa.Array, tail_bits: np.ndarray, full_bits: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """(row, value hash) of the slices of the texts that the filters know. Works on the column's own bytes, in blocks that overlap by the longest value."""
    if texts.type == pa.large_string():
        texts = texts.cast(pa.string())
    buffers = texts.buffers()
    if buffers[2] is None:
        return
    ends = np.frombuffer(buffers[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(buffers[2], dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    longest = int(size.max())
    base = np.uint64(_BASE)
    at = 0
    while at < len(raw):
        lo, hi = max(0, at - longest), min(len(raw), at + _BLOCK)
        piece = raw[lo:hi].astype(np.uint64) + np.uint64(1)
        if len(piece) >= _TAIL:
            t = np.zeros(len(piece) - _TAIL + 1, dtype=np.uint64)
            for k in range(_TAIL):
                t = t * base + piece[k : k + len(t)]
            stop = np.flatnonzero(has_bit(tail_bits, _mix(t) & np.uint64(_BITS - 1))) + _TAIL
            stop = stop[stop + lo > at]
            if len(stop):
                # running hash R(i) = sum of piece[j] * inverse^j gives a slice's hash by one multiplication
                inv = np.full(len(piece), _inverse(), dtype=np.uint64)
                inv[0] = 1
                inv = np.multiply.accumulate(inv)
                r = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(piece * inv, dtype=np.uint64)])
                power = _powers(len(piece) + 1)
                row = np.searchsorted(ends, stop + lo, side="left") - 1
                for s in range(0, len(stop), 4096):
                    e, rw = stop[s : s + 4096], row[s : s + 4096]
                    a = e[:, None] - size[None, :]
                    ok = a + lo >= np.maximum(ends[rw], lo)[:, None]
                    a0 = np.where(ok, a, 0)
                    h = (r[e][:, None] - r[a0]) * power[e - 1][:, None]
                    ok &= has_bit(full_bits, _mix(h) & np.uint64(_BITS - 1))
                    for x, y in zip(*np.nonzero(ok)):
                        yield int(rw[x]), _key(raw[lo + a[x, y] : lo + e[x]].tobytes())
        at = hi


_SPANS = "origin string, row_id bigint, line_no int, rule string, start int, length int, masked string"


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact places: every occurrence of a row's confirmed values, by an automaton of the batch's values. A value without a form of its own counts only
    where the context says so too."""
    for batch in batches:
        origin, ident, texts, values, marked = (batch.column(i).to_pylist() for i in range(5))
        auto = ahocorasick.Automaton()
        for vs in values:
            for v in vs:
                auto.add_word(v, v)
        auto.make_automaton()
        out: list[tuple] = []
        for o, i, text, vs, ks in zip(origin, ident, texts, values, marked):
            confirmed = dict(zip(vs, ks))
            context = {(f.start, f.end): f.rule for f in literals(text)}
            found = [(last - len(v) + 1, last + 1, v) for last, v in auto.iter(text) if v in confirmed]
            spans = {(a, b): context[a, b] for a, b, _ in found if (a, b) in context}
            for a, b, v in sorted(found, key=lambda x: (x[0], -x[1])):
                if confirmed[v] and not (a and text[a - 1].isalnum() and v[0].isalnum()) and not (b < len(text) and text[b].isalnum() and v[-1].isalnum()):
                    if not any(x < b and a < y for x, y in spans):
                        spans[a, b] = "known value"
            if spans:
                masked = mask(text, list(spans))
                out += [(o, i, text.count("\n", 0, a) + 1, rule, a, b - a, masked) for (a, b), rule in sorted(spans.items())]
        if out:
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in _SPANS.split(", ")])


def find_secrets(rows: DataFrame, max_owners: int = MAX_OWNERS, max_share: float = MAX_SHARE) -> DataFrame:
    """Every literal credential in ``rows`` (origin, row_id, owner, text): ``origin, row_id, line_no, rule, start, length, masked``, a row each.

    First all texts are read for literals whose form or context suggests a credential, and each value's owners are counted over the whole input: a
    value of more than ``max_owners`` owners that are more than ``max_share`` of all owners is a shared placeholder, unless it is a private key or an
    issued identifier. What remains is confirmed, and all texts are read again: every row comes from an occurrence that an Aho-Corasick automaton finds
    of a confirmed value. A value of a form of its own counts wherever it stands, one without only where the context says so. ``masked`` is the row's
    text with all its values masked. ``line_no`` counts from 1 and is the line on which the value starts.

    The second reading knows the confirmed values by two filters of 4 MB whatever their number, one over the values' last 8 bytes and one over their
    last 400, so nothing that grows with the corpus is broadcast; only texts with a hit are joined with the values, by hash, and each task's automaton
    holds the values of its own rows. Values that a large share of the rows hold are split off that join. Owners are counted with map-side combining.

    Null and empty texts have no credentials; a null owner counts as one owner together with others; repeated rows are reported each.
    """
    spark = rows.sparkSession
    rows = rows.select("origin", F.col("row_id").cast("bigint"), F.coalesce("owner", F.lit("")).alias("owner"), "text").filter(F.length("text") > 0)
    index = rows.select("owner", "text").mapInArrow(_index, _INDEX)
    of = ["h", "value", "n_bytes", "tail_slot", "full_slot"]
    index = durable(index.groupBy("owner", *of).agg(F.max("known").alias("known"), F.max("sure").alias("sure")), "secret-index")
    owners = rows.agg(F.approx_count_distinct("owner", 0.01)).first()[0]
    confirmed = index.groupBy(*of).agg(F.count("*").alias("owners"), F.max("known").alias("known"), F.max("sure").alias("sure"))
    confirmed = durable(confirmed.filter((F.col("owners") <= max(max_owners, max_share * owners)) | F.col("sure")).drop("owners", "sure"), "secret-values")
    known = confirmed.filter("known")
    sizes = sorted(r.n_bytes for r in known.select("n_bytes").distinct().collect())  # at most _LONGEST numbers
    tails = spark.sparkContext.broadcast(bitmap(known, F.col("tail_slot"), _BITS))
    fulls = spark.sparkContext.broadcast(bitmap(known, F.col("full_slot"), _BITS))
    hits = rows.select("origin", "row_id", "text").mapInArrow(_rescan(tails, fulls, sizes), _HITS)
    hits = durable(hits.withColumn("key", F.xxhash64("text")), "secret-hits")
    pairs = durable(hits.select("origin", "row_id", "key", F.explode("hs").alias("h")).distinct(), "secret-pairs")
    times = confirmed.select("h", "value", "known").join(pairs.groupBy("h").agg(F.count("*").alias("times")), "h")
    pairs = hot_split_join(pairs, times, ["h"], "times", pairs.count())
    own = pairs.groupBy("origin", "row_id", "key").agg(F.collect_list(F.struct("value", "known")).alias("vs"))
    own = own.withColumnsRenamed({"origin": "o2", "row_id": "r2", "key": "k2"})
    same = F.col("origin").eqNullSafe(F.col("o2")) & F.col("row_id").eqNullSafe(F.col("r2")) & (F.col("key") == F.col("k2"))
    full = hits.join(own, same).select("origin", "row_id", "text", F.col("vs.value").alias("values"), F.col("vs.known").alias("known"))
    return full.mapInArrow(_locate, _SPANS)


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.split_part("source", F.lit("/"), F.lit(1)).alias("owner")
    c = table(spark, sf_dir, "candidates").select(F.lit("candidates").alias("origin"), F.col("cand_id").alias("row_id"), owner, "text")
    s = table(spark, sf_dir, "symbols").select(F.lit("symbols").alias("origin"), F.col("symbol_id").alias("row_id"), owner, "text")
    return c.unionByName(s)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(source_rows(spark, sf_dir)).select("origin", "row_id", "line_no").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with credentials: how many, and the text with the values masked."""
    found = find_secrets(source_rows(spark, sf_dir))
    return found.groupBy("origin", "row_id", "masked").agg(F.count("*").alias("n_values"))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
SQL: dict[str, str] = {}
