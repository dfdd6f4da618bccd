"""Evaluation texts leaking into a corpus: rare n-gram seeds, then word-level Smith-Waterman alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.words import WordHashes, bitmap, has_bit, ngrams
from lineweave.plans.durable import durable
from lineweave.plans.skew import hot_split_join
from lineweave.sources.tables import table

_WORD = re.compile("[A-Za-z0-9]+")
#: Words in a row that count as a shown passage, and the shorter run that makes an edited copy worth aligning.
RUN, SEED = 10, 5
#: A run that more items than this hold is a stock phrase.
MAX_ITEMS = 3
#: Bits of the filter that keeps corpus runs without a partner from being shuffled: 16 a seed, at least 4 MB and at most 128 MB.
_BITS, _MOST_BITS = 1 << 25, 1 << 30
#: Cells of the alignment tables that are filled at once.
_CELLS = 1 << 22
#: Up to so many seeds (24 bytes each) are broadcast; more go through a shuffle join.
BROADCAST_SEEDS = 1_000_000
_MATCH, _MISMATCH, _GAP = 2, -1, -1


def words_of(text: str | None) -> list[str]:
    """Maximal runs of ASCII letters and digits, lowered."""
    return [w.lower() for w in _WORD.findall(text)] if text else []


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        out: list[tuple] = []
        for item, field, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            h = known.of(words_of(text))
            for n in (SEED, RUN):
                out += [(item, field, n, x) for x in np.unique(ngrams(h, n)).tolist()]
        if out:
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["item_id", "field", "n", "h"])


def _passages(bits, reach: int):
    """Per document the passages around runs that may be seeds: (doc_id, passage, words, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        filled = np.frombuffer(bits.value, dtype=np.uint8)
        last = np.uint64(8 * len(filled) - 1)
        for batch in batches:
            ids, words, lengths = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = _WORD.findall(text.lower() if text.isascii() else text) if text else ()
                if len(w) >= SEED:
                    ids.append(i)
                    words.extend(w if text.isascii() else map(str.lower, w))
                    lengths.append(len(w))
            if not ids:
                continue
            ends = np.cumsum(lengths)
            starts = ends - lengths
            h = known.of(words)
            hits: list[tuple[np.ndarray, np.ndarray]] = []
            for n in (SEED, RUN):
                g = ngrams(h, n)
                slot = g.view(np.uint64) & last
                at = np.flatnonzero(has_bit(filled, slot))
                doc = np.searchsorted(ends, at, side="right")
                at = at[at + n <= ends[doc]]  # a run over two documents is none
                hits.append((at, g[at]))
            at = np.concatenate([x for x, _ in hits])
            g = np.concatenate([x for _, x in hits])
            order = np.argsort(at, kind="stable")
            at, g = at[order], g[order]
            out: list[tuple] = []
            i = 0
            while i < len(at):
                d = int(np.searchsorted(ends, at[i], side="right"))
                j = i + 1
                while j < len(at) and at[j] < ends[d] and at[j] - at[j - 1] <= reach and at[j] - at[i] <= 8 * reach:
                    j += 1
                a, b = max(int(starts[d]), int(at[i]) - reach), min(int(ends[d]), int(at[j - 1]) + RUN + reach)
                out.append((ids[d], a - int(starts[d]), " ".join(words[a:b]), np.unique(g[i:j]).tolist()))
                i = j
            if out:
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "at", "passage", "hs"])

    return run


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smith-Waterman scores of (item words, passage words) pairs, all pairs of the list at once.

    With a linear gap cost, a row's dependence on its own left neighbours is a running maximum, so each row is a few vector operations.
    """
    n = len(pairs)
    rows, width = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    q = np.zeros((n, rows), dtype=np.uint64)
    p = np.ones((n, width), dtype=np.uint64)
    for k, (a, b) in enumerate(pairs):
        q[k, : len(a)] = a
        p[k, : len(b)] = b
    slope = np.arange(width + 1, dtype=np.int32) * -_GAP
    last = np.zeros((n, width + 1), dtype=np.int32)
    best = np.zeros(n, dtype=np.int32)
    for i in range(rows):
        here = np.zeros_like(last)
        step = np.where(p == q[:, i : i + 1], _MATCH, _MISMATCH).astype(np.int32)
        np.maximum(last[:, :-1] + step, last[:, 1:] + _GAP, out=here[:, 1:])
        np.maximum(here, 0, out=here)
        last = np.maximum.accumulate(here + slope, axis=1) - slope
        np.maximum(best, last.max(axis=1), out=best)
    return best


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        doc, item, passage, text, field, runs = (batch.column(i).to_pylist() for i in range(6))
        order = sorted(range(len(doc)), key=lambda i: len(passage[i]))
        out: list[tuple] = []
        s = 0
        while s < len(order):
            n = 1  # passages come by length, so the last of a part is its longest
            while n < 128 and s + n < len(order) and (n + 1) * len(passage[order[s + n]]) <= _CELLS:
                n += 1
            part = order[s : s + n]
            s += n
            pairs = [(known.of(words_of(text[i])), known.of(passage[i].split())) for i in part]
            for i, (a, b), score in zip(part, pairs, align(pairs).tolist()):
                shown = bool(runs[i]) and bool(np.isin(ngrams(b, RUN), np.array(runs[i], dtype=np.int64)).any())
                out.append((item[i], doc[i], field[i], score, score / (_MATCH * len(a)), shown))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["item_id", "doc_id", "field", "score", "share", "shown"])


_ALIGNED = "item_id bigint, doc_id bigint, field string, score int, share double, shown boolean"


def leaked(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs of an evaluation item and a document that shows some of it: ``item_id, doc_id, field, score, share, shown``.

    ``items`` has ``item_id, field, text`` (a row per field), ``documents`` has ``doc_id, text``. Seeds are the runs of 5 and of 10 words that at most
    three items hold. Each passage of a document around a seed is aligned with the whole item field by word-level Smith-Waterman (match 2, mismatch
    and gap -1); ``score`` is the best alignment of the pair, ``share`` is it over the score of a full copy, so edited copies keep a high share.
    ``shown`` is exact: at least 10 consecutive words of the field, a run that at most three items hold, stand in the document.

    Words are runs of ASCII letters and digits without case. Null and empty texts show nothing. Repeated documents each give their rows under their
    own identifiers; pairs come once. Documents are read once; only passages around seeds are shuffled. The filter that finds them is 4 MB whatever
    the number of items up to 2 million seeds, and 16 bits a seed up to 128 MB; seeds are broadcast only up to a checked number, beyond it those that many
    passages hold are split off the shuffle. Rarity is counted over items: a run that the corpus repeats costs an alignment each time, as each
    document that holds it is to be reported.
    """
    spark = documents.sparkSession
    items = items.select(F.col("item_id").cast("bigint"), F.col("field").cast("string"), "text").filter(F.col("text").isNotNull()).distinct()
    seeds = items.mapInArrow(_seed_rows, "item_id bigint, field string, n int, h bigint")
    holders = seeds.groupBy("h").agg(F.countDistinct("item_id").alias("k")).filter(F.col("k") <= MAX_ITEMS).select("h")
    rare = durable(seeds.join(holders, "h"), "leak-seeds")

    n_seeds = rare.count()
    slots = _BITS
    while slots < min(_MOST_BITS, 16 * n_seeds):
        slots *= 2
    bits = spark.sparkContext.broadcast(bitmap(rare, F.col("h").bitwiseAND(F.lit(slots - 1)), slots))

    longest = items.agg(F.coalesce(F.max(F.regexp_count("text", F.lit("[A-Za-z0-9]+"))), F.lit(0))).first()[0]
    reach = max(longest, RUN)
    found = documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_passages(bits, reach), "doc_id bigint, at int, passage string, hs array<bigint>")
    found = durable(found, "leak-passages")
    keys = rare.select("h", "item_id", "field").distinct()
    held = found.select("doc_id", "at", F.explode("hs").alias("h"))
    if n_seeds <= BROADCAST_SEEDS:
        met = held.join(F.broadcast(keys), "h")
    else:  # a seed that much of the corpus holds is split off the shuffle
        met = hot_split_join(held, keys.join(held.groupBy("h").agg(F.count("*").alias("times")), "h"), ["h"], "times", held.count())
    pairs = met.select("doc_id", "at", "item_id", "field").distinct()
    runs = rare.filter(F.col("n") == RUN).groupBy("item_id", "field").agg(F.collect_set("h").alias("runs"))
    texts = items.join(runs, ["item_id", "field"], "left")
    texts = F.broadcast(texts) if n_seeds <= BROADCAST_SEEDS else texts
    full = pairs.join(found.select("doc_id", "at", "passage"), ["doc_id", "at"]).join(texts, ["item_id", "field"])
    aligned = full.select("doc_id", "item_id", "passage", "text", "field", "runs").mapInArrow(_score, _ALIGNED)
    return aligned.groupBy("item_id", "doc_id", "field").agg(F.max("score").alias("score"), F.max("share").alias("share"), F.max("shown").alias("shown"))


def task_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tasks", "item_id", "query_text", "answer")
    return t.select("item_id", F.lit("query_text").alias("field"), F.col("query_text").alias("text")).unionByName(
        t.select("item_id", F.lit("answer").alias("field"), F.col("answer").alias("text"))
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = leaked(task_fields(spark, sf_dir), table(spark, sf_dir, "documents", "doc_id", "text"))
    return pairs.filter("shown").select("item_id", "doc_id").distinct()


def p8_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose best alignment reaches 0.6 of a full copy, shown word for word or edited."""
    pairs = leaked(task_fields(spark, sf_dir), table(spark, sf_dir, "documents", "doc_id", "text"))
    return pairs.filter(F.col("share") >= 0.6).select("item_id", "doc_id", "field", "score", F.round("share", 6).alias("share"), "shown")


QUERIES = {"p8_found": p8_found, "p8_edited": p8_edited}
SQL = {
    "p8_found": r"""
with fields as (
  select item_id, unnest([query_text, answer]) as text from tasks
), iw as (select item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) as w from fields where text is not null),
ig as (select distinct item_id, array_to_string(w[i:i+9], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 8)) as i from iw)),
rare as (select g from ig group by g having count(distinct item_id) <= 3),
dw as (select doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) as w from documents where text is not null),
dg as (select distinct doc_id, array_to_string(w[i:i+9], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 8)) as i from dw))
select distinct item_id, doc_id from dg join rare using (g) join ig using (g)"""
}
