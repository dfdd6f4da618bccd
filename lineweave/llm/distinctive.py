"""How distinctive a term is for its record: graph-of-words degree times collection rarity."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.plans.durable import durable
from lineweave.plans.skew import hot_split_join
from lineweave.sources.tables import table

_WORD = re.compile("[A-Za-z0-9_]+")
_CHUNK = 400_000


def _degrees(words: list[list[str]], window: int) -> Iterator[tuple[list[str], list[int]]]:
    """For each list of words its distinct terms with the number of distinct other terms less than ``window`` places away."""
    ids: dict[str, int] = {}
    code = ids.setdefault
    flat = np.fromiter((code(w, len(ids)) for w in chain.from_iterable(words)), dtype=np.int64)
    names = list(ids)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    row = np.repeat(np.arange(len(words)), lengths)
    v = max(1, len(names))
    nodes = np.unique(row * v + flat)
    edges = []
    for d in range(1, window):
        if d >= len(flat):
            break
        a, b, same = flat[:-d], flat[d:], (row[:-d] == row[d:]) & (flat[:-d] != flat[d:])
        a, b, r = a[same], b[same], row[:-d][same]
        edges += [(r * v + a) * v + b, (r * v + b) * v + a]
    degree = np.zeros(len(nodes), dtype=np.int64)
    if edges:
        ends = np.unique(np.concatenate(edges)) // v
        own, n = np.unique(ends, return_counts=True)
        degree[np.searchsorted(nodes, own)] = n
    cuts = np.searchsorted(nodes, np.arange(len(words) + 1) * v)
    terms = [names[i] for i in (nodes % v).tolist()]
    degrees = degree.tolist()
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        yield terms[a:b], degrees[a:b]


def _graph(window: int, from_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, ident, content = (batch.column(i).to_pylist() for i in range(3))
            if from_text:
                words = [[w.lower() for w in _WORD.findall(t)] if t else [] for t in content]
            else:
                words = [[w for x in (t or ()) if x and (w := x.strip(" ").lower())] for t in content]
            at = 0
            while at < len(words):  # a chunk holds few words, so its edge codes fit in 64 bits
                end, n = at + 1, len(words[at])
                while end < len(words) and n + len(words[end]) <= _CHUNK:
                    n += len(words[end])
                    end += 1
                kept = [(o, i, t, d) for o, i, (t, d) in zip(origin[at:end], ident[at:end], _degrees(words[at:end], window)) if t]
                at = end
                if kept:
                    o, i, t, d = zip(*kept)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(o, pa.string()), pa.array(i, pa.int64()), pa.array(t, pa.list_(pa.string())), pa.array(d, pa.list_(pa.int32()))],
                        names=["origin", "row_id", "terms", "degrees"],
                    )

    return run


_GRAPHS = "origin string, row_id bigint, terms array<string>, degrees array<int>"


def term_graphs(records: DataFrame, window: int = 3, from_text: bool = True) -> DataFrame:
    """Per record (origin, row_id, content) its distinct terms and their degree in the record's co-occurrence graph.

    Terms less than ``window`` places apart are neighbours. Text content is cut into runs of ASCII letters, digits and underscores, list content is
    trimmed; both are lowered. Records without a term (null or empty content) give no row.
    """
    return records.select("origin", F.col("row_id").cast("bigint"), "content").mapInArrow(_graph(window, from_text), _GRAPHS)


def term_weights(graphs: DataFrame) -> DataFrame:
    """``origin, row_id, term, degree, records, weight`` for every term of every record of ``graphs``.

    weight = (1 + degree) * ln((N + 1) / records), with N the records of the origin that have a term and ``records`` those that have this one. So a
    term of all records weighs almost nothing, and a record's only term still counts by its rarity. Repeated records count each.

    Record counts are summed map-side. Terms in more than 0.1 % of the records, at most a thousand times the mean terms of a record, are broadcast with
    their counts; only the rare rest is shuffled, where no term has more than that share.
    """
    graphs = durable(graphs, "term-graphs")
    n = graphs.groupBy("origin").agg(F.count("*").alias("n"))
    terms = graphs.select("origin", F.explode("terms").alias("term"))
    df = durable(terms.groupBy("origin", "term").agg(F.count("*").alias("records")), "term-records")
    sizes = {r.origin: r.n for r in n.collect()}  # one row per origin table
    total = sum(sizes.values())
    flat = graphs.select("origin", "row_id", F.explode(F.arrays_zip("terms", "degrees")).alias("x"))
    flat = flat.select("origin", "row_id", F.col("x.terms").alias("term"), F.col("x.degrees").alias("degree"))
    joined = hot_split_join(flat, df, ["origin", "term"], "records", total)
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("origin")] if sizes else F.lit(0)
    weight = (1 + F.col("degree")) * F.log((size + 1) / F.col("records"))
    return joined.withColumn("weight", weight)


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "candidates").select(F.lit("candidates").alias("origin"), F.col("cand_id").alias("row_id"), F.col("text").alias("content"))
    s = table(spark, sf_dir, "symbols").select(F.lit("symbols").alias("origin"), F.col("symbol_id").alias("row_id"), F.col("refs").alias("content"))
    return c, s


def p4_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _records(spark, sf_dir)
    graphs = term_graphs(c, 3).unionByName(term_graphs(s, 3, from_text=False))
    return term_weights(graphs).select("origin", "row_id", "term", "degree", "records", F.round("weight", 6).alias("weight"))


def p4_symbol_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the symbols alone."""
    graphs = term_graphs(_records(spark, sf_dir)[1], 3, from_text=False)
    return term_weights(graphs).select("row_id", "term", "degree", "records", F.round("weight", 6).alias("weight"))


_SQL = r"""
with rec as ({records}), pos as (
  select origin, row_id, unnest(words) as term, generate_subscripts(words, 1) as at from rec
), edges as (
  select distinct a.origin, a.row_id, a.term, b.term as other from pos a join pos b
  on a.origin = b.origin and a.row_id = b.row_id and abs(a.at - b.at) between 1 and 2 and a.term <> b.term
), nodes as (select distinct origin, row_id, term from pos),
degrees as (select origin, row_id, term, count(*) as degree from edges group by 1, 2, 3),
records as (select origin, term, count(*) as records from nodes group by 1, 2),
sizes as (select origin, count(distinct row_id) as n from nodes group by 1)
select {head}term, coalesce(degree, 0)::int as degree, records, round((1 + coalesce(degree, 0)) * ln((n + 1) / records), 6) as weight
from nodes join records using (origin, term) join sizes using (origin) left join degrees using (origin, row_id, term)"""
_TEXT = r"select 'candidates' as origin, cand_id as row_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) as words from candidates"
_REFS = r"select 'symbols' as origin, symbol_id as row_id, list_filter(list_transform(refs, lambda x: lower(trim(x))), lambda x: x <> '') as words from symbols"

QUERIES = {"p4_weights": p4_weights, "p4_symbol_terms": p4_symbol_terms}
SQL = {
    "p4_weights": _SQL.format(records=f"{_TEXT} union all {_REFS}", head="origin, row_id, "),
    "p4_symbol_terms": _SQL.format(records=_REFS, head="row_id, "),
}
