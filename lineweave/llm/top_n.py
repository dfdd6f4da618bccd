"""Top N rows of every group by a streamed secondary sort."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.sources.tables import table


def _changes(column: pa.Array) -> np.ndarray:
    """For each row but the first: does its value differ from the row before it? Null equals null."""
    a, b = column[1:], column[:-1]
    differ = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _first_rows(n: int, group: Sequence[str]):
    """A function over sorted Arrow batches that keeps the first ``n`` rows of each run of equal group values.

    Its whole state is the last group's key and how many of its rows have gone by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(c)) for c in group]
            starts = np.zeros(rows, dtype=bool)
            for c in columns:
                starts[1:] |= _changes(c)
            first = tuple(c[0].as_py() for c in columns)
            carried = seen if last is not None and first == last else 0
            starts[0] = True
            at = np.flatnonzero(starts)
            position = np.arange(rows) - np.repeat(at, np.diff(np.append(at, rows)))
            position[: at[1] if len(at) > 1 else rows] += carried
            last, seen = tuple(c[rows - 1].as_py() for c in columns), int(position[-1]) + 1
            keep = position < n
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group under ``order``.

    Each existing partition is sorted by group and order and streamed, which leaves at most ``n`` rows of a group in it however many it had; only
    these are hash-partitioned by group, sorted and streamed again. So a group with a third of all rows costs no single task more than ``n`` rows
    from each partition, and nothing is buffered beyond Arrow batches and the sort, which spills.

    Nulls: a null group value is a group of its own; nulls in order columns go where ``order`` puts them. Rows equal in ``order`` are kept as they
    come, so ``order`` should end in an identifier. Repeated rows count each. An empty input gives an empty result. All columns are kept as they are.
    """
    if n < 1:
        return df.limit(0)
    keys = [F.col(c) for c in group]
    local = df.sortWithinPartitions(*keys, *order).mapInArrow(_first_rows(n, group), df.schema)
    return local.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(_first_rows(n, group), df.schema)


def best_candidates(candidates: DataFrame, n: int = 3) -> DataFrame:
    """``n`` best candidates of each source: ``source``, ``cand_id``, ``rank_score``, ``tok_start``, ``tok_end``.

    Rows delivered twice (same query, source and token range) count once, by their smallest identifier; rows whose score is null or NaN don't count.
    Order: score descending, then token start, token end and identifier ascending, nulls last.
    """
    once = (
        candidates.groupBy("source", "query_id", "tok_start", "tok_end")
        .agg(F.min(F.struct("cand_id", "rank_score")).alias("__r"))
        .select("source", F.col("__r.cand_id").alias("cand_id"), F.col("__r.rank_score").alias("rank_score"), "tok_start", "tok_end")
        .filter(F.col("rank_score").isNotNull() & ~F.isnan("rank_score"))
    )
    order = [F.col("rank_score").desc(), F.col("tok_start").asc_nulls_last(), F.col("tok_end").asc_nulls_last(), F.col("cand_id").asc()]
    return top_n_per_group(once, ["source"], order, n)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates", "cand_id", "query_id", "source", "tok_start", "tok_end", "rank_score")
    return best_candidates(c, 3).select("source", "cand_id")


def p5_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top ten of each source with their scores."""
    c = table(spark, sf_dir, "candidates", "cand_id", "query_id", "source", "tok_start", "tok_end", "rank_score")
    return best_candidates(c, 10).select("source", "cand_id", "rank_score", "tok_start", "tok_end")


_RANKED = """
with once as (
  select *, row_number() over (partition by query_id, source, tok_start, tok_end order by cand_id) as k from candidates
), ranked as (
  select *, row_number() over (partition by source order by rank_score desc, tok_start nulls last, tok_end nulls last, cand_id) as n
  from once where k = 1 and rank_score is not null and not isnan(rank_score)
)
"""

QUERIES = {"p5_found": p5_found, "p5_ranked": p5_ranked}
SQL = {
    "p5_found": _RANKED + "select source, cand_id from ranked where n <= 3",
    "p5_ranked": _RANKED + "select source, cand_id, rank_score, tok_start, tok_end from ranked where n <= 10",
}
