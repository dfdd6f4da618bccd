"""Counting tokens: white space in the JVM, or a public byte-level vocabulary in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.functions import text as T

#: How a byte-level vocabulary cuts a text before pairs are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(vocabulary: str, pattern: str = PATTERN) -> Callable[[str], list[int]]:
    """Encodes texts by a file of ranks (base64 token and rank a line); nothing in a text is a special token."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def with_token_count(df: DataFrame, column: str, out: str, vocabulary: str | None = None) -> DataFrame:
    """``df`` with the number of tokens of a text column: white-space tokens, or with ``vocabulary`` those of its encoding. Null texts have none."""
    if vocabulary is None:
        return df.withColumn(out, F.coalesce(T.token_count(F.col(column)), F.lit(0)).cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{out}` bigint")


def wire_cost(raw: str, count: Callable[[str], int]) -> int:
    """What a text costs in a JSON message: the dearer of the text itself and its JSON string."""
    import json

    return max(count(raw), count(json.dumps(raw)))
