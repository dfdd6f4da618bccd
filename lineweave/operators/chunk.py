"""Line tables, line-aligned chunks, windows and ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineweave.functions import text as T


def lines(files: DataFrame) -> DataFrame:
    """``source, line, text, n_tokens`` for every physical line of ``files`` (source, text)."""
    x = files.select("source", F.posexplode(T.physical_lines(F.col("text"))).alias("pos", "text"))
    return x.select("source", (F.col("pos") + 1).alias("line"), "text", T.token_count(F.col("text")).alias("n_tokens"))


_SPANS = "source string, line_start int, line_end int, char_start bigint, char_end bigint, token_start bigint, token_end bigint, text string"


def _chunk(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), *[(n, pa.int64()) for n in ("char_start", "char_end", "token_start", "token_end")], ("text", pa.string())])
        for batch in batches:
            out: list[tuple] = []
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += ((source, *x) for x in chunk_text(text, block))
                if len(out) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def chunk_text(text: str, block: int) -> Iterator[tuple[int, int, int, int, int, int, str]]:
    """Blocks of whole lines: (first line, last line, char start, char end, token start, token end, text). A block ends before the line that would bring
    it over ``block`` tokens; a longer line is a block of its own. Blocks follow each other without gaps."""
    first, start_char, start_token, size, char, line = 1, 0, 0, 0, 0, 0
    while char < len(text):
        end = text.find("\n", char) + 1 or len(text)
        n = len(text[char:end].split())
        if line >= first and size + n > block:
            yield first, line, start_char, char, start_token, start_token + size, text[start_char:char]
            first, start_char, start_token, size = line + 1, char, start_token + size, 0
        line, size, char = line + 1, size + n, end
    if text:
        yield first, line, start_char, char, start_token, start_token + size, text[start_char:char]


def chunk_lines(files: DataFrame, block: int = 512) -> DataFrame:
    """Line-aligned spans of every file (source, text). Linear in the text length; rows are independent, so there is no shuffle."""
    x = files.filter(F.length("text") > 0).select("source", T.normalize_newlines(F.col("text")).alias("text"))
    return x.mapInArrow(_chunk(block), _SPANS)


def fixed_windows(line_rows: DataFrame, size: int) -> DataFrame:
    """Tumbling windows of ``size`` lines: ``source, window, line_start, line_end, n_tokens``."""
    w = F.floor((F.col("line") - 1) / size)
    return line_rows.groupBy("source", w.alias("window")).agg(F.min("line").alias("line_start"), F.max("line").alias("line_end"), F.sum("n_tokens").alias("n_tokens"))


def sliding_windows(line_rows: DataFrame, size: int = 40, stride: int = 30) -> DataFrame:
    """Windows of ``size`` lines every ``stride`` lines; each line goes to the few windows that hold it, so no join is needed."""
    at = F.col("line") - 1
    first = F.greatest(F.ceil((at - size + 1) / stride), F.lit(0)).cast("int")
    x = line_rows.select("source", "line", "n_tokens", F.explode(F.sequence(first, F.floor(at / stride).cast("int"))).alias("window"))
    return x.groupBy("source", "window").agg(F.min("line").alias("line_start"), F.max("line").alias("line_end"), F.sum("n_tokens").alias("n_tokens"))


def merge_ranges(ranges: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Unite overlapping and touching integer ranges of each key (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = ranges.withColumn("__new", F.when(F.col(low) <= before + 1, 0).otherwise(1))
    x = x.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "__island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("__island")


def neighbourhoods(hits: DataFrame, reach: int) -> DataFrame:
    """Merged ranges of ``reach`` lines around the hits (source, line)."""
    x = hits.select("source", F.greatest(F.col("line") - reach, F.lit(1)).alias("low"), (F.col("line") + reach).alias("high"))
    return merge_ranges(x, ["source"], "low", "high")


def sections(line_rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Requested lines (ranges: source, low, high) with their character offsets in the whole file."""
    w = Window.partitionBy("source").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    x = line_rows.withColumn("char_start", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)))
    r = ranges.select(F.col("source").alias("s"), "low", "high")
    return x.join(r, (F.col("source") == F.col("s")) & F.col("line").between(F.col("low"), F.col("high"))).drop("s")


def active_window(spans: DataFrame, key: list[str], order: Column, prefix: int = 256, tail: int = 256) -> DataFrame:
    """Zone (prefix, middle, tail) of each span: spans are taken from both ends until the asked tokens are reached. A sequence within prefix + tail tokens is
    all prefix. ``spans`` has ``n_tokens``."""
    w = Window.partitionBy(*key).orderBy(order)
    before = F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.coalesce(F.sum("n_tokens").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    total = F.sum("n_tokens").over(Window.partitionBy(*key))
    small = (F.lit(prefix + tail) > 0) & (total <= prefix + tail)
    return spans.withColumn("zone", F.when(small | (before < prefix), "prefix").when(after < tail, "tail").otherwise("middle"))


def range_prefix(line_rows: DataFrame, budget: int) -> DataFrame:
    """Lines of each source up to the first that overflows the budget: ``kept``, and for the rest the line at which to continue."""
    w = Window.partitionBy("source").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    x = line_rows.withColumn("used", F.sum("n_tokens").over(w))
    return x.groupBy("source").agg(
        F.coalesce(F.max(F.when(F.col("used") <= budget, F.col("line"))), F.lit(0)).alias("kept_lines"),
        F.coalesce(F.max(F.when(F.col("used") <= budget, F.col("used"))), F.lit(0)).alias("used_tokens"),
        F.min(F.when(F.col("used") > budget, F.col("line"))).alias("continue_at"),
    )
