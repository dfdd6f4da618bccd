"""Stored results of costly per-file work, found again by path and content.

A store is a parquet folder with one part a signature. The signature covers everything the stored values depend on, so a changed parameter finds nothing
and old parts can be dropped as folders.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

KEY = ["source", "fingerprint"]


class Store:
    """Rows of any schema by (source, fingerprint). A store that can't be read, or whose rows have another schema, counts as empty."""

    def __init__(self, spark: SparkSession, path: str, signature: str, schema: str):
        if not signature or "/" in signature or "=" in signature:
            raise ValueError("a signature is a folder's name")
        self.spark, self.path = spark, f"{path.rstrip('/')}/signature={signature}"
        self.schema = StructType.fromDDL(f"source string, fingerprint string, {schema}")

    def rows(self) -> DataFrame:
        """What is stored; of rows written twice one stays."""
        empty = self.spark.createDataFrame([], self.schema)
        try:
            found = self.spark.read.parquet(self.path)
        except AnalysisException:
            return empty
        kinds = {f.name: f.dataType for f in found.schema}
        if any(kinds.get(f.name) != f.dataType for f in self.schema):
            return empty
        return found.select(*self.schema.names).dropDuplicates()

    def through(self, files: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The results for ``files`` (source, fingerprint, ...): stored ones where the content is the same, else computed and stored.

        A file without results is stored as a row of nulls, so it isn't computed again; such rows are not returned.
        """
        wanted = files.select(*KEY).distinct()
        known = self.rows()
        missing = files.join(known.select(*KEY).distinct(), KEY, "left_anti")
        if not missing.isEmpty():
            fresh = compute(missing).select(*self.schema.names)
            none = missing.select(*KEY).distinct().join(fresh.select(*KEY).distinct(), KEY, "left_anti")
            none = none.select(*KEY, *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in KEY])
            fresh.unionByName(none).write.mode("append").parquet(self.path)
            known = self.rows()
        values = [f.name for f in self.schema if f.name not in KEY]
        some = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values])
        return known.join(wanted, KEY, "left_semi").filter(some)
