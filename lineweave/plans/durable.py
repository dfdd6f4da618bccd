"""Cutting lineage with tables in the shared folder.

``spark.checkpoint.dir`` names a folder that all executors share, so a table written there survives the loss of any executor.
Only where the setting is absent (tests, a laptop) a local folder is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_TABLES: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables of this application."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="lineweave-"))
    return f"{base.rstrip('/')}/lineweave-{app}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder's owner cleans up then
        pass


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as parquet into the shared folder and read it back; removed by ``release``, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables written so far and tell how many. To be called once the results built on them are written: a DataFrame that still
    reads one fails afterwards."""
    paths = _TABLES.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _remove(spark, path)
    return len(paths)
