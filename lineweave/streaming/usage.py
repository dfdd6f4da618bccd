"""Streams: usage per day with late rows, and files that changed since they were indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """Parquet files that arrive in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def daily_usage(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Calls and value per day and type; rows later than ``late`` behind the newest are dropped. ``events`` has ``ts, event_type, value``. Works on batches
    too, where nothing is late."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    x = x.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("value"))
    return x.select(F.to_date("window.start").alias("day"), "event_type", "calls", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events at most ``gap`` apart."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def written(spark: SparkSession, path: str) -> bool:
    """Does the folder hold a parquet file?"""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/*.parquet")
    return len(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []) > 0


def index_changes(files: DataFrame, index_path: str, checkpoint: str) -> StreamingQuery:
    """Appends to the index those files (path, fingerprint) of a stream that it doesn't hold yet; a batch that is run again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["path", "fingerprint"])
        if written(spark, index_path):  # the first batch finds no index
            new = new.join(spark.read.parquet(index_path), ["path", "fingerprint"], "left_anti")
        new.write.mode("append").parquet(index_path)

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()
