"""Structured Streaming front (an extension): windows, sessions and deduplication under watermarks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siembra.sources.scratch import shared_folder

LATE = "2 hours"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream; the schema comes from the data."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    # a stream reads folders: a table that is one file is found by its name
    single = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = single.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(single).isFile()
    source = stream.option("pathGlobFilter", name).parquet(folder) if is_file else stream.parquet(path)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(stream: DataFrame) -> DataFrame:
    """Tumbling windows of an hour by event type."""
    w = stream.withWatermark("ts", LATE).groupBy(F.window("ts", "1 hour"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")).select(F.col("window.start").alias("inicio"), "event_type", "n", "total")


def sliding(stream: DataFrame, size: str = "2 hours", slide: str = "30 minutes") -> DataFrame:
    return stream.withWatermark("ts", LATE).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("inicio"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return stream.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("inicio"), F.col("session_window.end").alias("fin"), "user_id", "n")


def deduplicated(stream: DataFrame) -> DataFrame:
    return stream.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(spark: SparkSession, path: str, shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Drain a stream into a memory sink in complete mode and read it back.

    State and offsets go to the shared checkpoint folder of the session.
    """
    base = shared_folder(spark)
    name = f"stream_{uuid.uuid4().hex}"
    running = shape(read_events(spark, path)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{base}/{name}").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)
