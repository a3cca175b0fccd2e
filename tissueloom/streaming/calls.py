"""Streams of expression calls: parsed files appended to a table, and running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import CALL_COLUMNS, unquoted


def call_stream(spark: SparkSession, folder: str, quality: str = "*", files_per_trigger: int | None = None) -> DataFrame:
    """Call tables that arrive in a folder, parsed as they come."""
    reader = spark.readStream.schema(", ".join(f"{c} string" for c in CALL_COLUMNS)).option("sep", "\t").option("header", True).option("quote", "\0")
    raw = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).csv(folder)
    out = raw.select(
        unquoted("gene_id").alias("gene"), unquoted("anatomical_id").alias("tissue"), unquoted("stage_id").alias("stage"),
        unquoted("expression").alias("expression"), unquoted("call_quality").alias("quality"), F.col("expression_rank").try_cast("double").alias("rank"),
    )
    return out if quality == "*" else out.where(F.col("quality") == quality)


def append_calls(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to a parquet table, exactly once, and ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running_counts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Calls of each stage so far: each batch writes the whole counts to its own folder, so a repeated batch leaves the same files."""
    counts = stream.groupBy("stage").agg(F.count("*").alias("cluster_size"))
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return counts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """What the last batch of running_counts wrote."""
    every = spark.read.parquet(path)
    return every.join(F.broadcast(every.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Event files (event_id, ts, event_type, value) that arrive in a folder."""
    reader = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def append_windows(events: DataFrame, path: str, checkpoint: str, **how) -> StreamingQuery:
    """Appends each window to a parquet table once the watermark has passed its end; later events of it are dropped."""
    return windowed_events(events, **how).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event counts and sums in tumbling windows of event time, with a bound on lateness."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
