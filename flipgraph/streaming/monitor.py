"""A structured streaming monitor of run logs: an extension, for event tables that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipgraph.session import hadoop_path, new_folder


def read_events(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A stream of the Parquet file or of the folder ``name`` in ``folder``; new files are taken as they arrive."""
    files, path = hadoop_path(spark, f"{folder}/{name}")
    if files.getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{folder}/{name}")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def window_rates(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """events: (ts, event_type, value). Per tumbling window: events, errors and the mean value; late rows are dropped
    once the watermark has passed their window."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"))
    g = w.agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("n_errors"), F.avg("value").alias("mean_value"))
    return g.select(F.col("w.start").alias("start"), "n", "n_errors", "mean_value")


def once_within(events: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    """Re-delivered events dropped while their watermark lasts."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, user: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Per user, runs of events with pauses below ``gap``."""
    g = events.withWatermark("ts", late).groupBy(user, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, with checkpoint and result in the shared folder, and reads the result."""
    spark = stream.sparkSession
    out, state = new_folder(spark, "stream"), new_folder(spark, "stream-state")
    if mode == "append":
        q = stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out)
    else:
        schema = stream.schema

        def keep(batch: DataFrame, _id: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        q = stream.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
        q.awaitTermination()
        return spark.read.schema(schema).parquet(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
