"""Streaming ingestion and windows over events: beyond the batch operators, with the same results on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import new_path


def event_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, ts: str, keys: list[str], width: str, late: str, value: str) -> DataFrame:
    """start, keys, n, total by windows of event time; windows close once the watermark passes their end."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """key, start, stop, n of runs of events less than gap apart."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def once(events: DataFrame, ts: str, id_col: str, late: str) -> DataFrame:
    """Events of an id after its first, within the watermark, go."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_col])


def drained(out: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream gives for what is there now, as a table: Parquet in the shared folder for append mode (exactly once by
    its log), and the last full result for complete mode."""
    spark = out.sparkSession
    path, log = new_path(spark, "stream"), new_path(spark, "stream-log")
    if mode == "append":
        q = out.writeStream.outputMode("append").option("checkpointLocation", log).trigger(availableNow=True).format("parquet").start(path)
    else:
        q = out.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)
