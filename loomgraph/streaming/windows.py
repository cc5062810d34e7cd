"""Streams over growing tables: windowed counts, seen-set removal of repeats, gated micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(events: DataFrame, ts: str, key: str, size: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, key, n): tumbling or sliding counts; rows later than ``late`` are dropped by the watermark."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("_ts", late)
    w = F.window("_ts", size, slide) if slide else F.window("_ts", size)
    return e.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, session_start, session_end, n) of bursts without a longer gap."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("_ts", late)
    s = e.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


def unseen(events: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: the seen-set of a resumable collection."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(keys)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything there is now, one gated micro-batch after the other; restarts go on where they stopped."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_batches_complete(counts: DataFrame, path: str) -> None:
    """The whole result of an aggregate stream after all input, written under ``path``/out."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
