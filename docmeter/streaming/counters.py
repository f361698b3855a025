"""Incremental counters and resumable collections as streams.

A micro-batch is written by its number, so that a batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def hourly(rows: DataFrame, ts: str, keys: list[Column], late: str | None = "2 hours") -> DataFrame:
    """Tumbling hourly counts; batch or stream. With a watermark closed hours leave the state."""
    rows = rows.withColumn("_ts", F.col(ts).cast("timestamp"))
    if late and rows.isStreaming:
        rows = rows.withWatermark("_ts", late)
    out = rows.groupBy(F.window("_ts", "1 hour"), *keys).agg(F.count(F.lit(1)).alias("total"))
    return out.select(F.col("window.start").alias("hour"), *[c for c in out.columns if c not in ("window", "total")], "total")


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder (or one file) as a stream."""
    path = path.rstrip("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "update") -> None:
    """Reads all there is; each batch is a folder of its number, so a repeated batch is written once."""

    def emit(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(emit).start().awaitTermination()


def latest(spark: SparkSession, out: str, keys: list[str], value: str) -> DataFrame:
    """The newest value of each key over all batches of an update-mode stream."""
    return spark.read.option("basePath", out).parquet(f"{out}/epoch=*").groupBy(*keys).agg(F.max_by(value, "epoch").alias(value))


def deduplicated(stream: DataFrame, key: str, out: str, checkpoint: str) -> None:
    """Appends each key once, over restarts too: answers that arrive again are left out."""
    run_to_table(stream.dropDuplicates([key]), out, checkpoint, "append")
