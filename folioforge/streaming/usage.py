"""Usage rows as a stream: a file source, event-time windows with a watermark, and an idempotent sink per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_usage(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Calls and cost by service and window; rows later than the watermark are left out, as for any stream."""
    w = F.window("ts", window)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("cost")).select(F.col("window.start").alias("start"), "event_type", "calls", "cost")


def write_batches(stream: DataFrame, path: str, checkpoint: str):
    """Each micro-batch replaces its own folder, so a batch that is run again writes the same rows once."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save)
