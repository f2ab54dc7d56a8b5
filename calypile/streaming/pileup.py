"""The pileup kept up to date from a stream of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calypile.operators.calls import THRESHOLD, merge_pileups, modified
from calypile.operators.regions import in_window

KEYS = ["sample", "chr", "pos", "mod"]


def stream_calls(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of calls as they arrive in a folder; path may also be a pattern of files."""
    return spark.readStream.schema(schema).parquet(path)


def streaming_pileup(calls: DataFrame, regions: DataFrame | None = None, threshold: int = THRESHOLD, late: str | None = None) -> DataFrame:
    """Running counters per sample, chr, pos and mod (output modes update and complete).

    regions: a static table; only calls strictly inside one count, once per region. late: a watermark on loaded_at; then counters
    are per hour of arrival too, so that the state of closed hours is dropped, and append mode is possible.
    """
    if late:
        calls = calls.withWatermark("loaded_at", late)
    rows = in_window(calls, regions) if regions is not None else calls
    hour = [F.window("loaded_at", "1 hour").alias("arrived")] if late else []
    hit = modified(F.col("prob"), threshold).cast("bigint")
    return rows.groupBy(*hour, *KEYS).agg(F.sum(hit).alias("methylated_bases"), F.count(F.lit(1)).alias("total_bases"))


def upsert_batches(calls: DataFrame, path: str, checkpoint: str, threshold: int = THRESHOLD):
    """A stream writer that adds each micro-batch's counters as a folder of its own, named by the batch: a repeated batch replaces itself,
    so counters are exact after failures. stored_pileup() adds the folders up."""

    def add(batch: DataFrame, number: int) -> None:
        hit = modified(F.col("prob"), threshold).cast("bigint")
        counted = batch.groupBy(*KEYS).agg(F.sum(hit).alias("methylated_bases"), F.count(F.lit(1)).alias("total_bases"))
        counted.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return calls.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def stored_pileup(spark: SparkSession, path: str) -> DataFrame:
    return merge_pileups(spark.read.parquet(path).drop("batch"), keys=KEYS)
