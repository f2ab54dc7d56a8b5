"""Stored tables: Parquet, partitioned by sample, replaced sample by sample; and the summary BED sink."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calypile.operators.calls import summary_bed


def write_samples(df: DataFrame, path: str) -> str:
    """Writes a table partitioned by sample; samples in df replace those stored, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample").parquet(path)
    return path


def read_samples(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """A stored table; only the partitions of the given samples are read."""
    df = spark.read.parquet(path)
    return df.where(F.col("sample").isin(samples)) if samples else df


def write_summary_beds(pileup: DataFrame, folder: str, name: str) -> list[str]:
    """One headerless, tab-separated folder per mod family (A, CG): chr, start, end, modified, total, sorted by position."""
    rows, out = summary_bed(pileup), []
    for label in ("A", "CG"):
        path = os.path.join(folder, f"{name}_{label}.bed")
        part = rows.where(F.col("label") == label).select("chr", "start", "end", "methylated_bases", "total_bases")
        part.orderBy("chr", "start").write.mode("overwrite").csv(path, sep="\t", header=False)
        out.append(path)
    return out
