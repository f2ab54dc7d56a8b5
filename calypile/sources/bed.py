"""BED files: tab-separated intervals without a header."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calypile.operators.regions import strand_or_plus


def _columns(spark: SparkSession, path: str) -> DataFrame:
    """The file's fields as an array; comment, track and blank lines are skipped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track\b|browser\b|\s*$)"))
    return lines.select(F.split("value", "\t").alias("c"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def read_regions(spark: SparkSession, path: str, bed_id: str | None = None) -> DataFrame:
    """Regions of a BED file: columns 1 to 3, and column 4 as the strand if it is + or - (else +); others are ignored.

    region_idx numbers the rows in file order within a file split, and rises with the splits.
    """
    name = bed_id or basename(path)
    c = _columns(spark, path).withColumn("region_idx", F.monotonically_increasing_id())
    at = lambda i: F.get("c", F.lit(i))
    return c.select(F.lit(name).alias("bed_id"), "region_idx", at(0).alias("chr"), at(1).cast("bigint").alias("begin_pos"), at(2).cast("bigint").alias("end_pos"), strand_or_plus(F.trim(at(3))).alias("strand"))


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Annotation features: chr, begin_pos, end_pos, name (noname if missing)."""
    at = lambda i: F.get("c", F.lit(i))
    return _columns(spark, path).select(at(0).alias("chr"), at(1).cast("bigint").alias("begin_pos"), at(2).cast("bigint").alias("end_pos"), F.coalesce(F.nullif(at(3), F.lit("")), F.lit("noname")).alias("name"))


def basename(path: str) -> str:
    """A file's name without folder and without .bam, .sam or .bed."""
    name = os.path.basename(path.rstrip("/"))
    for end in (".bam", ".sam", ".bed"):
        name = name.removesuffix(end)
    return name
