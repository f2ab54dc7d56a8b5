"""SAM text files as a table of reads, parsed by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calypile.functions.reads import reference_length


def _tag(fields: Column, names: str, kind: str) -> Column:
    """The value of the first optional field with one of the names, else null."""
    hits = F.filter(F.slice(fields, F.lit(12), F.lit(1 << 20)), lambda x: x.rlike(f"^({names}):{kind}:"))
    return F.regexp_replace(F.get(hits, F.lit(0)), f"^({names}):{kind}:", "")


def parse_lines(lines: DataFrame, sample: str, line: str = "value") -> DataFrame:
    """Reads of SAM records in one string column; header lines are skipped. Both spellings of the modification tags are read.

    Unmapped reads (flag 4, or reference *) have chr, start and end null; * qualities give a null array.
    """
    c = F.split(F.col(line), "\t")
    at = lambda i: F.get("c", F.lit(i))
    rows = lines.where(~F.col(line).startswith("@") & (F.length(line) > 0)).select(c.alias("c"), F.monotonically_increasing_id().alias("read_idx"))
    flag = at(1).cast("int")
    mapped = (flag.bitwiseAND(F.lit(4)) == 0) & (at(2) != "*")
    cigar = F.nullif(at(5), F.lit("*"))
    start = F.when(mapped, at(3).cast("bigint") - 1)
    quals = F.when(at(10) != "*", F.transform(F.split(at(10), ""), lambda q: F.ascii(q) - 33))
    ml = F.transform(F.filter(F.split(F.regexp_replace(_tag(F.col("c"), "Ml|ML", "B"), "^[cCsSiIf],?", ""), ","), lambda x: x != ""), lambda x: x.cast("int"))
    return rows.select(
        F.lit(sample).alias("sample"), "read_idx", at(0).alias("name"), flag.alias("flag"), F.when(mapped, at(2)).alias("chr"), start.alias("start"), F.when(mapped, start + reference_length(cigar)).alias("end"),
        at(4).cast("int").alias("mapq"), cigar.alias("cigar"), F.nullif(at(9), F.lit("*")).alias("seq"), F.filter(quals, lambda q: q >= 0).alias("quals"), _tag(F.col("c"), "Mm|MM", "Z").alias("mm"), ml.alias("ml"),
    )


def read_sam(spark: SparkSession, path: str, sample: str) -> DataFrame:
    return parse_lines(spark.read.text(path), sample)
