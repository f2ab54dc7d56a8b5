"""Genomic regions: literals, strands, centres, and the interval join with reads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calypile.schemas import REGIONS

#: Regions up to this many are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 50_000
BIN_BITS = 16
_LITERAL = re.compile(r"([^:]+):(\d+)-(\d+)")


def parse_region(text: str) -> tuple[str, int, int]:
    """(chr, begin, end) of "chr:begin-end"; commas in numbers are allowed, chr stays a string. TypeError if malformed."""
    if not isinstance(text, str):
        raise TypeError(f"a region is a string, not {type(text).__name__}")
    m = _LITERAL.fullmatch(text.replace(",", "").strip())
    if not m:
        raise TypeError(f"invalid region {text!r}: write chr:begin-end")
    return m[1], int(m[2]), int(m[3])


def parse_region_column(text: Column) -> Column:
    """struct<chr, begin_pos, end_pos, label> of a column of literals; null fields where malformed."""
    bare, pattern = F.regexp_replace(text, ",", ""), r"^([^:]+):([0-9]+)-([0-9]+)$"
    part = lambda k: F.nullif(F.regexp_extract(bare, pattern, k), F.lit(""))
    begin, end = part(2).cast("bigint"), part(3).cast("bigint")
    return F.struct(part(1).alias("chr"), begin.alias("begin_pos"), end.alias("end_pos"), region_label(part(1), begin, end).alias("label"))


def region_label(chr_: Column, begin: Column, end: Column) -> Column:
    """chr_begin_end."""
    return F.concat(chr_, F.lit("_"), begin.cast("string"), F.lit("_"), end.cast("string"))


def strand_or_plus(strand: Column) -> Column:
    """+ or -; anything else, null included, is +."""
    return F.when(strand.isin("+", "-"), strand).otherwise("+")


def center(begin: Column, end: Column) -> Column:
    """The middle of a region, half to even."""
    return F.bround((end - begin) / F.lit(2.0) + begin).cast("bigint")


def centered(pos: Column, begin: Column, end: Column, strand: Column) -> Column:
    """Position relative to the region's centre, reversed for regions on the - strand."""
    return F.when(strand_or_plus(strand) == "-", -1).otherwise(1) * (pos - center(begin, end))


def one_region(spark: SparkSession, text: str, bed_id: str = "region") -> DataFrame:
    chr_, begin, end = parse_region(text)
    return spark.createDataFrame([(bed_id, 0, chr_, begin, end, "+")], REGIONS)


def overlap_join(reads: DataFrame, regions: DataFrame, start: str = "start", end: str | None = "end", begin_pos: str = "begin_pos", end_pos: str = "end_pos", on: tuple[str, ...] = ("chr",), few: bool | None = None) -> DataFrame:
    """Every pair of a read [start, end) and a region [begin_pos, end_pos) that overlap on the same chr; inner, many to many.

    The columns on come once, the others must have different names. Rows with null or empty intervals join nothing. With end None
    reads are single positions. Both sides meet in bins of 2**BIN_BITS positions, a pair in the bin that holds the later of the two
    starts, so that it comes out once and a read is compared with the regions near it only. Few regions (BROADCAST_ROWS rows, a region once
    for each of its bins) are broadcast, and the reads are not shuffled; few None has them counted, up to that limit.
    """
    s, b, f = F.col(f"`{start}`"), F.col(f"`{begin_pos}`"), F.col(f"`{end_pos}`")
    e = s + 1 if end is None else F.col(f"`{end}`")
    bins = lambda lo, hi: F.explode(F.sequence(F.shiftright(lo, BIN_BITS), F.shiftright(hi - 1, BIN_BITS)))
    cut = regions.where(b < f).withColumn("_bin", bins(b, f))
    if few is None:
        few = cut.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = reads.where(s.isNotNull()).withColumn("_bin", F.shiftright(s, BIN_BITS)) if end is None else reads.where(s < e).withColumn("_bin", bins(s, e))
    both = rows.join(F.broadcast(cut) if few else cut, [*on, "_bin"])
    return both.where((s < f) & (e > b) & (F.col("_bin") == F.shiftright(F.greatest(s, b), BIN_BITS))).drop("_bin")


def in_window(calls: DataFrame, regions: DataFrame, few: bool | None = None) -> DataFrame:
    """Calls strictly inside a region: begin_pos < pos < end_pos, both excluded; a call in several regions comes once for each."""
    return overlap_join(calls, regions, "pos", None, few=few).where(F.col("pos") > F.col("begin_pos"))


def around_center(calls: DataFrame, regions: DataFrame, window: int, few: bool | None = None) -> DataFrame:
    """Calls at most window from a region's centre, with rel_pos: oriented by strand, both bounds included."""
    wide = regions.where("begin_pos < end_pos").withColumn("_c", center(F.col("begin_pos"), F.col("end_pos"))).withColumn("_b", F.col("_c") - window).withColumn("_f", F.col("_c") + window + 1)
    joined = overlap_join(calls, wide, "pos", None, "_b", "_f", few=few)
    return joined.withColumn("rel_pos", F.when(strand_or_plus(F.col("strand")) == "-", -1).otherwise(1) * (F.col("pos") - F.col("_c"))).drop("_b", "_f", "_c")


def annotations(bed: DataFrame, chr_: str, begin: int, end: int) -> DataFrame:
    """Features of a BED table that overlap one region, with the name noname where it is missing."""
    named = bed.withColumn("name", F.coalesce("name", F.lit("noname"))) if "name" in bed.columns else bed.withColumn("name", F.lit("noname"))
    return named.where((F.col("chr") == chr_) & (F.col("begin_pos") < end) & (F.col("end_pos") > begin))
