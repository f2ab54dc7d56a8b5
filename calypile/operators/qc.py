"""Read quality statistics: quantiles, outlier-free histograms, N50, totals and the summary table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calypile.functions.reads import aligned_quals, mean_phred, query_length
from calypile.operators.skew import WEIGHT, compress, order_bucket, percentiles, same

METRICS = ("length", "mapq", "ave_baseq", "ave_alignq")
BINS = 200
#: Groups up to this many have their bounds broadcast (four rows of about 50 bytes each).
FEW_GROUPS = 20_000


def usable(name: str) -> Column:
    """The column as double; NaN and infinite values are null."""
    x = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def qc_rows(reads: DataFrame, primary_only: bool = False) -> DataFrame:
    """The QC table of reads with qualities: unmapped reads included, repeated names kept."""
    if primary_only:
        reads = reads.where(F.col("flag").bitwiseAND(F.lit(0x900)) == 0)
    strand = F.when(F.col("flag").bitwiseAND(F.lit(16)) != 0, "-").otherwise("+")
    length = F.coalesce(F.when(F.col("seq") != "*", F.length("seq")), query_length(F.col("cigar")), F.lit(0)).cast("bigint")
    return reads.select("sample", "name", "chr", "start", "end", length.alias("length"), strand.alias("strand"), "mapq", mean_phred(F.col("quals")).alias("ave_baseq"), mean_phred(aligned_quals(F.col("quals"), F.coalesce("cigar", F.lit("")))).alias("ave_alignq"))


def long_metrics(rows: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(keys, metric, x): one row per usable value; a metric without any has no row, and so drops out of every report."""
    return rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), usable(m).alias("x")) for m in metrics])).alias("v")).select(*keys, "v.*").where("x is not null")


def _weighted(rows: DataFrame, keys: list[str], metrics: tuple[str, ...]) -> DataFrame:
    return compress(long_metrics(rows, keys, metrics), [*keys, "metric"], ["x"])


def summary(rows: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Min, 25 %, median, 75 %, max and mean of each metric, and its number of values; exact, from values counted by frequency.

    Percentiles are interpolated between the two nearest values. No task holds all values of a sample.
    """
    own = [*keys, "metric"]
    weighted = _weighted(rows, keys, metrics)
    agg = weighted.groupBy(*own).agg(F.sum(WEIGHT).alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), (F.sum(F.col("x") * F.col(WEIGHT)) / F.sum(WEIGHT)).alias("mean"))
    found = percentiles(weighted, own, "x", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return agg.alias("a").join(found.alias("b"), same("a", "b", own)).select(*[F.col(f"a.{k}").alias(k) for k in own], "n", "min", "q1", "median", "q3", "max", "mean")


def summary_table(rows: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(keys, metric, statistic, value): the printed table, values rounded half to even."""
    named = [("Min", "min"), ("25%", "q1"), ("Median", "median"), ("75%", "q3"), ("Max", "max"), ("Mean", "mean")]
    entry = F.explode(F.array(*[F.struct(F.lit(label).alias("statistic"), F.bround(c).cast("bigint").alias("value")) for label, c in named])).alias("e")
    return summary(rows, keys, metrics).select(*keys, "metric", entry).select(*keys, "metric", "e.*")


def histogram(rows: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS, bins: int = BINS, few: bool | None = None) -> DataFrame:
    """Density over equal bins of the values up to q3 + 3 * (q3 - q1); the last bin is closed. A metric of one value has one bin of width 1.

    All steps work on values counted by frequency. The bounds, a row for each group and metric, are broadcast if there are at most FEW_GROUPS groups
    (few None has them counted), and joined by a shuffle of the counted values else.
    """
    own = [*keys, "metric"]
    if few is None:
        few = rows.select(*keys).distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    bound = lambda df: (F.broadcast(df) if few else df).alias("b")
    weighted = _weighted(rows, keys, metrics)
    cuts = percentiles(weighted, own, "x", {"_q1": 0.25, "_q3": 0.75}).select(*own, (F.col("_q3") + 3 * (F.col("_q3") - F.col("_q1"))).alias("_cut"))
    kept = weighted.alias("a").join(bound(cuts), same("a", "b", own)).where("x <= _cut").select("a.*")
    span = kept.groupBy(*own).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(WEIGHT).alias("n"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    placed = kept.alias("a").join(bound(span), same("a", "b", own)).where("x <= hi").select("a.*", at.alias("bin"), "lo", width.alias("width"), "n")
    counts = placed.groupBy(*own, "bin", "lo", "width", "n").agg(F.sum(WEIGHT).alias("count"))
    return counts.select(*own, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"), "width", "count", (F.col("count") / (F.col("n") * F.col("width"))).alias("density"))


def n50(rows: DataFrame, keys: list[str], length: str = "length") -> DataFrame:
    """The longest length at which the lengths from the longest down add up to more than half of all; null lengths do not count.

    Lengths are counted by value, summed over ordered buckets (64 a power of two), and only the bucket that holds the half is looked into.
    """
    own = [F.col(f"`{k}`") for k in keys]
    x = F.col(f"`{length}`").cast("bigint")
    by = rows.where(x.isNotNull()).groupBy(*own, x.alias("_x")).agg(F.sum(x).alias("_s")).withColumn("_b", order_bucket(F.col("_x")))
    every = Window.partitionBy(*own)
    sums = by.groupBy(*own, "_b").agg(F.sum("_s").alias("_bs")).withColumn("_all", F.sum("_bs").over(every)).withColumn("_cum", F.sum("_bs").over(every.orderBy(F.desc("_b"))))
    hit = sums.where("2 * _cum > _all and 2 * (_cum - _bs) <= _all").select(*own, "_b", (F.col("_cum") - F.col("_bs")).alias("_from"), "_all")
    inside = by.alias("a").join(hit.alias("b"), same("a", "b", [*keys, "_b"])).select("a.*", "_from", "_all").withColumn("_c", F.col("_from") + F.sum("_s").over(Window.partitionBy(*own).orderBy(F.desc("_x"))))
    return inside.where("2 * _c > _all").groupBy(*own).agg(F.max("_x").alias("n50"))


def totals(rows: DataFrame, keys: list[str], length: str = "length") -> DataFrame:
    """Reads, the printed number of bases (rounded mean times reads) and the exact sum."""
    n, mean = F.count(F.lit(1)), F.bround(F.avg(f"`{length}`")).cast("bigint")
    return rows.groupBy(*keys).agg(n.alias("n_reads"), mean.alias("mean_length"), (mean * n).alias("n_bases"), F.sum(F.col(f"`{length}`").cast("bigint")).alias("n_bases_exact"))
