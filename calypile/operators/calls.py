"""Modification calls and what is made of them: pileup, fractions, bins, smoothing, axes, extents and layers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calypile.functions.reads import mod_family, mod_label
from calypile.operators.intervals import periods
from calypile.operators.regions import overlap_join

THRESHOLD = 129
LAYERS = 1000
#: Rows of one window task, and positions of one tile in which rows are numbered.
BLOCK_ROWS, TILE_BITS = 1 << 16, 16
#: Reads whose rows are broadcast (some 60 bytes each).
FEW_READS = 1 << 18


def modified(prob: Column, threshold: int = THRESHOLD) -> Column:
    """Whether a call counts as modified: prob >= threshold; a missing prob does not."""
    return F.coalesce(prob >= threshold, F.lit(False))


def first_per_id(calls: DataFrame, order: list[str], keys: tuple[str, ...] = ("sample", "id")) -> DataFrame:
    """The first row of each id by the given order, which must be total; rows with a null id all stay.

    One scan: rows with a null id are spread by their order, so that they are not one group.
    """
    none = F.col(keys[-1]).isNull()
    w = Window.partitionBy(*keys, F.when(none, F.xxhash64(*order))).orderBy(*order)
    return calls.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | none).drop("_n")


def pileup(sites: DataFrame, keys: list[str], threshold: int = THRESHOLD, flag: str | None = None) -> DataFrame:
    """Modified and all bases of each keys (position and mod among them); flag names a boolean column that replaces prob >= threshold."""
    hit = F.col(flag) if flag else modified(F.col("prob"), threshold)
    return sites.groupBy(*keys).agg(F.sum(hit.cast("bigint")).alias("methylated_bases"), F.count(F.lit(1)).alias("total_bases"))


def merge_pileups(*parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial pileups added up: an incremental load only reads its own rows and the stored counters."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(*keys).agg(F.sum("methylated_bases").alias("methylated_bases"), F.sum("total_bases").alias("total_bases"))


def fraction(methylated: Column, total: Column) -> Column:
    """methylated / total; null where total is 0 or missing."""
    return F.try_divide(methylated.cast("double"), total.cast("double"))


def enrichment(sites: DataFrame, groups: DataFrame, keys: list[str], threshold: int = THRESHOLD) -> DataFrame:
    """Fraction modified of each row of groups (unique by keys): sum / sum, and 0 where there are no sites."""
    sums = pileup(sites, keys, threshold)
    m, t = F.coalesce("methylated_bases", F.lit(0)), F.coalesce("total_bases", F.lit(0))
    return groups.select(*keys).distinct().join(sums, keys, "left").select(*keys, m.alias("methylated_bases"), t.alias("total_bases"), F.coalesce(fraction(m, t), F.lit(0.0)).alias("fraction"))


def bins(piled: DataFrame, keys: list[str], width: int = 100) -> DataFrame:
    """Sums and fraction in bins of width positions; 0 where a bin's total is 0."""
    start = (F.floor(F.col("pos") / width) * width).cast("bigint")
    sums = piled.groupBy(*keys, start.alias("bin_start")).agg(F.sum("methylated_bases").alias("methylated_bases"), F.sum("total_bases").alias("total_bases"))
    return sums.withColumn("fraction", F.coalesce(fraction(F.col("methylated_bases"), F.col("total_bases")), F.lit(0.0)))


def windows(piled: DataFrame, contigs: DataFrame, keys: list[str], width: int = 100, chr_: str = "chr", length: str = "length_bp") -> DataFrame:
    """bins() with every window of every contig for each keys (chr not among them), sums and fraction 0 where there are no rows.

    The axis is made in two steps, so that no row holds all windows of a contig.
    """
    step = width << TILE_BITS
    whole = contigs.where(F.col(length) > 0).select(F.col(chr_).alias("chr"), F.col(length).cast("bigint").alias("_to"))
    every = whole.agg(F.collect_list(F.struct("chr", "_to"))).scalar()  # a genome's contigs, a few hundred to some hundred thousand
    own = [*keys, "chr"]
    grid = piled.select(*keys).distinct().select(*keys, F.explode(every).alias("_c")).select(*keys, "_c.*")
    tiles = grid.select(*own, "_to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_to") - 1, F.lit(step).cast("bigint"))).alias("_t"))
    grid = tiles.select(*own, F.explode(F.sequence("_t", F.least(F.col("_t") + step, F.col("_to")) - 1, F.lit(width).cast("bigint"))).alias("bin_start"))
    got = bins(piled, own, width).alias("b")
    same = F.col("a.bin_start") == F.col("b.bin_start")
    for k in own:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    zero = [F.coalesce(f"b.{c}", F.lit(0)).alias(c) for c in ("methylated_bases", "total_bases")]
    return grid.alias("a").join(got, same, "left").select("a.*", *zero, F.coalesce("b.fraction", F.lit(0.0)).alias("fraction"))


def at_heights(calls: DataFrame, laid: DataFrame, keys: list[str]) -> DataFrame:
    """Calls with the layer of their read; those of reads without a layer drop out."""
    return calls.join(laid.where("height is not null").select(*keys, "read_name", "height"), [*keys, "read_name"])


def segments(laid: DataFrame, keys: list[str]) -> DataFrame:
    """The line of each read that has a layer: (keys, read_name, x0, x1, height)."""
    return laid.where("height is not null").select(*keys, "read_name", F.col("posmin").alias("x0"), F.col("posmax").alias("x1"), "height")


def summary_bed(piled: DataFrame) -> DataFrame:
    """The rows of a summary BED: chr, start, end = start + 1, modified, total, and the mod's display name."""
    return piled.select("chr", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "methylated_bases", "total_bases", mod_label(F.col("mod")).alias("label"))


def numbered(df: DataFrame, keys: list[str], order: str, ties: list[str] | None = None, bits: int = TILE_BITS) -> DataFrame:
    """df with _rn, the row number from 0 within keys by order (an integer) and ties.

    Rows are numbered in tiles of positions; only the tiles' counts are summed over a key, so a hot key is many tasks.
    """
    tiled = df.withColumn("_tile", F.shiftright(F.col(order).cast("bigint"), bits))
    counts = tiled.groupBy(*keys, "_tile").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_tile")) - F.col("_c")).drop("_c")
    match = F.lit(True)
    for k in [*keys, "_tile"]:
        match = match & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = tiled.alias("a").join(before.alias("b"), match).select("a.*", "b._before")
    w = Window.partitionBy(*keys, "_tile").orderBy(order, *(ties or []))
    return joined.withColumn("_rn", F.col("_before") + F.row_number().over(w) - 1).drop("_before", "_tile")


def rolling(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], window: int, min_periods: int, ties: list[str] | None = None, block: int | None = None) -> DataFrame:
    """Centred rolling means over window rows (not positions) of each keys, null below min_periods values.

    An even window has one row more before than after. Rows go to blocks of consecutive row numbers, those near a border to both
    blocks, so each window is computed inside one block and a hot key is spread over its blocks.
    """
    before, after = window // 2, (window - 1) // 2
    size = block or max(BLOCK_ROWS, 8 * window)
    rn, own = F.col("_rn"), F.floor(F.col("_rn") / size)
    rows = numbered(df, keys, order, ties).withColumn("_own", own)
    near = F.array_distinct(F.array(own, F.floor((rn + before) / size), F.floor(F.greatest(rn - after, F.lit(0)) / size)))
    spread = rows.withColumn("_block", F.explode(near))
    w = Window.partitionBy(*keys, "_block").orderBy("_rn").rowsBetween(-before, after)
    for name, value in values.items():
        spread = spread.withColumn(name, F.when(F.count(value).over(w) >= min_periods, F.avg(value).over(w)))
    return spread.where("_block = _own").drop("_block", "_own", "_rn")


def smoothed(piled: DataFrame, keys: list[str], order: str = "pos", window: int = 1000, min_periods: int = 100, block: int | None = None) -> DataFrame:
    """Rolling means of methylated_bases, total_bases and their fraction, per keys and mod family."""
    fam = piled.withColumn("family", mod_family(F.col("mod"))).where(F.col("family").isNotNull())
    values = {
        "rolling_methylated": F.col("methylated_bases").cast("double"),
        "rolling_total": F.col("total_bases").cast("double"),
        "rolling_fraction": fraction(F.col("methylated_bases"), F.col("total_bases")),
    }
    return rolling(fam, [*keys, "family"], order, values, window, min_periods, ["mod"], block)


def curve(smooth: DataFrame, keys: list[str], value: str, order: str = "pos") -> DataFrame:
    """One point per position of a drawn line: the mean where mods share a position."""
    return smooth.groupBy(*keys, "family", order).agg(F.avg(value).alias(value))


def dense_axis(piled: DataFrame, keys: list[str], value: str, order: str = "pos") -> DataFrame:
    """Every position from each keys' first up to, but without, its last, with the value summed there and 0 where there is none."""
    spans = piled.groupBy(*keys).agg(F.min(order).alias("_a"), F.max(order).alias("_b")).where("_a < _b")
    step = 1 << TILE_BITS  # in two steps, so that no row holds the whole axis
    tiles = spans.select(*keys, "_b", F.explode(F.sequence("_a", F.col("_b") - 1, F.lit(step).cast("bigint"))).alias("_t"))
    axis = tiles.select(*keys, F.explode(F.sequence("_t", F.least(F.col("_t") + step - 1, F.col("_b") - 1))).alias(order))
    sums = piled.groupBy(*keys, order).agg(F.sum(value).alias(value))
    return axis.join(sums, [*keys, order], "left").select(*keys, order, F.coalesce(value, F.lit(0)).alias(value))


def extents(calls: DataFrame, keys: list[str]) -> DataFrame:
    """First and last called position of each read, in one aggregation."""
    return calls.where(F.col("read_name").isNotNull() & F.col("pos").isNotNull()).groupBy(*keys, "read_name").agg(F.min("pos").alias("posmin"), F.max("pos").alias("posmax"))


def layers(read_extents: DataFrame, keys: list[str], limit: int = LAYERS) -> DataFrame:
    """read_extents with height, the layer of each read by first fit over posmin, then the longer read, then its name.

    Reads that find no free layer have height null. The greedy choice starts anew wherever no read covers a position, so each
    continuous covered period is laid out by itself, in parallel.
    """
    wide = read_extents.withColumn("_end", F.col("posmax") + 1)
    islands = periods(wide, keys, "posmin", "_end", "_from", "_to")
    inside = overlap_join(wide, islands, "posmin", "_end", "_from", "_to", tuple(keys), few=False).drop("_end", "_to")

    names = [*keys, "_from"]

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows come sorted by period and then in layout order, so that all a task keeps is the ends of the layers."""
        at, last, used = None, np.empty(0, np.int64), 0
        for batch in batches:
            heights = []
            for key, a, b in zip(zip(*(batch[n] for n in names), strict=True), batch["posmin"].tolist(), batch["posmax"].tolist(), strict=True):
                if key != at:
                    at, last, used = key, np.empty(limit, np.int64), 0
                free = np.flatnonzero(last[:used] < a)
                k = int(free[0]) if len(free) else used if used < limit else -1
                if k >= 0:
                    used = max(used, k + 1)
                    last[k] = b
                heights.append(k + 1 if k >= 0 else None)
            yield batch.drop(columns="_from").assign(height=pd.array(heights, dtype="Int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read_extents.schema) + ", height bigint"
    rows = inside.select(*read_extents.columns, "_from").repartition(*names)
    return rows.sortWithinPartitions(*names, "posmin", F.desc("posmax"), "read_name").mapInPandas(lay, schema)


def hidden_reads(laid: DataFrame, keys: list[str]) -> DataFrame:
    """Reads of each keys that no layer could take."""
    return laid.groupBy(*keys).agg(F.count(F.when(F.col("height").isNull(), 1)).alias("n_hidden"))


def probability_range(calls: DataFrame, keys: list[str], threshold: int = THRESHOLD) -> DataFrame:
    """Least and greatest probability of each mod family at or above the threshold, over all samples together."""
    fam = calls.withColumn("family", mod_family(F.col("mod"))).where(F.col("family").isNotNull() & (F.col("prob") >= threshold))
    return fam.groupBy(*keys, "family").agg(F.min("prob").alias("prob_min"), F.max("prob").alias("prob_max"))


def points(calls: DataFrame, keys: list[str], order: str = "pos", few: bool = False) -> DataFrame:
    """Single-molecule points: position, read, mod family, and the read's row number by its first position and name.

    few: the reads are at most FEW_READS, so that their rows are broadcast and the calls, many to a read, are not shuffled.
    """
    reads = calls.where(F.col("read_name").isNotNull()).groupBy(*keys, "read_name").agg(F.min(order).alias("_first"))
    rows = numbered(reads, keys, "_first", ["read_name"]).withColumn("read_row", F.col("_rn")).drop("_rn", "_first")
    return calls.join(F.broadcast(rows) if few else rows, [*keys, "read_name"]).select(*keys, "read_name", "read_row", order, "mod", mod_family(F.col("mod")).alias("family"))
