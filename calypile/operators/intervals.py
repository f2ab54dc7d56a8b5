"""Continuous covered periods, and the gaps between them, of overlapping, nested and touching intervals.

Integer intervals are cut at tile borders and decomposed into canonical dyadic blocks. A block with an ancestor in the
set is dropped, sibling pairs are merged upward, and what is left is coalesced into runs. The union of intervals is
idempotent and associative, so each input partition reduces its rows to runs before anything is shuffled: a hot key ships
no more than the distinct runs of its tiles, however many rows it has, and one tile never holds more than 2**(bits-1) runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE_BITS = 20
#: Rows gathered in a task before they are reduced to runs.
CHUNK_ROWS = 400_000


def dyadic_blocks(lo: np.ndarray, hi: np.ndarray, top: int) -> list[np.ndarray]:
    """Sorted, distinct block numbers of each level 0..top: block i of level l is [i << l, (i + 1) << l).

    No interval may cross a multiple of 1 << top.
    """
    lo, hi = lo.astype(np.int64), hi.astype(np.int64)
    keep = lo < hi
    lo, hi, levels = lo[keep], hi[keep], []
    for level in range(top + 1):
        if level == top:
            levels.append(np.unique(lo))
            break
        left, right = (lo & 1) == 1, (hi & 1) == 1
        levels.append(np.unique(np.concatenate([lo[left], hi[right] - 1])))
        lo, hi = (lo + left) >> 1, (hi - right) >> 1
        keep = lo < hi
        lo, hi = lo[keep], hi[keep]
    return levels


def _within(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array among."""
    if not len(among) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    return among[np.minimum(at, len(among) - 1)] == values


def without_descendants(levels: list[np.ndarray]) -> list[np.ndarray]:
    """The blocks that have no ancestor in the set."""
    kept: list[np.ndarray] = [np.empty(0, np.int64)] * len(levels)
    for level in range(len(levels) - 1, -1, -1):
        own = levels[level]
        covered = np.zeros(len(own), bool)
        for up in range(level + 1, len(levels)):
            if len(kept[up]):
                covered |= _within(own >> (up - level), kept[up])
        kept[level] = own[~covered]
    return kept


def merge_siblings(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Pairs of sibling blocks replaced by their parent, from the lowest level up."""
    out, carried = [], np.empty(0, np.int64)
    for level, own in enumerate(levels):
        own = np.unique(np.concatenate([own, carried]))
        if level == len(levels) - 1:
            out.append(own)
            break
        even = own[(own & 1) == 0]
        pairs = even[_within(even + 1, own)]
        carried = pairs >> 1
        out.append(own[~_within(own & ~np.int64(1), pairs)])
    return out


def union_runs(lo: np.ndarray, hi: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted disjoint runs covering what [lo, hi) cover; runs are not joined across multiples of 1 << top."""
    levels = merge_siblings(without_descendants(dyadic_blocks(lo, hi, top)))
    starts = np.concatenate([own << level for level, own in enumerate(levels)])
    ends = np.concatenate([(own + 1) << level for level, own in enumerate(levels)])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    if not len(starts):
        return starts, ends
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != ends[:-1]) | ((starts[1:] & ((1 << top) - 1)) == 0)
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def _reduce(table: pd.DataFrame, keys: list[str], bits: int) -> pd.DataFrame:
    """Runs of every (keys, tile) in table; columns lo, hi hold absolute positions."""
    group = np.zeros(len(table), np.int64)
    for name in [*keys, "tile"]:
        codes, seen = pd.factorize(table[name], use_na_sentinel=True)
        group = np.unique(group * (len(seen) + 1) + codes + 1, return_inverse=True)[1].astype(np.int64)
    base = table["tile"].to_numpy(np.int64) << bits
    at = group << bits
    starts, ends = union_runs(at + table["lo"].to_numpy(np.int64) - base, at + table["hi"].to_numpy(np.int64) - base, bits)
    sample = np.zeros(int(group.max()) + 1, np.int64)
    sample[group] = np.arange(len(table))
    owner = starts >> bits
    out = table[[*keys, "tile"]].iloc[sample[owner]].reset_index(drop=True)
    shift = (out["tile"].to_numpy(np.int64) - owner) << bits
    return out.assign(lo=starts + shift, hi=ends + shift)


def tile_runs(df: DataFrame, keys: list[str], start: str, end: str, bits: int = TILE_BITS) -> DataFrame:
    """One row per (keys, tile): the sorted disjoint runs of that tile as two arrays, starts and ends.

    Rows whose start or end is null, or with start >= end, cover nothing. Null keys form a group of their own. Positions
    are bigint; a row is split into one piece per tile of 2**bits positions it touches.
    """
    schema = df.schema
    lo, hi = F.col(f"`{start}`").cast("bigint"), F.col(f"`{end}`").cast("bigint")
    names = [f"k{i}" for i in range(len(keys))]
    pieces = (
        df.where(lo < hi)
        .select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], lo.alias("s"), hi.alias("e"))
        .withColumn("tile", F.explode(F.sequence(F.shiftright("s", bits), F.shiftright(F.col("e") - 1, bits))))
        .select(
            *names,
            "tile",
            F.greatest("s", F.shiftleft("tile", bits)).alias("lo"),
            F.least("e", F.shiftleft(F.col("tile") + 1, bits)).alias("hi"),
        )
    )

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows, limit = 0, CHUNK_ROWS
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= limit:
                held = [_reduce(pd.concat(held, ignore_index=True), names, bits)]
                rows = len(held[0])
                if rows > CHUNK_ROWS // 2:  # little to merge in this partition: pass it on
                    yield held[0]
                    held, rows = [], 0
        if rows:
            yield _reduce(pd.concat(held, ignore_index=True), names, bits)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The input is sorted by keys and tile, so only the last tile of a batch may go on in the next one."""
        carry: pd.DataFrame | None = None

        def lists(runs: pd.DataFrame) -> pa.RecordBatch:
            new = np.ones(len(runs), bool)
            for n in [*names, "tile"]:
                codes = pd.factorize(runs[n])[0]
                new[1:] &= codes[1:] == codes[:-1]
            new[1:] = ~new[1:]
            first = np.flatnonzero(new)
            offsets = pa.array(np.append(first, len(runs)).astype(np.int32))
            head = runs.iloc[first]
            cols = [pa.array(head[n], from_pandas=True, type=t) for n, t in zip([*names, "tile"], types, strict=True)]
            return pa.RecordBatch.from_arrays(
                [*cols, pa.ListArray.from_arrays(offsets, pa.array(runs["lo"].to_numpy())), pa.ListArray.from_arrays(offsets, pa.array(runs["hi"].to_numpy()))],
                names=[*names, "tile", "starts", "ends"],
            )

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(n).type for n in [*names, "tile"]]
            part = batch.to_pandas()
            if not len(part):
                continue
            part = part if carry is None else pd.concat([carry, part], ignore_index=True)
            runs = _sorted(_reduce(part, names, bits), part, names)
            last = np.ones(len(runs), bool)
            for n in [*names, "tile"]:
                value = runs[n].iloc[-1]
                last &= (runs[n].isna() if pd.isna(value) else runs[n] == value).to_numpy()
            carry, done = runs[last], runs[~last]
            if len(done):
                yield lists(done)
        if carry is not None and len(carry):
            yield lists(carry.reset_index(drop=True))

    kinds = [T.StructField(n, schema[k].dataType) for n, k in zip(names, keys, strict=True)] + [T.StructField("tile", T.LongType())]
    flat = T.StructType([*kinds, T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
    listed = T.StructType([*kinds, T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType()))])
    runs = pieces.mapInPandas(combine, flat)
    return (
        runs.repartition(*names, "tile")
        .sortWithinPartitions(*names, "tile")
        .mapInArrow(arrays, listed)
        .select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "tile", "starts", "ends")
    )


def _sorted(runs: pd.DataFrame, source: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """runs in the order in which their groups come in source, positions ascending."""
    seen = source[[*names, "tile"]].drop_duplicates()
    seen = seen.assign(_at=np.arange(len(seen)))
    return runs.merge(seen, on=[*names, "tile"], how="left").sort_values(["_at", "lo"], kind="stable").drop(columns="_at").reset_index(drop=True)


def _outer(runs: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The gaps between tiles: at most one row per (keys, tile), so the window stays small for a key of any size."""
    spans = runs.select(*[F.col(f"`{k}`") for k in keys], "tile", F.element_at("starts", 1).alias("_first"), F.element_at("ends", -1).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy("tile"))
    return spans.withColumn("_before", before).where(F.col("_before") < F.col("_first")).select(*[F.col(f"`{k}`") for k in keys], F.col("_before").alias(start), F.col("_first").alias(end))


def gaps(df: DataFrame, keys: list[str], start: str, end: str, gap_start: str = "gap_start", gap_end: str = "gap_end", bits: int = TILE_BITS) -> DataFrame:
    """Maximal non-empty uncovered stretches [gap_start, gap_end) with covered positions of the same keys on both sides.

    Touching intervals leave no gap. A key with one continuous period gives no row; an empty table gives none.
    """
    runs = tile_runs(df, keys, start, end, bits)
    n = F.size("starts")
    inner = (
        runs.where(n > 1)
        .select(*[F.col(f"`{k}`") for k in keys], F.explode(F.arrays_zip(F.slice("ends", F.lit(1), n - 1).alias("a"), F.slice("starts", F.lit(2), n - 1).alias("b"))).alias("g"))
        .select(*[F.col(f"`{k}`") for k in keys], F.col("g.a").alias(gap_start), F.col("g.b").alias(gap_end))
    )
    return inner.unionByName(_outer(runs, keys, gap_start, gap_end))


def periods(df: DataFrame, keys: list[str], start: str, end: str, period_start: str = "period_start", period_end: str = "period_end", bits: int = TILE_BITS) -> DataFrame:
    """The continuous covered periods [period_start, period_end) of each key; touching intervals form one period.

    Runs that end inside their tile are final; only runs at a tile's border, two a tile at most, are linked over tiles.
    """
    own = [F.col(f"`{k}`") for k in keys]
    flat = tile_runs(df, keys, start, end, bits).select(*own, "tile", F.explode(F.arrays_zip("starts", "ends")).alias("r")).select(*own, "tile", F.col("r.starts").alias("_s"), F.col("r.ends").alias("_e"))
    border: Column = (F.col("_s") == F.shiftleft("tile", bits)) | (F.col("_e") == F.shiftleft(F.col("tile") + 1, bits))
    w = Window.partitionBy(*own).orderBy("_s")
    linked = (
        flat.where(border)
        .withColumn("_new", F.when(F.lag("_e").over(w) == F.col("_s"), 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(w))
        .groupBy(*own, "_run")
        .agg(F.min("_s").alias(period_start), F.max("_e").alias(period_end))
        .drop("_run")
    )
    return flat.where(~border).select(*own, F.col("_s").alias(period_start), F.col("_e").alias(period_end)).unionByName(linked)
