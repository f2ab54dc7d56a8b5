"""Filling containers of a fixed capacity with items of varying length: hierarchical residual packing.

Each partition packs its own items by best fit, largest first, in chunks of CHUNK_ITEMS; a chunk goes on with the open bins of the one before.
Bins with little room left are final at once. The others travel up a tree of partitions, FAN_IN to one, as items themselves: every node
packs the underfull bins of its children by best fit again and emits those that are now nearly full. Texts stay where they are, only (bin, fill)
pairs move.

A partition, and a node, passes on its PASSED emptiest bins, so that a node never packs more than FAN_IN * PASSED. Those it keeps back are final
as they are, and that costs no container: best fit leaves at most one bin that is no more than half full, two bins that are more than half full do
not go together, so at a node at most FAN_IN bins find a place in others, and the emptiest PASSED (more than FAN_IN) bins have
room for whatever a fuller one would have room for. No item is ever left out.

An item is split only if it exceeds the capacity alone: into full containers and one rest, which is packed like other items.
Items of size 0 (null and empty texts) take no room and go into the fullest bin that is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calypile.session import checkpointed

CAPACITY = 2048
#: Bins filled to this share are final.
NEARLY_FULL = 0.995
FAN_IN = 8
PASSED = 256
#: Items that one task packs together; more come in further rounds of the same task.
CHUNK_ITEMS = 200_000
_SHIFT = 33  # container ids: partition << 33 | number within it


def best_fit(sizes: np.ndarray, capacity: int, opened: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, fill of each bin) by best fit decreasing; ties go by position. Sizes may not exceed the capacity.

    opened has the fills of bins that are there before. Open bins are found by their room: a bit mask has a bit for each room that occurs,
    so a fit costs one shift.
    """
    where = np.empty(len(sizes), np.int64)
    fills: list[int] = [] if opened is None else opened.tolist()
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, fill in enumerate(fills):
        by_room.setdefault(capacity - fill, []).append(b)
        mask |= 1 << (capacity - fill)
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = by_room[room]
            b = own.pop()
            if not own:
                mask ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        where[i] = b
        fills[b] += size
        by_room.setdefault(room - size, []).append(b)
        mask |= 1 << (room - size)
    return where, np.array(fills, np.int64)


def _split(items: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """One row per piece: item, piece, start, size."""
    n = items["size"].to_numpy(np.int64)
    pieces = np.maximum(-(-n // capacity), 1)
    row = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * capacity
    return pd.DataFrame({"item": items["item"].to_numpy()[row], "piece": piece, "start": start, "size": np.minimum(n[row] - start, capacity)})


def pack(items: DataFrame, item: str, size: str, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """(item, piece, start_token, n_tokens, container_id) of every item; pieces of an item count from 0.

    Null sizes count as 0. Rows with equal item keys are packed as separate items. An empty table gives no rows. The packing of
    the partitions is written to the checkpoint folder, so that ids stay as they are if an executor is lost.
    """
    kind = items.schema[item].dataType.simpleString()
    limit = int(capacity * nearly_full)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The pieces with their bins, and at the end a row of piece -1 for each bin that is passed on, its fill as the size."""
        number, held, rows = TaskContext.get().partitionId() << _SHIFT, [], 0
        bins, fills = np.empty(0, np.int64), np.empty(0, np.int64)

        def packed() -> pd.DataFrame:
            nonlocal number, bins, fills
            pieces = _split(pd.concat(held, ignore_index=True), capacity)
            where, full = best_fit(pieces["size"].to_numpy(), capacity, fills)
            bins = np.append(bins, np.arange(number, number + len(full) - len(bins)))
            number += len(full) - len(fills)
            out = pieces.assign(bin=bins[where])
            left = np.flatnonzero(full < limit)
            left = left[np.argsort(full[left], kind="stable")[:PASSED]]
            bins, fills = bins[left], full[left]
            return out

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= CHUNK_ITEMS:
                yield packed()
                held, rows = [], 0
        if rows:
            yield packed()
        yield pd.DataFrame({"item": pd.Series([None] * len(bins), dtype=object), "piece": -1, "start": 0, "size": fills, "bin": bins})

    plain = items.select(F.col(f"`{item}`").alias("item"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("bigint").alias("size"))
    placed = checkpointed(plain.mapInPandas(local, f"item {kind}, piece bigint, start bigint, size bigint, bin bigint"))
    state = placed.where("piece < 0").select("bin", F.col("bin").alias("box"), F.col("size").alias("fill"), F.lit(False).alias("final"))

    def node(part: pd.DataFrame) -> pd.DataFrame:
        """Underfull boxes of the children as items; a merged box has the id of its fullest member."""
        boxes = part.groupby("box", as_index=False)["fill"].first().sort_values(["fill", "box"], ascending=[False, True], kind="stable")
        where, fills = best_fit(boxes["fill"].to_numpy(), capacity)
        ids = np.empty(len(fills), np.int64)
        ids[where[::-1]] = boxes["box"].to_numpy()[::-1]
        final = fills >= limit
        rest = np.flatnonzero(~final)
        final[rest[np.argsort(fills[rest], kind="stable")[PASSED:]]] = True
        new = pd.DataFrame({"box": boxes["box"].to_numpy(), "new": ids[where], "new_fill": fills[where], "now": final[where]})
        out = part[["bin", "box"]].merge(new, on="box")
        return pd.DataFrame({"bin": out["bin"], "box": out["new"], "fill": out["new_fill"], "final": out["now"]})

    span, done, partitions = FAN_IN, None, placed.rdd.getNumPartitions()
    schema = "bin bigint, box bigint, fill bigint, final boolean"
    while True:
        group = F.floor(F.shiftright("box", _SHIFT) / span)
        state = state.where(~F.col("final")).withColumn("_node", group).groupBy("_node").applyInPandas(node, schema)
        if span >= partitions:
            break
        state = checkpointed(state)
        finished = state.where("final")
        done = finished if done is None else done.unionByName(finished)
        span *= FAN_IN
    moved = (state if done is None else done.unionByName(state)).where("bin <> box").select("bin", "box")
    return placed.where("piece >= 0").join(moved, "bin", "left").select(
        F.col("item").alias(item), F.col("piece").cast("int").alias("piece"), F.col("start").alias("start_token"), F.col("size").alias("n_tokens"), F.coalesce("box", "bin").alias("container_id")
    )


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, n_pieces, used, unused) of every container."""
    return packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("used")).withColumn("unused", F.lit(capacity) - F.col("used"))
