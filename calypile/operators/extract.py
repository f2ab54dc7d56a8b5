"""Sites of reads inside regions: the scan, join and decode behind every report."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calypile.operators.calls import first_per_id, merge_pileups, pileup
from calypile.operators.decode import BATCH_SITES, bases_of, decode_read
from calypile.operators.regions import overlap_join
from calypile.session import spread, stored

#: What sites() can give, and its type where it is not a column of the reads or regions as they are.
COLUMNS = ("sample", "read_idx", "read_name", "chr", "mod_idx", "mod", "pos", "prob", "called", "methylated", "bed_id", "region_idx", "begin_pos", "end_pos", "strand")
_OWN = {"mod_idx": "int", "mod": "string", "pos": "bigint", "prob": "int", "called": "boolean", "methylated": "boolean"}
_READ = {"sample": "sample", "read_idx": "read_idx", "read_name": "name", "chr": "chr"}
_REGION = ("bed_id", "region_idx", "begin_pos", "end_pos", "strand")
#: The bytes all maps of covered bins may take.
COVER_BYTES = 8 << 20
#: Regions up to this many are broadcast as arrays (some 60 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
#: Pairs of a site and a region that are made at once.
PAIRS = 1 << 20


class Spans:
    """Regions as arrays: begin and end, the window [lo, hi) in which sites count, and centre and sign for relative positions."""

    def __init__(self, begin: np.ndarray, end: np.ndarray, minus: np.ndarray, window: int | None):
        self.begin, self.end = begin, end
        twice = begin + end
        self.mid = (twice >> 1) + (twice & 1 & (twice >> 1))  # half to even
        self.sign = np.where(minus, -1, 1)
        self.lo, self.hi = (begin + 1, end) if window is None else (self.mid - window, self.mid + window + 1)

    def pairs(self, pos: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in pos, region) of each site in the window of one of the regions own; pos ascends."""
        first, last = np.searchsorted(pos, self.lo[own]), np.searchsorted(pos, self.hi[own])
        n = last - first
        return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(own, n)


def _steps(spans: Spans, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions at which it changes, the least of the regions own there; one more value, for what lies before)."""
    own = own[spans.lo[own] < spans.hi[own]]
    own = own[np.argsort(spans.lo[own], kind="stable")]
    breaks = np.unique(np.concatenate([spans.lo[own], spans.hi[own]]))
    least, hi = np.full(len(breaks) + 1, -1), spans.hi
    last = np.searchsorted(spans.lo[own], breaks, "right").tolist()
    held: list[int] = []  # a heap; regions that have ended are left in it until they come up
    at = 0
    for k, b in enumerate(breaks.tolist()):
        for r in own[at : last[k]].tolist():
            heapq.heappush(held, r)
        at = last[k]
        while held and hi[held[0]] <= b:
            heapq.heappop(held)
        if held:
            least[k + 1] = held[0]
    return breaks, least


class Index:
    """The regions of each chr in order of their begin, so that those a read overlaps are found by two binary searches.

    A region's number is its place by bed_id and region_idx, which is the order of processing.
    """

    def __init__(self, table: pa.Table, window: int | None):
        table = table.take(pc.sort_indices(table, [("bed_id", "ascending"), ("region_idx", "ascending")], null_placement="at_start"))
        column = lambda c: table.column(c).to_numpy().astype(np.int64)
        self.spans = Spans(column("begin_pos"), column("end_pos"), np.array([s == "-" for s in table.column("strand").to_pylist()], bool), window)
        self.attributes = {c: table.column(c).combine_chunks() for c in _REGION}
        by_chr: dict[str, list[int]] = {}
        for i, c in enumerate(table.column("chr").to_pylist()):
            by_chr.setdefault(c, []).append(i)
        self.order = {c: np.array(rows)[np.argsort(self.spans.begin[rows], kind="stable")] for c, rows in by_chr.items()}
        self.begins = {c: self.spans.begin[o] for c, o in self.order.items()}
        self.reach = {c: np.maximum.accumulate(self.spans.end[o]) for c, o in self.order.items()}
        self.steps = {c: _steps(self.spans, o) for c, o in self.order.items()} if window is None else {}

    def overlapping(self, chr_: str, start: int, end: int) -> np.ndarray:
        """The numbers of the regions that [start, end) overlaps."""
        order = self.order.get(chr_)
        if order is None:
            return np.empty(0, np.int64)
        near = order[np.searchsorted(self.reach[chr_], start, "right") : np.searchsorted(self.begins[chr_], end)]
        return near[self.spans.end[near] > start]

    def first_inside(self, chr_: str, pos: np.ndarray) -> np.ndarray:
        """The least region that each site is in, -1 if there is none; not for windows around centres."""
        breaks, least = self.steps[chr_]
        return least[np.searchsorted(breaks, pos, "right")]

    def cover(self) -> tuple[int, list[tuple[str, bytearray]]]:
        """(bits, a byte for each 2**bits positions of each chr: 1 where there is a region)."""
        far = {c: max(int(r[-1]), 1) for c, r in self.reach.items()}
        bits = 14
        while sum((e >> bits) + 1 for e in far.values()) > COVER_BYTES:
            bits += 1
        out = []
        for c, o in self.order.items():
            step = np.zeros((far[c] >> bits) + 2, np.int32)
            np.add.at(step, np.maximum(self.spans.begin[o], 0) >> bits, 1)
            np.add.at(step, (np.maximum(self.spans.end[o] - 1, 0) >> bits) + 1, -1)
            out.append((c, bytearray((np.cumsum(step) > 0).astype(np.uint8))))
        return bits, out


def _near(reads: DataFrame, regions: DataFrame, span: int | None) -> tuple[DataFrame, DataFrame, Broadcast | None, list[str]]:
    """(reads near regions, the regions that count, their index or None, the column of a read's own regions if there is no index)."""
    regions = regions.where("chr is not null and begin_pos < end_pos").select("chr", *_REGION)
    reads = spread(reads).where("start < end")
    few = regions.limit(BROADCAST_ROWS + 1).toArrow()
    if few.num_rows <= BROADCAST_ROWS:
        index = Index(few, span)
        bits, cover = index.cover()
        at = lambda x: F.shiftright(F.greatest(x, F.lit(0)), bits).cast("int")
        mapped = reads.sparkSession.createDataFrame(cover, "chr string, _cover binary")
        touched = F.contains(F.substr("_cover", at(F.col("start")) + 1, at(F.col("end") - 1) - at(F.col("start")) + 1), F.unhex(F.lit("01")))
        return reads.join(F.broadcast(mapped), "chr").where(touched), regions, reads.sparkSession.sparkContext.broadcast(index), []
    pairs = overlap_join(reads.select("sample", "read_idx", "chr", "start", "end"), regions, few=False)
    arrays = pairs.groupBy("sample", "read_idx").agg(F.sort_array(F.collect_list(F.struct(*_REGION))).alias("_regions"))
    return reads.join(arrays, ["sample", "read_idx"]), regions, None, ["_regions"]


def _listed(column: pa.Array, span: int | None) -> tuple[Spans, dict[str, pa.Array], np.ndarray]:
    """The regions listed for each read of a batch: spans, attributes and each read's first place."""
    flat, offsets = column.flatten(), np.cumsum([0, *column.value_lengths().to_pylist()])
    attributes = {c: flat.field(c) for c in _REGION}
    begin, end = (attributes[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("begin_pos", "end_pos"))
    return Spans(begin, end, np.array([s == "-" for s in attributes["strand"].to_pylist()], bool), span), attributes, offsets


def sites(reads: DataFrame, regions: DataFrame, basemod: str = "A+CG", centered: bool = False, window: int = 1000, thresh_a: int = 129, thresh_c: int = 129, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """One row per (read, region, candidate base) inside the region, with the given columns.

    Uncentred: begin_pos < pos < end_pos. Centred: pos is relative to the region's centre, oriented by strand, and |pos| <= window.
    Only reads that overlap a region give sites, and each is decoded once, whatever the number of its regions: its sites are
    sorted, so each region takes a stretch of them. Regions with null or empty intervals give nothing.

    Few regions (their number is checked) are fetched and broadcast as sorted arrays; a map of the covered bins keeps reads without regions in
    the JVM, and nothing is shuffled. More are matched by bins over the reads' coordinates alone, and their arrays joined to the reads.
    """
    bases, thresholds = bases_of(basemod), {"A": thresh_a, "C": thresh_c}
    span = window if centered else None
    reads, regions, shared, listed = _near(reads, regions, span)

    names = [_READ[c] for c in columns if c in _READ]
    fields = {f.name: f.dataType.simpleString() for f in reads.schema} | {c: regions.schema[c].dataType.simpleString() for c in _REGION}
    schema = ", ".join(f"`{c}` {_OWN.get(c) or fields[_READ.get(c, c)]}" for c in columns)
    types = [{"int": pa.int32(), "string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}.get(_OWN.get(c)) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            flag, start, end, chr_, cigar, seq, mm = (value[c].to_pylist() for c in ("flag", "start", "end", "chr", "cigar", "seq", "mm"))
            if shared is not None:
                found, attributes = shared.value, shared.value.attributes
                spans = found.spans
            else:
                spans, attributes, offsets = _listed(value["_regions"], span)
            ml = value["ml"]
            parts: list[tuple] = []
            held = 0

            def out() -> pa.RecordBatch:
                sizes = [len(p[3]) for p in parts]
                join = lambda j: np.concatenate([p[j] for p in parts])
                read, region = pa.array(np.repeat([p[0] for p in parts], sizes)), pa.array(join(7))
                mods = {"mod_idx": lambda: np.repeat([p[1] for p in parts], sizes), "mod": lambda: pa.array([p[2] for p in parts]).take(pa.array(np.repeat(np.arange(len(parts)), sizes)))}
                own = {"pos": 3, "prob": 4, "called": 5, "methylated": 6}
                cols = []
                for c, t in zip(columns, types, strict=True):
                    if c in _READ:
                        cols.append(value[_READ[c]].take(read))
                    elif c in _REGION:
                        cols.append(attributes[c].take(region))
                    else:
                        x = mods[c]() if c in mods else join(own[c])
                        cols.append(x if isinstance(x, pa.Array) else pa.array(x, t))
                return pa.RecordBatch.from_arrays(cols, names=list(columns))

            for i in range(batch.num_rows):
                near = found.overlapping(chr_[i], start[i], end[i]) if shared is not None else np.arange(offsets[i], offsets[i + 1])
                if not len(near):
                    continue
                values = ml[i].values
                got, _ = decode_read(flag[i] or 0, start[i], cigar[i], seq[i], mm[i], None if values is None else values.to_numpy(zero_copy_only=False), bases, thresholds)
                for mod_idx, mod, *site in got:
                    if (flag[i] or 0) & 16:
                        site = [x[::-1] for x in site]
                    at, region = spans.pairs(site[0], near)
                    if not len(at):
                        continue
                    pos, prob, called, methylated = (x[at] for x in site)
                    if centered:
                        pos = spans.sign[region] * (pos - spans.mid[region])
                    parts.append((i, mod_idx, mod, pos, prob, called, methylated, region))
                    held += len(at)
                if held >= BATCH_SITES:
                    yield out()
                    parts, held = [], 0
            if parts:
                yield out()

    needed = dict.fromkeys([*names, "flag", "chr", "start", "end", "cigar", "seq", "mm", "ml", *listed])
    return reads.select(*needed).mapInArrow(run, schema)


class _Sums:
    """Modified and all bases by key and position, added up until they are sent on."""

    def __init__(self, dense: bool):
        self.dense, self.held = dense, 0
        self.parts: dict[tuple, list[tuple]] = {}

    def add(self, key: tuple, pos: np.ndarray, methylated: np.ndarray, total: np.ndarray) -> None:
        """pos ascends without repeats."""
        own = self.parts.setdefault(key, [])
        own.append((pos, methylated, total))
        self.held += len(pos)
        if self.dense and len(own) > 64:
            self.held -= sum(len(p) for p, *_ in own)
            self.parts[key] = [_added(own)]
            self.held += len(self.parts[key][0][0])

    def take(self) -> list[tuple]:
        """(key, positions, methylated, total) of everything held, which is then forgotten."""
        out = [(key, *_added(own)) for key, own in self.parts.items()]
        self.parts, self.held = {}, 0
        return out


def _added(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pos, methylated, total = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(pos, kind="stable")
    pos = pos[order]
    first = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]]) if len(pos) else np.empty(0, np.int64)
    add = lambda x: np.add.reduceat(x[order], first) if len(first) else x
    return pos[first], add(methylated), add(total)


def _paired(spans: Spans, pos: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """pairs() of the regions own in their order, not many at once."""
    n = np.cumsum(np.searchsorted(pos, spans.hi[own]) - np.searchsorted(pos, spans.lo[own]))
    at = 0
    while at < len(own):
        to = max(int(np.searchsorted(n, (n[at - 1] if at else 0) + PAIRS, "right")), at + 1)
        yield spans.pairs(pos, own[at:to])
        at = to


def _inside(spans: Spans, pos: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The number of regions own that each site is in."""
    return np.searchsorted(np.sort(spans.lo[own]), pos, "right") - np.searchsorted(np.sort(spans.hi[own]), pos, "right")


def _first_inside(spans: Spans, pos: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The least of the regions own that each site is in, -1 if there is none."""
    out = np.full(len(pos), -1)
    last = own[::-1]
    for r, a, b in zip(last.tolist(), np.searchsorted(pos, spans.lo[last]).tolist(), np.searchsorted(pos, spans.hi[last]).tolist(), strict=True):
        out[a:b] = r
    return out


def tallied(reads: DataFrame, regions: DataFrame, basemod: str = "A+CG", centered: bool = False, window: int = 1000, thresh_a: int = 129, thresh_c: int = 129, by_bed: bool = False, calls: bool = True, all_bases: bool = False) -> DataFrame:
    """What sites() gives, added up where a read is decoded: its rows do not grow with the number of regions a site is in.

    There are two kinds of rows. Sums (total_bases is not null) hold methylated_bases and total_bases of a position and modification, of part
    of the reads: by sample and chr, or centred by sample; with by_bed by bed_id too. Calls (total_bases is null) are the first of each read's
    own rows with a position, in the order of calls(), of modified sites or with all_bases of all; lead marks one of each read.
    """
    bases, thresholds = bases_of(basemod), {"A": thresh_a, "C": thresh_c}
    span = window if centered else None
    reads, regions, shared, listed = _near(reads, regions, span)
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    bed, number, key = kind(regions, "bed_id"), kind(regions, "region_idx"), kind(reads, "read_idx")
    schema = f"bed_id {bed}, region_idx {number}, sample string, read_idx {key}, read_name string, chr string, mod_idx int, mod string, pos bigint, prob int, lead boolean, methylated_bases bigint, total_bases bigint"
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(centered)
        kinds: dict[str, pa.DataType] = {"sample": pa.string(), "read_name": pa.string(), "chr": pa.string(), "mod_idx": pa.int32(), "mod": pa.string(), "pos": pa.int64(), "prob": pa.int32(), "lead": pa.bool_(), "methylated_bases": pa.int64(), "total_bases": pa.int64()}

        def batch_of(n: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kinds[c]) for c in fields], names=fields)

        def summed() -> Iterator[pa.RecordBatch]:
            rows = sums.take()
            if rows:
                sizes = [len(r[1]) for r in rows]
                which = pa.array(np.repeat(np.arange(len(rows)), sizes))
                text = {c: pa.array([r[0][k] for r in rows], kinds[c]).take(which) for k, c in enumerate(("bed_id", "sample", "chr", "mod"))}
                numbers = {c: pa.array(np.concatenate([r[k] for r in rows]).astype(np.int64)) for k, c in ((1, "pos"), (2, "methylated_bases"), (3, "total_bases"))}
                yield batch_of(sum(sizes), **text, **numbers)

        for batch in batches:
            value = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            sample, flag, start, end, chr_, cigar, seq, mm = (value[c].to_pylist() for c in ("sample", "flag", "start", "end", "chr", "cigar", "seq", "mm"))
            if shared is not None:
                found, attributes = shared.value, shared.value.attributes
                spans = found.spans
            else:
                spans, attributes, offsets = _listed(value["_regions"], span)
            kinds |= {"bed_id": attributes["bed_id"].type, "region_idx": attributes["region_idx"].type, "read_idx": value["read_idx"].type}
            coded = attributes["bed_id"].dictionary_encode("encode")
            beds, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            ml = value["ml"]
            parts: list[tuple] = []
            held = 0

            def listed_calls() -> pa.RecordBatch:
                sizes = [len(p[3]) for p in parts]
                join = lambda j: np.concatenate([p[j] for p in parts])
                read, region = pa.array(np.repeat([p[0] for p in parts], sizes)), pa.array(join(1))
                mods = list(dict.fromkeys(m for p in parts for m in p[6]))
                codes = np.concatenate([np.array([mods.index(m) for m in p[6]])[p[5]] for p in parts])
                columns = {"bed_id": attributes["bed_id"].take(region), "region_idx": attributes["region_idx"].take(region)} | {c: value[_READ[c]].take(read) for c in _READ}
                lead = np.zeros(sum(sizes), bool)
                lead[np.cumsum([0, *sizes[:-1]])] = True
                return batch_of(sum(sizes), **columns, mod_idx=pa.array(join(2), pa.int32()), mod=pa.array(mods).take(pa.array(codes)), pos=pa.array(join(3)), prob=pa.array(join(4), pa.int32()), lead=pa.array(lead))

            for i in range(batch.num_rows):
                near = np.sort(found.overlapping(chr_[i], start[i], end[i])) if shared is not None else np.arange(offsets[i], offsets[i + 1])
                if not len(near):
                    continue
                values = ml[i].values
                got, _ = decode_read(flag[i] or 0, start[i], cigar[i], seq[i], mm[i], None if values is None else values.to_numpy(zero_copy_only=False), bases, thresholds)
                groups = [(names[k], near[beds[near] == k]) for k in np.unique(beds[near])] if by_bed else [(None, near)]
                rows: list[tuple] = []  # (region, mod_idx, pos, prob, place in got) of the read's calls
                for place, (mod_idx, mod, *site) in enumerate(got):
                    pos, prob, _, methylated = (x[::-1] for x in site) if (flag[i] or 0) & 16 else site
                    for bed_id, own in groups:
                        sum_key = (bed_id, sample[i], None if centered else chr_[i], mod)
                        if not centered:
                            n = _inside(spans, pos, own)
                            at = np.flatnonzero(n)
                            if len(at):
                                sums.add(sum_key, pos[at], n[at] * methylated[at], n[at])
                            continue
                        total, hits = np.zeros(2 * window + 1, np.int64), np.zeros(2 * window + 1, np.int64)
                        for which, to in ((~methylated, (total,)), (methylated, (total, hits))):
                            for at, region in _paired(spans, pos[which], own):
                                if len(at):
                                    rel = spans.sign[region] * (pos[which][at] - spans.mid[region]) + window
                                    low = int(rel.min())
                                    counts = np.bincount(rel - low)
                                    for t in to:
                                        t[low : low + len(counts)] += counts
                        at = np.flatnonzero(total)
                        if len(at):
                            sums.add(sum_key, at - window, hits[at], total[at])
                    if not calls:
                        continue
                    if not all_bases:
                        pos, prob = pos[methylated], prob[methylated]
                    if not centered:
                        region = found.first_inside(chr_[i], pos) if shared is not None else _first_inside(spans, pos, near)
                        kept = region >= 0
                        if kept.any():
                            rows.append((region[kept], np.full(kept.sum(), mod_idx), pos[kept], prob[kept], np.full(kept.sum(), place)))
                        continue
                    best, of = np.full(2 * window + 1, -1), np.zeros(2 * window + 1, np.int64)
                    for at, region in _paired(spans, pos, near[::-1]):
                        rel = spans.sign[region] * (pos[at] - spans.mid[region]) + window
                        best[rel], of[rel] = region, at  # of equal places the last counts: the least region
                    at = np.flatnonzero(best >= 0)
                    if len(at):
                        rows.append((best[at], np.full(len(at), mod_idx), at - window, prob[of[at]], np.full(len(at), place)))
                if sums.held >= BATCH_SITES:
                    yield from summed()
                if rows:
                    region, index, pos, prob, place = (np.concatenate(x) for x in zip(*rows, strict=True))
                    if len(rows) > 1:
                        order = np.lexsort((index, region, pos))
                        order = order[np.r_[True, pos[order][1:] != pos[order][:-1]]]
                        region, index, pos, prob, place = (x[order] for x in (region, index, pos, prob, place))
                    parts.append((i, region, index, pos, prob, place, [g[1] for g in got]))
                    held += len(pos)
                if held >= BATCH_SITES:
                    yield listed_calls()
                    parts, held = [], 0
            if parts:
                yield listed_calls()
        yield from summed()

    needed = dict.fromkeys(["sample", "read_idx", "name", "flag", "chr", "start", "end", "cigar", "seq", "mm", "ml", *listed])
    return reads.select(*needed).mapInArrow(run, schema)


def tallied_pileup(found: DataFrame, keys: list[str]) -> DataFrame:
    """The sums of tallied() by keys."""
    return merge_pileups(found.where("total_bases is not null"), keys=keys)


def tallied_calls(found: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """The calls table of tallied(). again: what names_again() found; then only reads whose name occurs again are compared with one another."""
    order = ["bed_id", "region_idx", "read_idx", "mod_idx", "pos"]
    rows = found.where("total_bases is null").withColumn("id", F.concat_ws(":", "read_name", F.col("pos").cast("string")))
    cols = ["sample", "id", "read_name", "chr", "pos", "prob", "mod"]
    if again is None:
        return first_per_id(rows, order).select(*cols)
    n = again.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return rows.select(*cols)
    same = (rows["sample"] == again["sample"]) & rows["read_name"].eqNullSafe(again["read_name"])
    few = F.broadcast(again) if n <= BROADCAST_ROWS else again
    return rows.join(few, same, "left_anti").select(*cols).unionByName(first_per_id(rows.join(few, same, "left_semi"), order).select(*cols))


def names_again(found: DataFrame) -> DataFrame:
    """(sample, read_name) of several reads in what tallied() gives, stored."""
    return stored(found.where("lead").groupBy("sample", "read_name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))


#: The columns from which site_pileup() and calls() are made.
PILEUP = ("sample", "chr", "pos", "mod", "methylated")
CALLS = ("sample", "read_idx", "read_name", "chr", "mod_idx", "mod", "pos", "prob", "methylated", "bed_id", "region_idx")


def calls(found: DataFrame, all_bases: bool = False) -> DataFrame:
    """The calls table: modified sites, or all candidates with all_bases; of rows with one read:pos the first in processing order."""
    rows = (found if all_bases else found.where("methylated")).withColumn("id", F.concat_ws(":", "read_name", F.col("pos").cast("string")))
    first = first_per_id(rows, ["bed_id", "region_idx", "read_idx", "mod_idx", "pos"])
    return first.select("sample", "id", "read_name", "chr", "pos", "prob", "mod")


def site_pileup(found: DataFrame, centered: bool = False) -> DataFrame:
    """The pileup table of sites() or tallied(). A read counts once for each region it is in. Centred positions of all chromosomes add up; others do not."""
    keys = ["sample", "pos", "mod"] if centered else ["sample", "chr", "pos", "mod"]
    out = (tallied_pileup(found, keys) if "total_bases" in found.columns else pileup(found, keys, flag="methylated")).withColumn("id", F.concat_ws(":", F.col("pos").cast("string"), "mod"))
    return (out.withColumn("chr", F.lit(None).cast("string")) if centered else out).select("sample", "id", "chr", "pos", "mod", "methylated_bases", "total_bases")
