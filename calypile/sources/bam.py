"""BAM files as a Spark data source, read without native libraries.

spark.dataSource.register(BamSource); spark.read.format("calypile_bam").option("sample", "s").load(path)

A file is a chain of compressed blocks, so it is split at block borders into parts of about split_bytes; a part's first
record is found by checking candidate offsets for a run of well-formed records. With the option region (chr:begin-end) or regions (a JSON list
of [chr, begin, end]) only reads that overlap one of them are returned, checked on each record's first bytes before it is decoded.
Where an index (.bai) lies beside the file, only the stretches it names for these regions are planned, with both their bounds, small ones
together in a part and long ones split; in a file sorted by coordinate without an index, a part is left at the first record behind the
regions. (Regions are an option and not a pushed filter, as Spark 4.1 keeps filters pushed by one query for later queries over
the same DataFrame.)
"""

from __future__ import annotations

import bisect
import glob
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from calypile.operators.regions import parse_region
from calypile.schemas import READS

_BASES = "=ACMGRSVTWYHKDBN"
_PAIRS = [a + b for a in _BASES for b in _BASES]
_CIGAR = "MIDNSHP=X"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_FORMATS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_SPANS = np.array([c in "MDN=X" for c in _CIGAR.ljust(16)])
#: Rows and bytes of records after which a batch is sent to the JVM.
ROWS, BYTES = 2000, 32 << 20


def mounted(path: str) -> str:
    """A path of the file system; file: is dropped, other schemes are an error, as blocks are read by offset from mounted files only."""
    bare = path.removeprefix("file:")
    if re.match(r"[a-z][a-z0-9+.-]+:", bare):
        raise ValueError(f"{path}: BAM files are read from mounted folders only")
    return bare


class Blocks:
    """The uncompressed bytes of a BGZF file from one block on, read as needed."""

    def __init__(self, path: str, at: int = 0):
        self.file = open(path, "rb")  # noqa: SIM115
        self.file.seek(at)
        self.at = at
        self.data, self.pos = b"", 0
        self.starts: list[tuple[int, int]] = []  # (bytes of data before the block, its file offset)

    def more(self) -> bool:
        head = self.file.read(18)
        if len(head) < 18:
            return False
        extra, bsize = struct.unpack_from("<H", head, 10)[0], struct.unpack_from("<H", head, 16)[0] + 1
        if head[:2] != b"\x1f\x8b" or head[12:14] != b"BC":
            self.file.seek(self.at)
            raise ValueError(f"no BGZF block at {self.at}")
        body = self.file.read(bsize - 18)
        past = max((i for i, (o, _) in enumerate(self.starts) if o <= self.pos), default=0)  # blocks before this one lie wholly before pos
        self.data, self.starts = self.data[self.pos :], [(max(0, o - self.pos), f) for o, f in self.starts[past:]]
        self.pos = 0
        self.starts.append((len(self.data), self.at))
        self.data += zlib.decompress(body[extra - 6 : -8], -15)
        self.at += bsize
        return True

    def need(self, n: int) -> bool:
        while len(self.data) - self.pos < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes | None:
        if not self.need(n):
            return None
        out = self.data[self.pos : self.pos + n]
        self.pos += n
        return out

    def block(self) -> int:
        """File offset of the block that holds the next byte."""
        return max((f for o, f in self.starts if o <= self.pos), default=self.at) if self.pos < len(self.data) else self.at

    def tell(self) -> int:
        """Virtual offset of the next byte: its block's file offset << 16 | its place in the block."""
        before, offset = max(((o, f) for o, f in self.starts if o <= self.pos), default=(0, self.at)) if self.pos < len(self.data) else (self.pos, self.at)
        return offset << 16 | (self.pos - before)

    def close(self) -> None:
        self.file.close()


def header(path: str) -> tuple[list[str], int, int, bool]:
    """(reference names, file offset of the block of the first record, its offset in that block, sorted by coordinate)."""
    b = Blocks(path)
    try:
        if b.take(4) != b"BAM\1":
            raise ValueError(f"{path} is not a BAM file")
        text = b.take(struct.unpack("<i", b.take(4))[0])
        ordered = b"\tSO:coordinate" in text.split(b"\n", 1)[0]
        names = []
        for _ in range(struct.unpack("<i", b.take(4))[0]):
            names.append(b.take(struct.unpack("<i", b.take(4))[0])[:-1].decode())
            b.take(4)
        if b.pos >= len(b.data):
            return names, b.at, 0, ordered
        before, offset = max((o, f) for o, f in b.starts if o <= b.pos)
        return names, offset, b.pos - before, ordered
    finally:
        b.close()


def next_block(path: str, at: int) -> int | None:
    """The first block at or after a file offset; None at the end."""
    with open(path, "rb") as f:
        f.seek(at)
        data = f.read(1 << 17)
        i = data.find(b"\x1f\x8b\x08\x04")
        while i >= 0 and i + 18 <= len(data):
            size = struct.unpack_from("<H", data, i + 16)[0] + 1
            f.seek(at + i + size)
            after = f.read(4)
            if data[i + 12 : i + 14] == b"BC" and after in (b"\x1f\x8b\x08\x04", b""):
                return at + i
            i = data.find(b"\x1f\x8b\x08\x04", i + 1)
    return None


def _plausible(data: bytes, at: int, n_ref: int) -> int:
    """The length of a well-formed record at this place, else 0; -1 if more bytes are needed."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, l_name, mapq, _bin, n_cigar, flag, l_seq, nref, npos, _tlen = struct.unpack_from("<iiiBBHHHiiii", data, at)
    fixed = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if not (fixed <= size < 1 << 28 and -1 <= ref < n_ref and -1 <= nref < n_ref and pos >= -1 and npos >= -1 and l_name > 1 and l_seq >= 0):
        return 0
    if at + 36 + l_name > len(data):
        return -1
    name = data[at + 36 : at + 36 + l_name]
    return size + 4 if name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1]) else 0


def synchronise(b: Blocks, n_ref: int, run: int = 4) -> bool:
    """Moves b to the first record border at or after its position; False if there is none."""
    while b.need(1):
        at, ok = b.pos, 0
        while ok < run:
            size = _plausible(b.data, at, n_ref)
            if size == -1 or (size > 0 and at + size > len(b.data)):
                before = b.pos
                at -= before
                if not b.more():
                    ok = run if ok or size > 0 else 0
                    break
                continue
            if size == 0:
                break
            at, ok = at + size, ok + 1
            if at == len(b.data):
                at -= b.pos
                if not b.more():
                    ok = run
        if ok >= run:
            return True
        b.pos += 1
    return False


def tags(data: bytes) -> dict[str, object]:
    """The modification tags of a record's optional fields, and the operations in CG."""
    out: dict[str, object] = {}
    at = 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            value: object = data[at:end].decode("latin-1")
            at = end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            value = list(struct.unpack_from(f"<{n}{_FORMATS[sub]}", data, at + 5)) if name in ("Ml", "ML") or (name == "CG" and sub in "Ii") else None
            at += 5 + n * _SIZES[sub]
        else:
            value, at = None, at + _SIZES[kind]
        if name in ("Mm", "MM", "Ml", "ML", "CG"):
            out.setdefault(name.lower(), value)
    return out


def placed(data: bytes) -> tuple[int, int, int]:
    """(reference, start, end) of a record; the reference is -1 if it is unmapped."""
    ref, pos, l_name, n_cigar, flag = *struct.unpack_from("<iiB", data, 0), *struct.unpack_from("<HH", data, 12)
    if ref < 0 or flag & 4:
        return -1, -1, -1
    ops = np.frombuffer(data, "<u4", n_cigar, 32 + l_name)
    return ref, pos, pos + int((ops >> 4)[_SPANS[ops & 15]].sum())


def record(data: bytes, names: list[str]) -> tuple:
    """(name, flag, chr, start, end, mapq, cigar, seq, quals, mm, ml) of a record without its length field."""
    ref, pos, l_name, mapq, _bin, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", data, 0)
    at = 32
    name = data[at : at + l_name - 1].decode("latin-1")
    at += l_name
    ops = struct.unpack_from(f"<{n_cigar}I", data, at)
    at += 4 * n_cigar
    packed = data[at : at + (l_seq + 1) // 2]
    at += (l_seq + 1) // 2
    raw = data[at : at + l_seq]
    seq = "".join([_PAIRS[x] for x in packed])[:l_seq] or None
    quals = None if not l_seq or raw[0] == 255 else list(raw)
    own = tags(data[at + l_seq :])
    if n_cigar == 2 and ops[0] == l_seq << 4 | _CIGAR.index("S") and _CIGAR[ops[1] & 15] == "N" and own.get("cg"):
        ops = [x & 0xFFFFFFFF for x in own["cg"]]  # more than 65,535 operations: the fixed field holds only a placeholder
    mapped = ref >= 0 and not flag & 4
    cigar = "".join(f"{x >> 4}{_CIGAR[x & 15]}" for x in ops) or None
    end = pos + sum(x >> 4 for x in ops if _CIGAR[x & 15] in "MDN=X") if mapped else None
    return name, flag, names[ref] if mapped else None, pos if mapped else None, end, mapq, cigar, seq, quals, own.get("mm"), own.get("ml")


class Regions:
    """Regions of each chr, merged into sorted spans that do not touch."""

    def __init__(self, regions: list[tuple[str, int, int]]):
        self.spans: dict[str, tuple[list[int], list[int]]] = {}
        for c, a, b in sorted(r for r in regions if r[1] < r[2]):
            starts, ends = self.spans.setdefault(c, ([], []))
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)

    def first(self, chr_: str | None, begin: int, end: int) -> int | None:
        """The begin of the first span that overlaps [begin, end)."""
        starts, ends = self.spans.get(chr_, ((), ()))
        i = bisect.bisect_right(ends, begin)
        return starts[i] if i < len(starts) and starts[i] < end else None


def bin_span(number: int) -> tuple[int, int]:
    """The positions [begin, end) of an index bin."""
    level = next(k for k in range(5, -1, -1) if number >= ((1 << 3 * k) - 1) // 7)
    shift = 29 - 3 * level
    at = (number - ((1 << 3 * level) - 1) // 7) << shift
    return at, at + (1 << shift)


def indexed(path: str, names: list[str], regions: Regions) -> list[tuple[int, int | None]] | None:
    """From a .bai beside the file, the stretches of virtual offsets [begin, end) that may hold records of the regions, merged; an end
    None is the file's. None without an index."""
    bai = next((x for x in (path + ".bai", path.removesuffix(".bam") + ".bai") if os.path.exists(x)), None)
    if bai is None:
        return None
    with open(bai, "rb") as f:
        data = f.read()
    out: list[tuple[int, int | None]] = []
    at = 8
    for r in range(struct.unpack_from("<i", data, 4)[0]):
        n_bin, at = struct.unpack_from("<i", data, at)[0], at + 4
        own = regions.spans.get(names[r]) if r < len(names) else None
        hit: list[tuple[int, int, int]] = []  # (first position asked for, chunk begin, chunk end)
        for _ in range(n_bin):
            number, n_chunk = struct.unpack_from("<II", data, at)
            if own and number < 37449:
                begin, end = bin_span(number)
                first = regions.first(names[r], begin, end)
                if first is not None:
                    offsets = struct.unpack_from(f"<{2 * n_chunk}Q", data, at + 8)
                    hit += [(max(first, 0), a, b) for a, b in zip(offsets[::2], offsets[1::2], strict=True)]
            at += 8 + 16 * n_chunk
        n_intv, at = struct.unpack_from("<i", data, at)[0], at + 4
        if own:
            least = lambda pos: next((x for x in struct.unpack_from(f"<{max(n_intv - (pos >> 14), 0)}Q", data, at + 8 * min(pos >> 14, n_intv)) if x), 0)  # noqa: B023, E731
            known: dict[int, int] = {}
            for first, a, b in hit:
                low = known.setdefault(first >> 14, -1)
                if low < 0:
                    low = known[first >> 14] = least(first)
                if b > low:
                    out.append((max(a, low) if a < low else a, b))
            if not n_bin and n_intv:
                out.append((least(max(own[0][0], 0)), None))
        at += 8 * n_intv
    merged: list[tuple[int, int | None]] = []
    for a, b in sorted(out, key=lambda x: x[0]):
        if merged and (merged[-1][1] is None or a <= merged[-1][1]):
            merged[-1] = (merged[-1][0], None if b is None or merged[-1][1] is None else max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


class Part(InputPartition):
    """Stretches of a file: (block of the first byte, its place in it or None for the first record found, virtual offset of the end)."""

    def __init__(self, path: str, pieces: list[tuple[int, int | None, int]], number: int):
        self.path, self.pieces, self.number = path, pieces, number


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = mounted(options["path"])
        self.sample = options.get("sample", "sample")
        self.split = int(options.get("split_bytes", 64 << 20))
        asked = [parse_region(options["region"])] if options.get("region") else [tuple(x) for x in json.loads(options["regions"])] if options.get("regions") else None
        self.regions = None if asked is None else Regions(asked)

    def partitions(self) -> list[Part]:
        files = sorted(glob.glob(os.path.join(self.path, "*.bam"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not files:
            raise FileNotFoundError(self.path)
        out: list[Part] = []
        for path in files:
            names, first, within, _ = header(path)
            size = os.path.getsize(path)
            stretches = indexed(path, names, self.regions) if self.regions else None
            if stretches is None:
                stretches = [(first << 16 | within, None)]
            held: list[tuple[int, int | None, int]] = []
            room = self.split
            for begin, end in stretches:
                at, inside, stop = begin >> 16, begin & 0xFFFF, size << 16 if end is None else end
                while True:
                    cut = next_block(path, at + room) if at + room < stop >> 16 else None
                    if cut is None or cut >= stop >> 16:
                        held.append((at, inside, stop))
                        room -= max((stop >> 16) - at, 0)
                        break
                    out.append(Part(path, [*held, (at, inside, cut << 16)], len(out)))
                    held, at, inside, room = [], cut, None, self.split
                if room <= 0:
                    out.append(Part(path, held, len(out)))
                    held, room = [], self.split
            if held:
                out.append(Part(path, held, len(out)))
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        """Records whose first byte lies in the part's stretches; the last of one may run beyond it."""
        names, _, _, ordered = header(partition.path)
        last = max((i for i, n in enumerate(names) if n in self.regions.spans), default=-1) if self.regions else len(names)
        types = pa.schema([("sample", pa.string()), ("read_idx", pa.int64()), ("name", pa.string()), ("flag", pa.int32()), ("chr", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("quals", pa.list_(pa.int32())), ("mm", pa.string()), ("ml", pa.list_(pa.int32()))])
        rows: list[tuple] = []
        n = held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

        for start, within, stop in partition.pieces:
            b = Blocks(partition.path, start)
            try:
                if within is not None:
                    b.need(within)
                    b.pos = within
                elif not synchronise(b, len(names)):
                    continue
                while b.need(1) and b.tell() < stop:
                    size = b.take(4)
                    data = size and b.take(struct.unpack("<i", size)[0])
                    if not data:
                        break
                    n += 1
                    if self.regions is not None:
                        ref, pos, end = placed(data)
                        if ref < 0 or self.regions.first(names[ref], pos, end) is None:
                            if ordered and (ref < 0 or ref > last or (ref == last and pos >= self.regions.spans[names[last]][1][-1])):
                                break  # in a sorted file nothing after this can overlap
                            continue
                    rows.append((self.sample, (partition.number << 33) + n, *record(data, names)))
                    held += len(data)
                    if len(rows) >= ROWS or held >= BYTES:
                        yield batch()
                        rows.clear()
                        held = 0
            finally:
                b.close()
        if rows:
            yield batch()


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "calypile_bam"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def read_bam(spark, path: str, sample: str, split_bytes: int = 64 << 20, region: str | None = None, regions: list[tuple[str, int, int]] | None = None):
    """The reads of one BAM file or of all in a folder; with region, or regions (chr, begin, end), only those that overlap one."""
    spark.dataSource.register(BamSource)
    reader = spark.read.format("calypile_bam").option("sample", sample).option("split_bytes", str(split_bytes))
    if regions is not None:
        reader = reader.option("regions", json.dumps([list(r) for r in regions]))
    return (reader.option("region", region) if region else reader).load(path)
