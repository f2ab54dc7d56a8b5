"""BAM files as a sink: a file for each partition, written where the rows are."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from calypile.sources.bam import mounted

#: Bytes of records in a compressed block, below the format's limit of 65,536.
BLOCK = 65_280
_CODES = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}
_OPS = "MIDNSHP=X"
_OP = re.compile(r"(\d+)([MIDNSHP=X])")
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(data: bytes) -> bytes:
    """One compressed block."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def header(contigs: list[tuple[str, int]], ordered: bool = False) -> bytes:
    text = b"@HD\tVN:1.6" + (b"\tSO:coordinate" if ordered else b"") + b"\n"
    names = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs)) + names


def record(numbers: dict[str, int], name, flag, chr_, start, mapq, cigar, seq, quals, mm, ml) -> bytes:
    """One alignment. More than 65,535 operations go into the CG tag, behind the placeholder of its length and span."""
    ops = [int(n) << 4 | _OPS.index(o) for n, o in _OP.findall(cigar or "")]
    seq = seq or ""
    tags = b""
    if len(ops) > 65_535:
        span = sum(x >> 4 for x in ops if _OPS[x & 15] in "MDN=X")
        tags += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
        ops = [len(seq) << 4 | _OPS.index("S"), span << 4 | _OPS.index("N")]
    if mm is not None:
        tags += b"MMZ" + mm.encode() + b"\0"
    if ml is not None:
        tags += b"MLBC" + struct.pack("<i", len(ml)) + np.asarray(ml, np.uint8).tobytes()
    nibbles = [_CODES.get(c, 15) for c in seq.upper()] + [0] * (len(seq) & 1)
    body = struct.pack("<iiBBHHHiiii", -1 if chr_ is None else numbers[chr_], -1 if start is None else start, len(name) + 1, mapq or 0, 0, len(ops), flag, len(seq), -1, -1, 0)
    body += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True))
    body += (b"\xff" * len(seq) if quals is None else np.asarray(quals, np.uint8).tobytes()) + tags
    return struct.pack("<i", len(body)) + body


def write_bams(reads: DataFrame, folder: str, contigs: list[tuple[str, int]]) -> str:
    """Writes reads as folder/part-<partition>.bam; the folder is one all executors see. A repeated task replaces its file."""
    numbers = {n: i for i, (n, _) in enumerate(contigs)}
    head, path_of = header(contigs), mounted(folder)
    os.makedirs(path_of, exist_ok=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = os.path.join(path_of, f"part-{TaskContext.get().partitionId():05d}.bam")
        own, n = f"{path}.{uuid.uuid4().hex}", 0
        none = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x
        with open(own, "wb") as f:
            held = bytearray(head)
            for b in batches:
                for r in zip(b["name"], b["flag"], b["chr"], b["start"], b["mapq"], b["cigar"], b["seq"], b["quals"], b["mm"], b["ml"], strict=True):
                    name, flag, chr_, start, mapq, cigar, seq, quals, mm, ml = map(none, r)
                    held += record(numbers, name, int(flag), chr_, None if start is None else int(start), None if mapq is None else int(mapq), cigar, seq, quals, mm, ml)
                    n += 1
                    while len(held) >= BLOCK:
                        f.write(block(bytes(held[:BLOCK])))
                        del held[:BLOCK]
            f.write(block(bytes(held)) + _END)
        os.replace(own, path)
        yield pd.DataFrame({"n": [n]})

    reads.select("name", "flag", "chr", "start", "mapq", "cigar", "seq", "quals", "mm", "ml").mapInPandas(write, "n bigint").agg({"n": "sum"}).collect()
    return folder
