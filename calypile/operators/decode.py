"""From aligned reads with modification tags to one row per candidate base.

Two forms with the same result. decode() runs one vectorised numpy pass per read inside mapInArrow: linear in the read's length and
without a shuffle, so it is the one for long reads. decode_relational() is the plan in DataFrame operations only (posexplode and
windows per read); it shuffles every base by its read and serves short reads and as a second opinion.

Candidates: every A with a reference position; every C that is followed by a G, both aligned to neighbouring positions. A base is
modified if it is called with a probability at or above the threshold of its letter. Uncalled candidates have prob 0.
Reads without tags give no rows. A tag with more calls than the read has bases is counted in n_lost of tag_quality().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calypile.functions.reads import aligned_blocks, reverse_complement
from calypile.session import spread

BASEMODS = {"A": "A", "CG": "C", "A+CG": "AC"}
_SEGMENT = re.compile(r"([ACGTUN])([+-])([^,?.]+)[?.]?((?:,\d+)*)$")
_HEAD = r"^([ACGTUN])([+-])([^,?.]+)[?.]?$"
_OP = re.compile(r"(\d+)([MIDNSHP=X])")
_COMPLEMENT = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")
#: Sites after which a batch is sent back to the JVM.
BATCH_SITES = 1 << 19
SITES = "mod_idx int, mod string, pos bigint, prob int, called boolean, methylated boolean"


def segments(mm: str | None) -> list[tuple[int, str, str, np.ndarray]]:
    """(index, base, mod code such as A+a, deltas) of each well-formed segment of a tag; the rest is skipped."""
    out = []
    for i, part in enumerate((mm or "").split(";")):
        m = _SEGMENT.match(part)
        if m:
            out.append((i, m[1], f"{m[1]}{m[2]}{m[3]}", np.array(m[4].split(",")[1:], np.int64)))
    return out


def reference_positions(cigar: str, start: int) -> np.ndarray:
    """The reference position of each base of the record's sequence, -1 for clipped and inserted ones."""
    parts, at = [], start
    for n, op in _OP.findall(cigar or ""):
        n = int(n)
        if op in "M=X":
            parts.append(np.arange(at, at + n))
            at += n
        elif op in "DN":
            at += n
        elif op in "IS":
            parts.append(np.full(n, -1))
    return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)


def decode_read(flag: int, start: int, cigar: str, seq: str, mm: str | None, ml: np.ndarray | None, bases: str, thresholds: dict[str, int]) -> tuple[list, int]:
    """(mod_idx, mod, positions, probs, called, methylated) for each requested segment, and the number of calls without a base."""
    found = segments(mm)
    if not found or not seq or seq == "*" or start is None:
        return [], 0
    forward = seq.upper().encode("ascii", "replace")
    where = reference_positions(cigar, start)
    if len(where) != len(forward):
        return [], 0
    if flag & 16:
        forward, where = forward.translate(_COMPLEMENT)[::-1], where[::-1]
    letters = np.frombuffer(forward, np.uint8)
    ml = np.empty(0, np.int64) if ml is None else np.asarray(ml, np.int64)
    out, lost, offset = [], 0, 0
    for index, base, mod, deltas in found:
        n = len(deltas)
        probs = ml[max(len(ml) - n, 0) :] if len(found) == 2 and index == 1 else ml[offset : offset + n]
        offset += n
        if base not in bases:
            continue
        at = np.flatnonzero(letters == ord(base))
        ordinals = np.cumsum(deltas) + np.arange(n)
        ok = (ordinals < len(at)) & (np.arange(n) < len(probs))
        lost += int((~ok).sum())
        prob = np.zeros(len(at), np.int64)
        called = np.zeros(len(at), bool)
        prob[ordinals[ok]], called[ordinals[ok]] = probs[np.flatnonzero(ok)], True
        if base == "C":
            inner = at < len(letters) - 1
            nxt = np.minimum(at + 1, len(letters) - 1)
            keep = inner & (letters[nxt] == ord("G")) & (where[at] >= 0) & (where[nxt] >= 0) & (np.abs(where[nxt] - where[at]) == 1)
        else:
            keep = where[at] >= 0
        out.append((index, mod, where[at][keep], prob[keep], called[keep], called[keep] & (prob[keep] >= thresholds.get(base, 0))))
    return out, lost


def bases_of(basemod: str) -> str:
    if basemod not in BASEMODS:
        raise ValueError(f"basemod is one of {', '.join(BASEMODS)}, not {basemod!r}")
    return BASEMODS[basemod]


def decode(reads: DataFrame, keep: list[str], basemod: str = "A+CG", thresh_a: int = 129, thresh_c: int = 129) -> DataFrame:
    """(keep columns, mod_idx, mod, pos, prob, called, methylated): a row per candidate base of the requested modifications.

    reads has flag, start, cigar, seq, mm, ml. keep may hold columns of any type.
    """
    bases, thresholds = bases_of(basemod), {"A": thresh_a, "C": thresh_c}
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flag, start, cigar, seq, mm = (batch.column(k + i).to_pylist() for i in range(5))
            ml = batch.column(k + 5)
            row, parts, held = [], [], 0

            def out() -> pa.RecordBatch:
                at = pa.array(np.concatenate(row) if row else np.empty(0, np.int64))
                column = lambda j, t: pa.array(np.concatenate([p[j] for p in parts]) if parts else np.empty(0), t)
                sizes = [len(p[2]) for p in parts]
                return pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).take(at) for i in range(k)],
                        pa.array(np.repeat([p[0] for p in parts], sizes).astype(np.int32) if parts else [], pa.int32()),
                        pa.array([p[1] for p in parts], pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), sizes))),
                        column(2, pa.int64()), column(3, pa.int32()), column(4, pa.bool_()), column(5, pa.bool_()),
                    ],
                    names=[*keep, *(f.split()[0] for f in SITES.split(", "))],
                )

            for i in range(batch.num_rows):
                values = ml[i].values
                got, _ = decode_read(flag[i] or 0, start[i], cigar[i], seq[i], mm[i], None if values is None else values.to_numpy(zero_copy_only=False), bases, thresholds)
                for g in got:
                    row.append(np.full(len(g[2]), i))
                    parts.append(g)
                    held += len(g[2])
                if held >= BATCH_SITES:
                    yield out()
                    row, parts, held = [], [], 0
            yield out()

    kinds = ", ".join(f"`{c}` {reads.schema[c].dataType.simpleString()}" for c in keep)
    return spread(reads).select(*[F.col(f"`{c}`") for c in keep], "flag", "start", "cigar", "seq", "mm", "ml").mapInArrow(run, f"{kinds}, {SITES}" if keep else SITES)


def decode_relational(reads: DataFrame, key: str, basemod: str = "A+CG", thresh_a: int = 129, thresh_c: int = 129) -> DataFrame:
    """decode() with keep = [key], in DataFrame operations; key is unique in reads."""
    bases = bases_of(basemod)
    forward = F.when(F.col("flag").bitwiseAND(F.lit(16)) != 0, reverse_complement(F.upper("seq"))).otherwise(F.upper("seq"))
    k = F.col(f"`{key}`").alias("k")
    own = reads.where("mm is not null and start is not null and seq is not null and seq not in ('', '*')").select(k, "flag", "ml", "mm", forward.alias("fseq"), aligned_blocks(F.col("cigar"), F.col("start")).alias("blocks"))
    # every base of the read, in sequencing order, with the base after it
    w = Window.partitionBy("k").orderBy("i")
    n = F.length("fseq")
    base = own.select("k", n.alias("n"), "flag", F.posexplode(F.split("fseq", "")).alias("i", "b")).where("b <> ''")
    qpos = F.when(F.col("flag").bitwiseAND(F.lit(16)) != 0, F.col("n") - 1 - F.col("i")).otherwise(F.col("i"))
    base = base.withColumn("q", qpos)
    block = own.select("k", F.explode("blocks").alias("x")).select("k", "x.*")
    placed = base.join(block, (base["k"] == block["k"]) & (base["q"] >= block["qstart"]) & (base["q"] < block["qstart"] + block["len"]), "left").select(base["k"], "i", "b", (F.col("rstart") + F.col("q") - F.col("qstart")).alias("pos"))
    nb, npos = F.lead("b").over(w), F.lead("pos").over(w)
    ranked = placed.withColumn("nb", nb).withColumn("npos", npos).where(F.col("b").isin(*bases)).withColumn("o", F.row_number().over(Window.partitionBy("k", "b").orderBy("i")) - 1)
    # the called ordinals: running sums of the deltas
    head = lambda s: F.substring_index(s, ",", 1)
    rest = lambda s: F.substr(s, F.length(head(s)) + 1)
    # the deltas are checked by character class only: a repeated group would recurse once per delta in the JVM's matcher
    well = lambda s: head(s).rlike(_HEAD) & rest(s).rlike("^[0-9,]*$") & ~rest(s).contains(",,") & ~rest(s).endswith(",")
    seg = own.select("k", "ml", F.size(F.filter(F.split("mm", ";"), well)).alias("nseg"), F.posexplode(F.split("mm", ";")).alias("mod_idx", "s")).where(well(F.col("s")))
    part = lambda g: F.regexp_extract(head(F.col("s")), _HEAD, g)
    seg = seg.select("k", "ml", "nseg", "mod_idx", part(1).alias("b"), F.concat(part(1), part(2), part(3)).alias("mod"), F.split(rest(F.col("s")), ",").alias("d"))
    seg = seg.withColumn("d", F.filter("d", lambda x: x != "")).withColumn("off", F.coalesce(F.sum(F.size("d")).over(Window.partitionBy("k").orderBy("mod_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seg = seg.withColumn("off", F.when((F.col("nseg") == 2) & (F.col("mod_idx") == 1), F.size("ml") - F.size("d")).otherwise(F.col("off"))).where(F.col("b").isin(*bases))
    own_ml = F.slice("ml", F.greatest(F.col("off"), F.lit(0)).cast("int") + 1, F.size("d"))  # cut before the explode, or each call would carry all probabilities
    call = seg.select("k", "mod_idx", "b", F.posexplode(F.arrays_zip(F.col("d"), own_ml.alias("p"))).alias("j", "x"))
    call = call.select("k", "mod_idx", "b", (F.sum(F.col("x.d").cast("bigint")).over(Window.partitionBy("k", "mod_idx").orderBy("j")) + F.col("j")).alias("o"), F.col("x.p").alias("p")).where("p is not null")
    cand = seg.select("k", "mod_idx", "mod", "b").join(ranked, ["k", "b"]).where("pos is not null").where("b <> 'C' or (nb = 'G' and npos is not null and abs(npos - pos) = 1)")
    limit = F.when(F.col("b") == "C", thresh_c).otherwise(thresh_a)
    joined = cand.join(call, ["k", "mod_idx", "b", "o"], "left")
    prob = F.coalesce(F.col("p"), F.lit(0)).cast("int")
    called = F.col("p").isNotNull()
    return joined.select(F.col("k").alias(key), F.col("mod_idx").cast("int").alias("mod_idx"), "mod", F.col("pos").cast("bigint").alias("pos"), prob.alias("prob"), called.alias("called"), (called & (prob >= limit)).alias("methylated"))


def tag_quality(reads: DataFrame, key: str, basemod: str = "A+CG") -> DataFrame:
    """(key, n_segments, n_lost) of each read: well-formed segments, and calls for which the read has no base or no probability."""
    bases = bases_of(basemod)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lost = [decode_read(f or 0, int(s) if s == s and s is not None else None, c, q, m, p, bases, {})[1] for f, s, c, q, m, p in zip(b["flag"], b["start"], b["cigar"], b["seq"], b["mm"], b["ml"], strict=True)]
            yield pd.DataFrame({key: b[key], "n_segments": [len(segments(m)) for m in b["mm"]], "n_lost": lost})

    return reads.select(key, "flag", "start", "cigar", "seq", "mm", "ml").mapInPandas(run, f"{key} {reads.schema[key].dataType.simpleString()}, n_segments int, n_lost int")
