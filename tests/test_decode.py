import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from calypile.functions import reads as fr
from calypile.operators import decode as D
from pyspark.sql import functions as F

SCHEMA = "read_idx bigint, flag int, start bigint, cigar string, seq string, mm string, ml array<int>"


def brute(flag, start, cigar, seq, mm, ml, bases="AC", thresholds=(129, 129)):
    """Base by base, in the order of sequencing."""
    if not mm or not seq or start is None:
        return []
    where, at = [], start
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        for _ in range(int(n)):
            if op in "M=X":
                where.append(at)
                at += 1
            elif op in "IS":
                where.append(None)
            elif op in "DN":
                at += 1
    if flag & 16:
        seq = "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(c, c) for c in reversed(seq))
        where = where[::-1]
    segs = [(i, s) for i, s in enumerate(mm.split(";")) if re.fullmatch(r"[ACGTUN][+-][^,?.]+[?.]?(,\d+)*", s)]
    out, used = [], 0
    for i, s in segs:
        head, *deltas = s.split(",")
        probs = ml[len(ml) - len(deltas) :] if len(segs) == 2 and i == 1 else ml[used : used + len(deltas)]
        used += len(deltas)
        base = head[0]
        if base not in bases:
            continue
        own = [k for k, c in enumerate(seq) if c == base]
        called, o = {}, -1
        for d, p in zip(deltas, probs):
            o += int(d) + 1
            called[o] = p
        for o, k in enumerate(own):
            if where[k] is None:
                continue
            if base == "C" and not (k + 1 < len(seq) and seq[k + 1] == "G" and where[k + 1] is not None and abs(where[k + 1] - where[k]) == 1):
                continue
            p = called.get(o, 0)
            out.append((i, head.rstrip("?."), where[k], p, o in called, o in called and p >= thresholds[base == "C"]))
    return sorted(out)


@st.composite
def reads(draw):
    ops = draw(st.lists(st.tuples(st.integers(1, 9), st.sampled_from("MIDNSHP=X")), min_size=1, max_size=7))
    cigar = "".join(f"{n}{o}" for n, o in ops)
    n = sum(k for k, o in ops if o in "MIS=X")
    seq = "".join(draw(st.lists(st.sampled_from("ACGGCATN"), min_size=n, max_size=n)))
    flag = draw(st.sampled_from([0, 16]))
    forward = seq if not flag else seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    parts, ml = [], []
    for head in draw(st.sampled_from([["A+a"], ["C+m"], ["A+a", "C+m"], ["C+m?", "A+Y"], ["C+h", "C+m", "A+a"]])):
        own = sum(c == head[0] for c in forward)
        calls = sorted(draw(st.lists(st.integers(0, max(own - 1, 0)), unique=True, max_size=own)))
        parts.append(",".join([head, *(str(b - a - 1) for a, b in zip([-1, *calls], calls))]))
        ml += draw(st.lists(st.integers(0, 255), min_size=len(calls), max_size=len(calls)))
    return flag, draw(st.integers(0, 500)), cigar, seq, ";".join(parts) + ";", ml


@given(reads())
@settings(max_examples=300, deadline=None)
def test_kernel_equals_brute_force(read):
    got, lost = D.decode_read(*read[:5], np.array(read[5], int), "AC", {"A": 129, "C": 129})
    flat = sorted((i, m, int(a), int(b), bool(c), bool(d)) for i, m, p, q, r, s in got for a, b, c, d in zip(p, q, r, s))
    assert flat == brute(*read) and lost == 0


def random_reads(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        ops = [(rnd.randint(1, 9), rnd.choice("MMMMIDNSHP=X")) for _ in range(rnd.randint(1, 8))]
        size = sum(k for k, o in ops if o in "MIS=X")
        seq = "".join(rnd.choice("ACGGCAT") for _ in range(size))
        flag = rnd.choice([0, 16])
        forward = seq if not flag else seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
        parts, ml = [], []
        for head in rnd.choice([["A+a"], ["A+a", "C+m"], ["C+m", "A+a"], ["C+m", "C+h", "A+Y"]]):
            own = forward.count(head[0])
            calls = sorted(rnd.sample(range(own), rnd.randint(0, own)))
            parts.append(",".join([head, *(str(b - a - 1) for a, b in zip([-1, *calls], calls))]))
            ml += [rnd.randint(0, 255) for _ in calls]
        out.append((i, flag, rnd.randint(0, 99), "".join(f"{k}{o}" for k, o in ops), seq, ";".join(parts) + ";", ml))
    return out + [(n, 0, 5, "4M", "ACGT", None, None), (n + 1, 0, None, None, None, "A+a,0;", [200]), (n + 2, 4, None, "*", "", "A+a;", []), (n + 3, 0, 1, "3M", "AAA", "A+a,0,1;", [129, 128]), (n + 4, 0, 1, "3M", "AAA", "A+a,5;", [255])]


@pytest.mark.parametrize("basemod", ["A", "CG", "A+CG"])
def test_both_forms_equal_brute_force(spark, basemod):
    rows = random_reads(120, 7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted((r[0], *x) for r in rows for x in brute(*r[1:], bases=D.BASEMODS[basemod]))
    cols = ["read_idx", "mod_idx", "mod", "pos", "prob", "called", "methylated"]
    for got in (D.decode(df, ["read_idx"], basemod), D.decode_relational(df, "read_idx", basemod)):
        assert sorted(tuple(r) for r in got.select(cols).collect()) == want


def test_thresholds_empty_and_unknown_basemod(spark):
    df = spark.createDataFrame(random_reads(5, 1), SCHEMA)
    low = D.decode(df, ["read_idx"], thresh_a=1, thresh_c=1)
    assert low.where("methylated").count() == low.where("called and prob >= 1").count()
    empty = D.decode(spark.createDataFrame([], SCHEMA), ["read_idx"])
    assert empty.count() == 0 and empty.columns[-1] == "methylated"
    with pytest.raises(ValueError):
        D.decode(df, ["read_idx"], "G")


def test_spans_and_region_arrays(spark, monkeypatch):
    from calypile.operators import extract

    rows = [("s", *r[:1], f"n{r[0]}", *r[1:3], r[2] + 45 if r[2] is not None else None, *r[3:]) for r in random_reads(80, 3)]
    reads = spark.createDataFrame(rows, "sample string, read_idx bigint, name string, flag int, start bigint, `end` bigint, cigar string, seq string, mm string, ml array<int>").withColumn("chr", F.lit("c"))
    regions = spark.createDataFrame([("b", i, "c", 7 * i, 7 * i + n, "+-"[i % 2]) for i, n in enumerate([3, 20, 1, 9, 4, 60])] + [("b", 9, "d", 0, 99, "+")], "bed_id string, region_idx bigint, chr string, begin_pos bigint, end_pos bigint, strand string")
    plain = D.decode(reads, ["read_idx", "start", "end"]).collect()
    for centered, window in ((False, 0), (True, 5)):
        want = []
        for r in plain:
            for g in regions.where("chr = 'c'").collect():
                if not (r["start"] < g["end_pos"] and r["end"] > g["begin_pos"]):
                    continue
                mid = round((g["end_pos"] - g["begin_pos"]) / 2 + g["begin_pos"])
                rel = (1 if g["strand"] == "+" else -1) * (r["pos"] - mid)
                if (abs(rel) <= window) if centered else (g["begin_pos"] < r["pos"] < g["end_pos"]):
                    want.append((r["read_idx"], g["region_idx"], r["mod"], rel if centered else r["pos"], r["prob"]))
        for limit in (50_000, 2):
            monkeypatch.setattr(extract, "BROADCAST_ROWS", limit)
            got = extract.sites(reads, regions, centered=centered, window=window)
            assert sorted(tuple(x) for x in got.select("read_idx", "region_idx", "mod", "pos", "prob").collect()) == sorted(want) and want


def test_sites_are_tallied_where_they_are_decoded(spark, monkeypatch):
    from calypile import api
    from calypile.operators import calls as C
    from calypile.operators import extract

    rows = [("s", *r[:1], f"n{r[0] % 70}", *r[1:3], r[2] + 45 if r[2] is not None else None, *r[3:]) for r in random_reads(80, 3)]
    reads = spark.createDataFrame(rows, "sample string, read_idx bigint, name string, flag int, start bigint, `end` bigint, cigar string, seq string, mm string, ml array<int>").withColumn("chr", F.lit("c"))
    table = [(f"b{i % 2}", (i * 5) % 23, "c", 4 * i % 90, 4 * i % 90 + 1 + i % 40, "+-"[i % 2]) for i in range(200)] + [("b0", None, "c", 3, 90, "+"), ("b1", 9, "d", 0, 99, "+")]
    regions = spark.createDataFrame([(b, None if x is None else i, *r) for i, (b, x, *r) in enumerate(table)], "bed_id string, region_idx bigint, chr string, begin_pos bigint, end_pos bigint, strand string")
    plain = lambda df: sorted(map(str, df.collect()))
    monkeypatch.setattr(extract, "PAIRS", 100)
    for limit, cases in ((50_000, ((False, True), (True, False), (True, True))), (2, ((False, False), (True, False)))):
        monkeypatch.setattr(extract, "BROADCAST_ROWS", limit)
        for centered, all_bases in cases:
            every = extract.sites(reads, regions, centered=centered, window=30, columns=extract.CALLS)
            found = extract.tallied(reads, regions, centered=centered, window=30, by_bed=True, all_bases=all_bases).cache()
            keys = ["bed_id", "sample", "pos", "mod"] + ([] if centered else ["chr"])
            assert plain(extract.tallied_pileup(found, keys).select(sorted(keys) + ["methylated_bases", "total_bases"])) == plain(C.pileup(every, keys, flag="methylated").select(sorted(keys) + ["methylated_bases", "total_bases"]))
            assert plain(extract.site_pileup(found, centered)) == plain(extract.site_pileup(every, centered))
            want = plain(extract.calls(every, all_bases))
            again = extract.names_again(found)
            assert again.count() > 0 and plain(extract.tallied_calls(found)) == want and plain(extract.tallied_calls(found, again)) == want
            # one row for a read and position, however many regions it is in
            rows_of = found.where("total_bases is null")
            assert rows_of.count() == rows_of.select("read_idx", "pos").distinct().count() and every.count() > 5 * rows_of.count()
            found.unpersist()
    monkeypatch.setattr(extract, "sites", None)  # the reports must not list a row for each pair of a site and a region
    assert api.parse_bam(spark, reads, "s", bed_file=regions)["pileup"].count() > 0
    assert api.plot_enrichment_profile(spark, reads, "s", regions.where("bed_id = 'b0'"), "A", window_size=30)["profile"].count() > 0


def test_many_regions_of_one_chr(spark):
    from calypile.operators import extract

    rng = np.random.default_rng(8)
    begins = np.sort(rng.integers(0, 4_000_000, 49_000))
    table = [("b", i, "c", int(a), int(a) + int(n), "+-"[i % 2]) for i, (a, n) in enumerate(zip(begins, rng.integers(1, 300, len(begins))))] + [("b", -1, "c", 10, 3_999_990, "+"), ("b", -2, "c", 5, 5, "+"), ("b", -3, None, 5, 9, "+"), ("b", -4, "c", None, 9, None)]
    regions = spark.createDataFrame(table, "bed_id string, region_idx bigint, chr string, begin_pos bigint, end_pos bigint, strand string")
    rows = [("s", i, f"n{i}", 16 * (i % 2), int(a), int(a) + 60, "60M", "ACGT" * 15, "A+a,0,1;", [200, 100]) for i, a in enumerate(rng.integers(0, 4_100_000, 300))]
    reads = spark.createDataFrame(rows, "sample string, read_idx bigint, name string, flag int, start bigint, `end` bigint, cigar string, seq string, mm string, ml array<int>").withColumn("chr", F.lit("c"))
    plain = D.decode(reads, ["read_idx"], "A").collect()
    lo, hi = (np.array([t[k] for t in table if t[2] and t[3] is not None and t[3] < t[4]]) for k in (3, 4))
    want = sorted((r["read_idx"], r["pos"], int(((lo < r["pos"]) & (r["pos"] < hi)).sum())) for r in plain)
    got = extract.sites(reads, regions, "A", columns=("read_idx", "pos", "region_idx")).groupBy("read_idx", "pos").count().collect()
    assert sorted(map(tuple, got)) == [w for w in want if w[2]]
    wide = extract.sites(reads, regions.where("region_idx = -1"), "A", columns=("read_idx",))
    assert wide.count() == sum(10 < r["pos"] < 3_999_990 for r in plain)
    assert extract.sites(reads, regions.limit(0)).count() == 0 and extract.sites(reads.limit(0), regions).count() == 0


def test_lost_calls_are_counted(spark):
    got = {r["read_idx"]: (r["n_segments"], r["n_lost"]) for r in D.tag_quality(spark.createDataFrame(random_reads(2, 1), SCHEMA), "read_idx").collect()}
    assert got[6] == (1, 1) and got[2] == (0, 0) and got[5] == (1, 0)


def test_cigar_functions(spark):
    df = spark.createDataFrame([("2H5S20M3I10M2D4=1X6N2M1S", 100), (None, 5), ("*", 5)], "c string, s bigint")
    a, b, c = df.select(fr.aligned_blocks(F.col("c"), F.col("s")).alias("b"), fr.reference_length(F.col("c")).alias("r"), fr.query_length(F.col("c")).alias("q")).collect()
    assert [tuple(x) for x in a["b"]] == [(5, 100, 20), (28, 120, 10), (38, 132, 4), (42, 136, 1), (43, 143, 2)]
    assert (a["r"], a["q"]) == (45, 46) and b["b"] is None and c["b"] is None


def test_qualities(spark):
    rows = [([10, 20, 30], "1S1M1S"), ([], "3M"), (None, None), ([7], "1M"), ([5, 6, 7, 8], "2H1S3M2H")]
    got = spark.createDataFrame(rows, "q array<int>, c string").select(fr.mean_phred(F.col("q")).alias("m"), fr.aligned_quals(F.col("q"), F.coalesce("c", F.lit(""))).alias("a")).collect()
    assert got[0]["m"] == pytest.approx(-10 * np.log10(np.mean([0.1, 0.01, 0.001]))) and got[0]["a"] == [20]
    assert got[1]["m"] is None and got[2]["m"] is None and got[3]["m"] == pytest.approx(7) and got[4]["a"] == [6, 7, 8]
