import json
import random
import re
import struct
import zlib

import pytest

from calypile import api, cli, figures
from calypile.operators.decode import reference_positions
from calypile.sources import bam, bed, sam, tables

SAM = [
    "@HD\tVN:1.6",
    "@SQ\tSN:chr1\tLN:100000",
    "r1\t0\tchr1\t101\t60\t2S10M1I5M\t*\t0\t0\tGGACGAACGATACGCGTA\tIIIIIIIIIIIIIIIIII\tMm:Z:A+a,0,1;C+m,0;\tMl:B:C,200,100,250",
    "r2\t16\tchr1\t105\t20\t12M\t*\t0\t0\tTCGTTCGTACGA\t*\tMM:Z:C+m,0,1;\tML:B:C,129,10",
    "r3\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t!!!!",
    "r1\t256\tchr2\t11\t5\t4M\t*\t0\t0\tACGA\tABCD\tMm:Z:A+a;C+m,0;\tMl:B:C,255",
]
REFS = [("chr1", 100000), ("chr2", 5000)]


def bgzf(data: bytes, size: int) -> bytes:
    out = b""
    for at in [*range(0, len(data), size), None]:
        chunk = b"" if at is None else data[at : at + size]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(chunk) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(chunk), len(chunk))
    return out


def encode(line: str) -> bytes:
    f = line.split("\t")
    names = [r[0] for r in REFS]
    ref = names.index(f[2]) if f[2] in names else -1
    ops = [] if f[5] == "*" else __import__("re").findall(r"(\d+)([MIDNSHP=X])", f[5])
    cigar = b"".join(struct.pack("<I", int(n) << 4 | "MIDNSHP=X".index(o)) for n, o in ops)
    seq = f[9]
    nib = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
    qual = b"\xff" * len(seq) if f[10] == "*" else bytes(ord(c) - 33 for c in f[10])
    extra = b"NMi" + struct.pack("<i", 3)
    for t in f[11:]:
        name, kind, value = t.split(":", 2)
        if kind == "Z":
            extra += name.encode() + b"Z" + value.encode() + b"\0"
        else:
            nums = [int(x) for x in value.split(",")[1:]]
            extra += name.encode() + b"BC" + struct.pack("<i", len(nums)) + bytes(nums)
    name = f[0].encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, int(f[3]) - 1, len(name), int(f[4]), 0, len(ops), int(f[1]), len(seq), -1, -1, 0)
    body += name + cigar + bytes(a << 4 | b for a, b in zip(nib[::2], nib[1::2])) + qual + extra
    return struct.pack("<i", len(body)) + body


def write_bam(path, lines, size=60000, order=b""):
    text = b"@HD\tVN:1.6" + order + b"\n"
    data = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(REFS))
    for name, n in REFS:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    path.write_bytes(bgzf(data + b"".join(encode(x) for x in lines if x[0] != "@"), size))


def plain(rows):
    return sorted((tuple(x if not isinstance(x, list) else tuple(x) for x in r) for r in rows), key=repr)


def test_bam_and_sam_agree(spark, tmp_path):
    (tmp_path / "a.sam").write_text("\n".join(SAM) + "\n")
    many = [SAM[2:][i % 4].replace("r", f"x{i}r", 1) for i in range(400)]
    (tmp_path / "b.sam").write_text("\n".join(many))
    write_bam(tmp_path / "a.bam", SAM)
    write_bam(tmp_path / "b.bam", many, size=700)
    for stem, split in (("a", 1 << 20), ("b", 1 << 20), ("b", 2000), ("b", 500)):
        want = sam.read_sam(spark, str(tmp_path / f"{stem}.sam"), "s").drop("read_idx")
        got = bam.read_bam(spark, str(tmp_path / f"{stem}.bam"), "s", split).drop("read_idx")
        assert plain(got.collect()) == plain(want.collect())
    rows = bam.read_bam(spark, str(tmp_path / "b.bam"), "s", 500)
    assert rows.rdd.getNumPartitions() > 3
    assert rows.where("chr = 'chr1' and start < 103 and end > 10").count() == 100
    assert rows.select("read_idx").distinct().count() == 400


def test_a_region_reads_only_its_records(spark, tmp_path):
    many = [SAM[2:][i % 4].replace("r", f"x{i}r", 1) for i in range(400)]
    write_bam(tmp_path / "b.bam", many, size=700)
    whole = bam.read_bam(spark, str(tmp_path / "b.bam"), "s")
    for region, chr_, a, b in (("chr1:10-103", "chr1", 10, 103), ("chr1:116-200", "chr1", 116, 200), ("chr2:1-9", "chr2", 1, 9), ("none:1-9", "none", 1, 9)):
        part = bam.read_bam(spark, str(tmp_path / "b.bam"), "s", 900, region).drop("read_idx")
        ordered = sorted(many, key=lambda x: (x.split("\t")[2] == "*", x.split("\t")[2], int(x.split("\t")[3])))
        write_bam(tmp_path / "o.bam", ordered, 700, b"\tSO:coordinate")
        assert plain(bam.read_bam(spark, str(tmp_path / "o.bam"), "s", 900, region).drop("read_idx").collect()) == plain(part.collect())
        want = whole.where((whole["chr"] == chr_) & (whole["start"] < b) & (whole["end"] > a)).drop("read_idx")
        assert plain(part.collect()) == plain(want.collect())


def long_reads(n, length=100_000):
    rng = random.Random(n)
    seq, qual = "".join(rng.choices("ACGT", k=length)), "".join(rng.choices("+5?I", k=length))
    return [f"long{i}\t0\tchr1\t{1 + 20_000 * i}\t60\t{length}M\t*\t0\t0\t{seq}\t{qual}" for i in range(n)]


def names_by_part(path, split, region=None):
    reader = bam.BamReader({"path": str(path), "split_bytes": str(split)} | ({"region": region} if region else {}))
    return [[x for batch in reader.read(part) for x in batch.column("name").to_pylist()] for part in reader.partitions()]


def test_last_parts_of_long_reads(tmp_path):
    write_bam(tmp_path / "l.bam", long_reads(9))
    whole, last = [f"long{i}" for i in range(9)], set()
    for split in range(50_000, 450_000, 20_000):
        parts = names_by_part(tmp_path / "l.bam", split)
        assert [x for part in parts for x in part] == whole
        last.add(len(parts[-1]))
    assert last >= {1, 2, 3, 4}


def test_an_index_into_the_last_long_reads(tmp_path):
    lines = long_reads(8)
    write_bam(tmp_path / "i.bam", lines, order=b"\tSO:coordinate")
    blocks, at = [], 0  # (uncompressed bytes before, file offset)
    raw, before = (tmp_path / "i.bam").read_bytes(), 0
    while at < len(raw):
        blocks.append((before, at))
        at += struct.unpack_from("<H", raw, at + 16)[0] + 1
        before += struct.unpack_from("<I", raw, at - 4)[0]
    place = blocks[-1][0] - sum(len(encode(x)) for x in lines)
    spans = []  # (begin, end, virtual offset)
    for x in lines:
        within, offset = max(b for b in blocks if b[0] <= place)
        begin = int(x.split("\t")[3]) - 1
        spans.append((begin, begin + 100_000, offset << 16 | place - within))
        place += len(encode(x))
    windows = [min(v for b, e, v in spans if b < (k + 1) << 14 and e > k << 14) for k in range(spans[-1][1] // (1 << 14))]
    (tmp_path / "i.bam.bai").write_bytes(b"BAI\1" + struct.pack("<iii", 2, 0, len(windows)) + b"".join(struct.pack("<Q", v) for v in windows) + struct.pack("<ii", 0, 0))
    for k in range(1, 5):
        begin = spans[-k - 1][1] + 1_000
        assert names_by_part(tmp_path / "i.bam", 64 << 20, f"chr1:{begin}-{begin + 500}") == [[f"long{i}" for i in range(8 - k, 8) if spans[i][0] < begin + 500]]


def reg2bin(begin, end):
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == (end - 1) >> shift:
            return first + (begin >> shift)
    return 0


def write_index(path, lines):
    """A .bai of a sorted file: bins with chunks, and the linear index."""
    raw, blocks, at, before = path.read_bytes(), [], 0, 0
    while at < len(raw):
        blocks.append((before, at))
        at += struct.unpack_from("<H", raw, at + 16)[0] + 1
        before += struct.unpack_from("<I", raw, at - 4)[0]
    place = before - sum(len(encode(x)) for x in lines)
    virtual = lambda p: (lambda b: b[1] << 16 | p - b[0])(max(b for b in blocks if b[0] <= p))
    bins, linear = {}, {}
    for x in lines:
        begin = int(x.split("\t")[3]) - 1
        end = begin + sum(int(n) for n, o in re.findall(r"(\d+)([MDN=X])", x.split("\t")[5]))
        bins.setdefault(reg2bin(begin, end), []).append((virtual(place), virtual(place + len(encode(x)))))
        for k in range(begin >> 14, ((end - 1) >> 14) + 1):
            linear.setdefault(k, virtual(place))
        place += len(encode(x))
    n = max(linear) + 1
    body = struct.pack("<i", len(bins)) + b"".join(struct.pack("<II", b, len(c)) + b"".join(struct.pack("<QQ", *v) for v in c) for b, c in sorted(bins.items()))
    body += struct.pack("<i", n) + b"".join(struct.pack("<Q", linear.get(k, 0)) for k in range(n))
    path.with_suffix(".bam.bai").write_bytes(b"BAI\1" + struct.pack("<i", 2) + body + struct.pack("<ii", 0, 0))


def test_many_regions_by_the_index(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    begins = sorted(rng.randrange(0, 4_000_000) for _ in range(900))
    lines = ["\t".join([f"q{i}", "0", "chr1", str(b + 1), "60", f"{rng.choice([60, 600, 30_000])}N2M", "*", "0", "0", "AC", "II"]) for i, b in enumerate(begins)]
    path = tmp_path / "m.bam"
    write_bam(path, lines, 900, b"\tSO:coordinate")
    spans = [(b, b + sum(int(n) for n, o in re.findall(r"(\d+)([MN])", x.split("\t")[5]))) for b, x in zip(begins, lines)]
    read = []
    more = bam.Blocks.more
    monkeypatch.setattr(bam.Blocks, "more", lambda self: (read.append(self.at), more(self))[1])

    def names(regions, split=64 << 20):
        reader = bam.BamReader({"path": str(path), "split_bytes": str(split), "regions": json.dumps(regions)})
        read.clear()
        return [x for p in reader.partitions() for b in reader.read(p) for x in b.column("name").to_pylist()], len(reader.partitions())

    sets = [[("chr1", 50_000, 50_500)], [("chr1", a, a + 300) for a in range(0, 4_000_000, 400_000)] + [("chr2", 1, 9), ("none", 1, 9)], [("chr1", 0, 4_900_000)], [("chr1", 4_000_000, 4_900_000)], [("chr1", 7, 7)], []]
    want = [[f"q{i}" for i, (a, b) in enumerate(spans) if any(c == "chr1" and a < e and b > s for c, s, e in rs if s < e)] for rs in sets]
    whole = [names(rs)[0] for rs in sets]
    assert whole == want  # without an index: every record is looked at
    names(sets[2])
    n_blocks = len(set(read))
    write_index(path, lines)
    for rs, w in zip(sets, want):
        for split in (64 << 20, 3000):
            got, parts = names(rs, split)
            assert got == w
            if split > 3000:
                assert parts <= 1
        if rs in sets[:2]:
            names(rs)
            assert len(set(read)) < n_blocks * (0.25 if len(rs) == 1 else 0.75)
    rows = bam.read_bam(spark, str(path), "s", regions=sets[1])
    assert sorted(r["name"] for r in rows.select("name").collect()) == sorted(want[1])


def test_written_bam_reads_back(spark, tmp_path):
    from calypile.sources import bam_write

    n = 40_000
    rows = [("a", 0, "chr1", 100, 60, "4M", "ACGT", [1, 2, 3, 4], "C+m,0;", [200]), ("b", 4, None, None, None, None, "ACGTN", None, None, None), ("c", 16, "chr2", 5, 0, "2M1I" * n, "ACG" * n, None, "A+a;", []), ("d", 4, None, None, 0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, flag int, chr string, start bigint, mapq int, cigar string, seq string, quals array<int>, mm string, ml array<int>").repartition(2)
    bam_write.write_bams(df, str(tmp_path / "w"), REFS)
    bam_write.write_bams(df, str(tmp_path / "w"), REFS)  # a repeated task replaces its file
    got = {r["name"]: r for r in bam.read_bam(spark, str(tmp_path / "w"), "s").collect()}
    for r in rows:
        assert [got[r[0]][c] for c in ("flag", "chr", "start", "cigar", "seq", "quals", "mm", "ml")] == [r[1], r[2], r[3], r[5], r[6], r[7], r[8], r[9]]
    assert got["c"]["end"] == 5 + 2 * n and got["b"]["mapq"] == 0
    with pytest.raises(ValueError):
        bam.BamReader({"path": "s3a://bucket/x.bam"})


def test_records_that_end_with_their_block(tmp_path):
    short = ["\t".join([f"s{i}", "0", "chr1", "101", "60", "4M", "*", "0", "0", "ACGA", "ABCD"]) for i in range(12)]
    end = bgzf(b"", 1)
    pairs = [b"".join(encode(x) for x in short[i : i + 2]) for i in range(2, 12, 2)]
    text = b"@HD\tVN:1.6\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 100000)
    first = encode(long_reads(1, 70_000)[0])
    chunks = [head, first[:60_000], first[60_000:] + encode(short[0]) + encode(short[1]), *pairs]
    (tmp_path / "s.bam").write_bytes(b"".join(bgzf(c, len(c))[: -len(end)] for c in chunks) + end)
    for split in (100, 1_000, 30_000, 50_000):
        assert [x for part in names_by_part(tmp_path / "s.bam", split) for x in part] == ["long0", *(f"s{i}" for i in range(12))]


def test_operations_in_the_cg_tag(tmp_path):
    n = 40_000
    seq, cigar = "ACG" * n, "2M1I" * n
    ops = b"".join(struct.pack("<I", k << 4 | op) for k, op in ((2, 0), (1, 1))) * n
    plain_record = encode(f"r\t0\tchr1\t101\t60\t{3 * n}S{2 * n}N\t*\t0\t0\t{seq}\t*\tMm:Z:C+m,0;\tMl:B:C,200")[4:]
    got = bam.record(plain_record + b"CGBI" + struct.pack("<i", 2 * n) + ops + b"MNC\1", ["chr1", "chr2"])
    assert got[3:5] == (100, 100 + 2 * n) and got[6] == cigar and got[9:] == ("C+m,0;", [200])
    assert (reference_positions(got[6], got[3]) >= 0).sum() == 2 * n
    assert bam.record(plain_record, ["chr1", "chr2"])[6] == f"{3 * n}S{2 * n}N"
    own = encode("r\t0\tchr1\t101\t60\t4M\t*\t0\t0\tACGT\t*")[4:] + b"CGBI" + struct.pack("<i", 2) + ops[:8]
    assert bam.record(own, ["chr1", "chr2"])[6] == "4M"


def test_bed_files(spark, tmp_path):
    (tmp_path / "x.bed").write_text("# note\nchr1\t10\t20\t-\t5\nchr2\t30\t40\tname\nchr3\t1\t2\n\n")
    got = bed.read_regions(spark, str(tmp_path / "x.bed")).orderBy("region_idx").collect()
    assert [(r["bed_id"], r["chr"], r["begin_pos"], r["end_pos"], r["strand"]) for r in got] == [("x", "chr1", 10, 20, "-"), ("x", "chr2", 30, 40, "+"), ("x", "chr3", 1, 2, "+")]
    assert [r["name"] for r in bed.read_annotation(spark, str(tmp_path / "x.bed")).orderBy("begin_pos").collect()] == ["noname", "-", "name"]


def test_samples_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_samples(spark.createDataFrame([("a", 1), ("b", 2)], "sample string, x int"), path)
    tables.write_samples(spark.createDataFrame([("b", 3)], "sample string, x int"), path)
    assert sorted((r["sample"], r["x"]) for r in tables.read_samples(spark, path).collect()) == [("a", 1), ("b", 3)]
    assert tables.read_samples(spark, path, ["a"]).count() == 1


@pytest.fixture
def files(tmp_path):
    (tmp_path / "one.sam").write_text("\n".join(SAM) + "\n")
    write_bam(tmp_path / "one.bam", SAM)
    (tmp_path / "w.bed").write_text("chr1\t98\t118\t+\nchr2\t5\t20\t-\n")
    (tmp_path / "v.bed").write_text("chr2\t5\t20\n")
    return tmp_path


def test_reports(spark, files, tmp_path):
    one, out = str(files / "one.bam"), str(tmp_path / "out")
    got = api.parse_bam(spark, one, "s1", out, bed_file=str(files / "w.bed"))
    same = api.parse_bam(spark, str(files / "one.sam"), "s1", bed_file=str(files / "w.bed"))
    cols = ["id", "chr", "pos", "prob", "mod"]
    assert plain(got["calls"].select(cols).collect()) == plain(same["calls"].select(cols).collect())
    assert [r["prob"] for r in got["calls"].where("id = 'r1:100'").collect()] == [200]
    assert tables.read_samples(spark, got["manifest"]["pileup"], ["s1"]).count() == got["pileup"].count() > 3
    region = api.parse_bam(spark, one, "s1", out, region="chr1:98-118", extract_all_bases=True)
    assert len(region["manifest"]["beds"]) == 2 and region["calls"].where("prob = 0").count() > 0
    view = api.plot_browser(spark, one, "s1", "chr1:98-118", out_dir=out, smooth=5, min_periods=1, bed_features=str(files / "w.bed"))
    assert view["reads"].count() == 2 and view["annotation_0"].count() == 1
    page = open(view["manifest"]["page"]).read()
    assert "<svg" in page and "<line " in page and "<polyline" in page
    drawn = api.plot_browser(spark, one, "s1", "chr1:98-118", out_dir=out, smooth=5, min_periods=1, color_a="#123456", dot_size=6, static=True)["manifest"]["page"]
    assert drawn.endswith(".svg") and "#123456" in open(drawn).read() and 'r="3"' in open(drawn).read()
    bars = api.plot_enrichment(spark, one, "s1", [str(files / "w.bed"), str(files / "v.bed")], "CG", out)["manifest"]["page"]
    assert open(bars).read().count("<rect") == 2
    profile = open(api.plot_enrichment_profile(spark, one, "s1", str(files / "w.bed"), out_dir=out, smooth=3, min_periods=1, window_size=50)["manifest"]["page"]).read()
    assert profile.count("<polyline") >= 3 and "<circle" in profile
    bars = api.plot_enrichment(spark, one, "s1", [str(files / "w.bed"), str(files / "v.bed")], "CG")["enrichment"].collect()
    assert len(bars) == 2 and all(0 <= r["fraction_methylated"] <= 1 for r in bars)
    single = api.plot_enrichment_profile(spark, one, "s1", str(files / "w.bed"), smooth=3, min_periods=1, window_size=50)
    assert {"profile", "molecules", "base_counts"} <= set(single) and single["molecules"].count() > 0 and single["base_counts"].count() > 0
    report = api.qc_report(spark, [one], ["s1"], out)
    assert report["reads"].count() == 4 and api.qc_report(spark, one, "s1", primary_only=True)["reads"].count() == 3
    assert report["totals"].first()["n_reads"] == 4


def test_figure_data_is_compressed_and_not_shuffled(spark, tmp_path):
    from calypile.operators import calls as C

    calls = spark.range(40_000).selectExpr("'s' as sample", "concat('read', id % 400) as read_name", "id div 400 - 50 as pos", "'C+m' as mod")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        few, many = C.points(calls, ["sample"], few=True), C.points(calls, ["sample"])
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
        plan = few._jdf.queryExecution().optimizedPlan().toString()
        assert "broadcast" in plan and "broadcast" not in many._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    folder = figures.write_data({"molecules": few}, str(tmp_path))["molecules"]
    written = list((tmp_path / "molecules").glob("part-*"))
    assert written and all(p.name.endswith(".json.gz") for p in written)
    text = sum(len(json.dumps(r.asDict(), separators=(",", ":"))) + 1 for r in few.collect())
    assert sum(p.stat().st_size for p in written) < text / 8
    assert sorted(map(str, spark.read.schema(few.schema).json(folder).collect())) == sorted(map(str, few.collect()))


def test_pages_show_all_rows(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id as x", "cast(id = 19999 as int) as y", "if(id = 19999, 'C', 'A') as family")
    none = rows.where("x < 0")
    page = open(figures.write_page(str(tmp_path / "p.html"), "t", {"p": (rows, "x", "y", "family"), "q": (none, "x", "y", "family")}, {"n": rows.where("x < 6000")})).read()
    assert page.count('class="A"') == 881 and page.count('<circle cx="890" cy="10" r="1.5" class="C"/>') == 1
    static = open(figures.write_page(str(tmp_path / "s.html"), "t", {"b": ("bars", rows.where("x < 3"), "family", "x", "family"), "l": ("line", rows, "x", "y", "family"), "s": ("spans", rows, "x", "x", "y"), "none": ("line", none, "x", "y", "family")}, {}, ["#010203"], static=True)).read()
    assert static.startswith("<svg") and static.count("<rect") == 3 and static.count("<polyline") == 2 and static.count("<line ") == 2 and "#010203" in static and "no data" in static
    assert "20000 points, 0 to 19999, 0 to 1" in page and "no data" in page
    assert page.count("<tr>") == 6001


def test_errors(spark, files):
    one, bed_path = str(files / "one.bam"), str(files / "w.bed")
    with pytest.raises(RuntimeError):
        api.parse_bam(spark, one, "s", bed_file=bed_path, region="chr1:1-2")
    with pytest.raises(RuntimeError):
        api.parse_bam(spark, one, "s")
    with pytest.raises(RuntimeError):
        api.parse_bam(spark, one, "s", region="chr1:1-2", center=True)
    with pytest.raises(TypeError):
        api.parse_bam(spark, one, "s", region="chr1")
    with pytest.raises(RuntimeError):
        api.plot_enrichment(spark, one, "s", bed_path, "A+CG")
    with pytest.raises(RuntimeError):
        api.plot_enrichment(spark, [one, one], ["s", "t"], [bed_path, bed_path], "A")
    with pytest.raises(RuntimeError):
        api.plot_enrichment_profile(spark, [one, one], ["s", "t"], [bed_path, bed_path], "A")
    with pytest.raises(RuntimeError):
        api.plot_enrichment_profile(spark, [one, one], ["s", "t"], bed_path, "A+CG")
    with pytest.raises(ValueError):
        api.qc_report(spark, [one, one], ["s"])
    with pytest.raises(ValueError):
        api.qc_report(spark, one, "bad name")


def test_command_line(spark, files, tmp_path, capsys):
    manifest = cli.main(["qc-report", "-f", str(files / "one.bam"), "-s", "s1", "-o", str(tmp_path / "q")])
    assert {"reads", "summary", "page"} <= set(manifest)
    assert cli.main(["parse-bam", "-f", str(files / "one.bam"), "-s", "s1", "-o", str(tmp_path / "q"), "-r", "chr1:98-118", "-m", "A"])["beds"]
    with pytest.raises(SystemExit):
        cli.main(["parse-bam", "-f", "x", "-s", "s", "-o", "o", "-b", "b", "-r", "chr1:1-2"])
    with pytest.raises(SystemExit):
        cli.main(["plot-enrichment", "-f", "x", "-s", "s", "-o", "o", "-b", "b", "-m", "A+CG"])


def test_installed_commands(monkeypatch, capsys):
    import pathlib
    import sys
    import tomllib

    scripts = tomllib.loads((pathlib.Path(__file__).parent.parent / "pyproject.toml").read_text())["project"]["scripts"]
    for name, target in scripts.items():
        monkeypatch.setattr(sys, "argv", [name, "--help"])
        with pytest.raises(SystemExit) as left:
            getattr(cli, target.split(":")[1])()
        assert left.value.code == 0 and name.removeprefix("calypile-") in capsys.readouterr().out
    assert len(scripts) == 5
