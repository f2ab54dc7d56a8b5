"""Queries over files: sources and sinks read back, and the reports made from BAM, SAM and BED files; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calypile import api, cli
from calypile.operators import calls as C
from calypile.operators import decode as D
from calypile.operators import qc
from calypile.plans import reports
from calypile.session import checkpoint_dir
from calypile.sources import bam, bam_write, bed, sam, tables

CONTIGS = [(f"chr{i}", 300_000_000) for i in range(3)]
COLUMNS = ["name", "flag", "chr", "start", "end", "mapq", "cigar", "seq", "quals", "mm", "ml"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def made_records(spark: SparkSession, d: str) -> DataFrame:
    """The made reads with mapping and base qualities; every 11th is secondary, every 13th unmapped, every 5th without qualities."""
    k, n = F.col("read_idx"), F.length("seq")
    out = (k % 13) == 0
    flag = F.col("flag") + F.when(k % 11 == 0, 256).otherwise(0) + F.when(out, 4).otherwise(0)
    quals = F.when(k % 5 != 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((i * 7 + k) % 41).cast("int")))
    mapped = lambda c: F.when(~out, F.col(c)).alias(c)
    return reports.made_reads(spark, d).select("sample", "read_idx", "name", flag.alias("flag"), mapped("chr"), mapped("start"), mapped("end"), (k % 61).cast("int").alias("mapq"), mapped("cigar"), "seq", quals.alias("quals"), "mm", "ml")


def _bams(spark: SparkSession, d: str) -> str:
    return bam_write.write_bams(made_records(spark, d), _folder(spark, "bams"), CONTIGS)


def _bed(spark: SparkSession, d: str) -> str:
    """The made regions as a BED file."""
    path = _folder(spark, "made") + ".bed"
    reports.made_regions(spark, d).select(F.concat_ws("\t", "chr", "begin_pos", "end_pos", "strand")).write.text(path)
    return path


def _flat(reads: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return reads.select(*[text(c) if c in ("quals", "ml") else c for c in COLUMNS])


def bam_read(spark, d):
    """The records written as BAM and read back."""
    return _flat(bam.read_bam(spark, _bams(spark, d), "made"))


def sam_read(spark, d):
    """The records written as SAM text and read back."""
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    quals = F.coalesce(F.array_join(F.transform("quals", lambda q: F.char(q + 33)), ""), F.lit("*"))
    ml = F.concat(F.lit("ML:B:C"), F.array_join(F.transform("ml", lambda x: F.concat(F.lit(","), x.cast("string"))), ""))
    fields = [F.col("name"), F.col("flag"), star("chr"), F.coalesce(F.col("start") + 1, F.lit(0)), F.col("mapq"), star("cigar"), F.lit("*"), F.lit(0), F.lit(0), F.col("seq"), quals, F.concat(F.lit("MM:Z:"), "mm"), ml]
    path = _folder(spark, "sam")
    made_records(spark, d).select(F.concat_ws("\t", *[f.cast("string") for f in fields])).write.text(path)
    return _flat(sam.read_sam(spark, path, "made"))


def bed_read(spark, d):
    """The regions written as a BED file and read back; anything but + and - in the strand column reads as +."""
    path = _folder(spark, "regions") + ".bed"
    reports.regions_of(spark, d).select(F.concat_ws("\t", "chr", "begin_pos", "end_pos", F.coalesce("strand", F.lit("")))).write.text(path)
    return bed.read_regions(spark, path, "r").select("bed_id", "chr", "begin_pos", "end_pos", "strand")


def annotation_read(spark, d):
    path = _folder(spark, "features") + ".bed"
    reports.regions_of(spark, d).select(F.concat_ws("\t", "chr", "begin_pos", "end_pos", F.coalesce("strand", F.lit("")))).write.text(path)
    return bed.read_annotation(spark, path)


def bam_region(spark, d):
    """Only the reads that overlap one region, by the reader's option."""
    return bam.read_bam(spark, _bams(spark, d), "made", region="chr1:20,000-60000").select("name", "start", "end")


def bam_regions(spark, d):
    """Only the reads that overlap one of the regions of a BED file, by the reader's option."""
    spans = [(r["chr"], r["begin_pos"], r["end_pos"]) for r in reports.made_regions(spark, d).toLocalIterator()]
    return bam.read_bam(spark, _bams(spark, d), "made", regions=spans).select("name", "start", "end")


def mm_decode_rows(spark, d):
    """Every decoded base of the records in the BAM files, row by row."""
    return D.decode(bam.read_bam(spark, _bams(spark, d), "made"), ["name"]).select("name", "mod", "pos", "prob", "called", "methylated")


def qc_rows(spark, d):
    """The read quality table of the BAM files."""
    rows = qc.qc_rows(bam.read_bam(spark, _bams(spark, d), "made"))
    return reports.r6(rows.drop("sample"), "ave_baseq", "ave_alignq")


def qc_primary(spark, d):
    rows = qc.qc_rows(bam.read_bam(spark, _bams(spark, d), "made"), primary_only=True)
    return rows.agg(F.count(F.lit(1)).alias("n_reads"), F.sum("length").alias("n_bases"))


def summary_bed_file(spark, d):
    """The summary BED of each mod family, written and read back."""
    paths = tables.write_summary_beds(reports.piled_of(spark, d), _folder(spark, "summary"), "made")
    cols = 'chr string, start bigint, "end" bigint, methylated_bases bigint, total_bases bigint'.replace('"', "`")
    parts = [spark.read.schema(cols).csv(p, sep="\t").withColumn("label", F.lit(label)) for p, label in zip(paths, ("A", "CG"), strict=True)]
    return parts[0].unionByName(parts[1])


# --- reports


def report_parse_bam(spark, d):
    """The stored pileup of one sample's BAM files inside the regions of a BED file."""
    out = api.parse_bam(spark, _bams(spark, d), "made", _folder(spark, "parsed"), bed_file=_bed(spark, d))
    return tables.read_samples(spark, out["manifest"]["pileup"], ["made"])


def report_calls_region(spark, d):
    """The calls of all candidate bases in one region."""
    return api.parse_bam(spark, _bams(spark, d), "made", region="chr1:20,000-60000", extract_all_bases=True)["calls"]


def report_enrichment(spark, d):
    """The fraction modified of two samples over one BED file."""
    path = _bams(spark, d)
    return reports.r6(api.plot_enrichment(spark, [path, path], ["one", "two"], _bed(spark, d), "A")["enrichment"].select("sample", "fraction_methylated"), "fraction_methylated")


def report_profile(spark, d):
    """The smoothed curve around the centres of the regions."""
    out = api.plot_enrichment_profile(spark, _bams(spark, d), "made", _bed(spark, d), "A", window_size=200)
    return reports.r6(out["profile"].select("sample", "family", "pos", "rolling_fraction"), "rolling_fraction")


def report_base_counts(spark, d):
    """The number of bases at every position around the centres."""
    out = api.plot_enrichment_profile(spark, _bams(spark, d), "made", _bed(spark, d), "CG", window_size=200)
    return out["base_counts"].select("sample", "family", "pos", "total_bases")


def report_qc(spark, d):
    """The printed table of the read quality report."""
    return api.qc_report(spark, _bams(spark, d), "made")["summary"].select("metric", "statistic", "value")


def report_browser(spark, d):
    """The reads of one region with their layers."""
    return api.plot_browser(spark, _bams(spark, d), "made", "chr1:20,000-60000")["reads"].select("read_name", "posmin", "posmax", "height")


def report_browser_points(spark, d):
    return api.plot_browser(spark, _bams(spark, d), "made", "chr1:20,000-60000", "A")["points"].select("read_name", "height", "pos", "mod", "family", "prob")


def report_errors(spark, d):
    """What the reports refuse: (case, raised)."""
    no = "/nonexistent.bam"
    cases = {
        "both bed and region": lambda: api.parse_bam(spark, no, "s", bed_file="x.bed", region="chr1:1-2"),
        "neither bed nor region": lambda: api.parse_bam(spark, no, "s"),
        "centred region": lambda: api.parse_bam(spark, no, "s", region="chr1:1-2", center=True),
        "malformed region": lambda: api.parse_bam(spark, no, "s", region="chr1"),
        "unknown modification": lambda: api.parse_bam(spark, no, "s", region="chr1:1-2", basemod="G"),
        "enrichment of both": lambda: api.plot_enrichment(spark, no, "s", "x.bed", "A+CG"),
        "several files and beds": lambda: api.plot_enrichment(spark, [no, no], ["s", "t"], ["x.bed", "y.bed"], "A"),
        "profile of several files and beds": lambda: api.plot_enrichment_profile(spark, [no, no], ["s", "t"], ["x.bed", "y.bed"], "A"),
        "overlay of both": lambda: api.plot_enrichment_profile(spark, [no, no], ["s", "t"], "x.bed", "A+CG"),
        "files without samples": lambda: api.qc_report(spark, [no, no], ["s"]),
        "sample name": lambda: api.qc_report(spark, no, "a b"),
    }
    out = []
    for name, run in cases.items():
        try:
            run()
            out.append((name, "nothing"))
        except (RuntimeError, TypeError, ValueError) as e:
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "name string, raised string")


def command_lines(spark, d):
    """The five commands run over the BAM files: (command, what its manifest names)."""
    bams, regions, out = _bams(spark, d).removeprefix("file:"), _bed(spark, d), _folder(spark, "cli").removeprefix("file:")
    own = ["-f", bams, "-s", "made", "-o", out]
    lines = {
        "parse-bam": ["-b", regions, "-m", "A"],
        "plot-browser": ["-r", "chr1:20000-60000", "--static"],
        "plot-enrichment": ["-b", regions, "-m", "A", "--colors", "#111111"],
        "plot-enrichment-profile": ["-b", regions, "-m", "CG", "-d", "2"],
        "qc-report": [],
    }
    got = [(name, key) for name, more in lines.items() for key in cli.main([name, *own, *more])]
    return spark.createDataFrame(got, "command string, output string")


# --- layouts, joins and axes that had no SQL


def call_heights(spark, d):
    """Calls with the layer of their read."""
    calls = reports.calls_of(spark, d).where("chr is not null").select("ingest_seq", "sample", "chr", "read_name")
    return C.at_heights(calls, reports.read_layers(spark, d), ["sample", "chr"]).select("ingest_seq", "height")


def read_segments(spark, d):
    return C.segments(reports.read_layers(spark, d), ["sample", "chr"])


def window_fraction(spark, d):
    """Every window of 100,000 positions of every contig, 0 where nothing was called."""
    contigs = spark.read.parquet(f"{d}/contigs.parquet")
    return reports.r6(C.windows(reports.piled_of(spark, d), contigs, ["sample"], 100_000), "fraction")


QUERIES = {
    f.__name__: f
    for f in (
        bam_read, sam_read, bed_read, annotation_read, bam_region, bam_regions, mm_decode_rows, qc_rows, qc_primary, summary_bed_file, report_parse_bam, report_calls_region, report_enrichment, report_profile,
        report_base_counts, report_qc, report_browser, report_browser_points, report_errors, command_lines, call_heights, read_segments, window_fraction,
    )
}

_RECORDS = reports._DECODED.replace("d as (select doc_id", "d0 as (select doc_id", 1) + """,
r as (select *, doc_id % 13 = 0 as out, 'read' || doc_id as name, case when rev then 16 else 0 end + case when doc_id % 11 = 0 then 256 else 0 end + case when doc_id % 13 = 0 then 4 else 0 end as flag,
  cast(doc_id % 61 as int) as mapq, case when doc_id % 5 <> 0 then list_transform(range(n), lambda i: (i * 7 + doc_id) % 41) end as q, case when rev then reverse(translate(f, 'ACGT', 'TGCA')) else f end as seq from t),
d as (select * from d0 where read_idx % 13 <> 0)"""
_READ_BACK = _RECORDS + """
select name, cast(flag as int) as flag, case when not out then 'chr' || (doc_id % 3) end as chr, case when not out then st end as start, case when not out then st + n - 6 end as "end", mapq,
  case when not out then '5S20M3I10M2D' || (n - 38) || 'M' end as cigar, seq, array_to_string(q, ',') as quals, 'A+a' || repeat(',2', cast(na as bigint)) || ';C+m' || repeat(',1', cast(nc as bigint)) || ';' as mm,
  array_to_string(list_transform(range(na + nc), lambda i: i * 37 % 256), ',') as ml from r"""
_PHRED = "-10 * log10(list_avg(list_transform({q}, lambda x: pow(10, -x / 10.0))))"
_QC = f""", qc as (select name, case when not out then 'chr' || (doc_id % 3) end as chr, case when not out then st end as start, case when not out then st + n - 6 end as "end", n as length, case when rev then '-' else '+' end as strand,
  mapq, {_PHRED.format(q="q")} as ave_baseq, {_PHRED.format(q="case when out then q else q[6:] end")} as ave_alignq, flag from r)"""
_IN_REGION = _RECORDS + ", x as (select * from d where chr = 'chr1' and pos > 20000 and pos < 60000)"
_LAY = """ord as (select {keys}, read_name, posmin, posmax, row_number() over (partition by {keys} order by posmin, posmax desc, read_name) as rn from e),
w as (select {keys}, read_name, posmin, posmax, rn, [posmax] as ends, cast(1 as bigint) as height from ord where rn = 1
  union all
  select {okeys}, y.read_name, y.posmin, y.posmax, y.rn, case when y.k > 0 then list_concat(y.ends[1:y.k - 1], [y.posmax], y.ends[y.k + 1:]) when len(y.ends) < 1000 then list_append(y.ends, y.posmax) else y.ends end,
         case when y.k > 0 then y.k when len(y.ends) < 1000 then len(y.ends) + 1 end
  from (select ord.*, w.ends, coalesce(list_position(list_transform(w.ends, lambda x: x < ord.posmin), true), 0) as k from w join ord on {match} and ord.rn = w.rn + 1) y)"""
_LAYERS = "with recursive e as (select sample, chr, read_name, min(pos) as posmin, max(pos) as posmax from methylationbybase where read_name is not null and pos is not null and chr is not null group by all),\n" + _LAY.format(
    keys="sample, chr", okeys="y.sample, y.chr", match="ord.sample is not distinct from w.sample and ord.chr = w.chr"
)
_BROWSER = "with recursive " + _IN_REGION.removeprefix("with ") + ", e as (select 'made' as sample, read_name, min(pos) as posmin, max(pos) as posmax from x group by all),\n" + _LAY.format(keys="sample", okeys="y.sample", match="ord.sample = w.sample")
_CENTRED = _RECORDS + """, c as (select mod, case when contains(mod, 'A') then 'A' else 'C' end as family, called, prob, sg * (pos - cast(round_even((e - b) / 2.0 + b, 0) as bigint)) as pos from d join g on d.chr = g.chr
  join (select doc_id, st, n from s) z on z.doc_id = d.read_idx and z.st < g.e and z.st + z.n - 6 > g.b), pp as (select * from c where abs(pos) <= 200)"""
_STATS = "".join(
    f"{' union all' if i else ''} select metric, '{label}' as statistic, cast(round_even({c}, 0) as bigint) as value from s4" for i, (label, c) in enumerate((("Min", "min(v)"), ("25%", "quantile_cont(v, 0.25)"), ("Median", "median(v)"), ("75%", "quantile_cont(v, 0.75)"), ("Max", "max(v)"), ("Mean", "avg(v)")))
)
_CASES = {
    "both bed and region": "RuntimeError", "neither bed nor region": "RuntimeError", "centred region": "RuntimeError", "malformed region": "TypeError", "unknown modification": "ValueError", "enrichment of both": "RuntimeError",
    "several files and beds": "RuntimeError", "profile of several files and beds": "RuntimeError", "overlay of both": "RuntimeError", "files without samples": "ValueError", "sample name": "ValueError",
}
_OUTPUTS = {
    "parse-bam": "calls pileup", "plot-browser": "reads segments hidden points prob_range n_reads rolling curve page", "plot-enrichment": "enrichment page",
    "plot-enrichment-profile": "profile molecules base_counts page", "qc-report": "reads summary histogram n50 totals page",
}
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)

SQL = {
    "bam_read": _READ_BACK,
    "sam_read": _READ_BACK,
    "bed_read": "select 'r' as bed_id, chr, begin_pos, end_pos, case when strand in ('+', '-') then strand else '+' end as strand from regions",
    "annotation_read": "select chr, begin_pos, end_pos, coalesce(nullif(strand, ''), 'noname') as name from regions",
    "bam_region": _RECORDS + """ select name, st as start, st + n - 6 as "end" from r where not out and doc_id % 3 = 1 and st < 60000 and st + n - 6 > 20000""",
    "bam_regions": _RECORDS + """ select name, st as start, st + n - 6 as "end" from r where not out and exists (select 1 from g where g.chr = 'chr' || (doc_id % 3) and st < g.e and st + n - 6 > g.b)""",
    "mm_decode_rows": _RECORDS + " select read_name as name, mod, pos, cast(prob as int) as prob, called, called and prob >= 129 as methylated from d",
    "qc_rows": _RECORDS + _QC + """ select name, chr, start, "end", cast(length as bigint) as length, strand, mapq, round(ave_baseq, 6) as ave_baseq, round(ave_alignq, 6) as ave_alignq from qc""",
    "qc_primary": _RECORDS + " select count(*) as n_reads, cast(sum(n) as bigint) as n_bases from r where flag & 256 = 0",
    "summary_bed_file": reports.SQL["summary_bed"] + " where contains(mod, 'A') or contains(mod, 'C')",
    "report_parse_bam": _RECORDS + """ select 'made' as sample, pos || ':' || mod as id, d.chr, pos, mod, cast(sum((called and prob >= 129)::int) as bigint) as methylated_bases, count(*) as total_bases
from d join g on d.chr = g.chr and pos > b and pos < e group by all""",
    "report_calls_region": _IN_REGION + " select 'made' as sample, read_name || ':' || pos as id, read_name, chr, pos, cast(prob as int) as prob, mod from x",
    "report_enrichment": _RECORDS + ", x as (select sum((called and prob >= 129)::int) * 1.0 / count(*) as f from d join g on d.chr = g.chr and pos > b and pos < e where mod = 'A+a') select unnest(['one', 'two']) as sample, round(f, 6) as fraction_methylated from x",
    "report_profile": _CENTRED + """, v as (select pos, sum((called and prob >= 129)::int) * 1.0 / count(*) as fr from pp where family = 'A' group by pos)
select 'made' as sample, 'A' as family, pos, round(case when count(fr) over x >= 10 then avg(fr) over x end, 6) as rolling_fraction from v window x as (order by pos rows between 25 preceding and 24 following)""",
    "report_base_counts": _CENTRED + """, v as (select pos, count(*) as n from pp where family = 'C' group by pos), a as (select unnest(generate_series(min(pos), max(pos) - 1)) as pos from v)
select 'made' as sample, 'C' as family, pos, coalesce(n, 0) as total_bases from a left join v using (pos)""",
    "report_qc": _RECORDS + _QC + """, s4 as (select unnest(['length', 'mapq', 'ave_baseq', 'ave_alignq']) as metric, unnest([cast(length as double), cast(mapq as double), ave_baseq, ave_alignq]) as v from qc)
""" + _STATS.replace("from s4", "from s4 where v is not null group by metric"),
    "report_browser": _BROWSER + " select read_name, posmin, posmax, height from w",
    "report_browser_points": _BROWSER + " select read_name, height, pos, mod, 'A' as family, cast(prob as int) as prob from x join w using (read_name) where mod = 'A+a' and prob >= 129 and height is not null",
    "report_errors": f"select * from (values {_values(_CASES.items())}) v(name, raised)",
    "command_lines": f"select * from (values {_values((c, o) for c, names in _OUTPUTS.items() for o in names.split())}) v(command, output)",
    "call_heights": _LAYERS + " select m.ingest_seq, w.height from methylationbybase m join w on m.sample is not distinct from w.sample and m.chr = w.chr and m.read_name = w.read_name where height is not null",
    "read_segments": _LAYERS + " select sample, chr, read_name, posmin as x0, posmax as x1, height from w where height is not null",
    "window_fraction": """with b as (select sample, chr, pos // 100000 * 100000 as bin_start, sum(methylated_bases) m, sum(total_bases) t from methylationaggregate group by all),
a as (select sample, chr, unnest(generate_series(0, length_bp - 1, 100000)) as bin_start from (select distinct sample from methylationaggregate), contigs where length_bp > 0)
select sample, a.chr, a.bin_start, cast(coalesce(m, 0) as bigint) as methylated_bases, cast(coalesce(t, 0) as bigint) as total_bases, round(case when t > 0 then m * 1.0 / t else 0 end, 6) as fraction
from a left join b using (sample, chr, bin_start)""",
    # of queries in reports
    "read_layers": _LAYERS + " select sample, chr, read_name, posmin, posmax, height from w",
    "hidden_reads": _LAYERS + " select sample, count(*) filter (where height is null) as n_hidden from w group by sample",
}
