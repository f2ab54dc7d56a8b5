"""Queries over the engine's own operators, one or more for each, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calypile.functions import reads as fr
from calypile.operators import calls as C
from calypile.operators import decode as D
from calypile.operators import extract, qc
from calypile.operators import regions as R
from calypile.session import checkpoint_dir, spread
from calypile.sources.tables import read_samples
from calypile.streaming import pileup as stream

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MAPPED = "ACGCGTACGCGATACGCGTACGCGATACGCGTACGCGATACGCGTACGCGAT"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def calls_of(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "methylationbybase")


def regions_of(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "regions")


def reads_of(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "reads_samplename")


def piled_of(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "methylationaggregate")


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- pileup and fractions


def pileup(spark, d):
    return C.pileup(calls_of(spark, d), ["sample", "chr", "pos", "mod"])


def pileup_merged(spark, d):
    """The same from two partial pileups, as when a load is added."""
    calls = calls_of(spark, d)
    parts = [C.pileup(calls.where(F.col("load_id") % 2 == k), ["sample", "chr", "pos", "mod"]) for k in (0, 1)]
    return C.merge_pileups(*parts, keys=["sample", "chr", "pos", "mod"])


def pileup_streamed(spark, d):
    """The same from a stream of the table's files, each micro-batch stored by itself."""
    at = f"{checkpoint_dir(spark)}/streamed-{uuid.uuid4().hex}"
    path = f"{d}/methylationbybase.parquet"
    source = stream.stream_calls(spark, f"{path[:-1]}[t]", spark.read.parquet(path).schema)  # a pattern, as the table may be one file
    stream.upsert_batches(source, f"{at}/out", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.stored_pileup(spark, f"{at}/out")


def pileup_fraction(spark, d):
    return r6(piled_of(spark, d).select("sample", "chr", "pos", "mod", C.fraction(F.col("methylated_bases"), F.col("total_bases")).alias("fraction")), "fraction")


def pileup_totals(spark, d):
    return piled_of(spark, d).groupBy("sample", "chr").agg(F.sum("methylated_bases").alias("methylated_bases"), F.sum("total_bases").alias("total_bases"))


def summary_bed(spark, d):
    return C.summary_bed(piled_of(spark, d))


def bin100_fraction(spark, d):
    return r6(C.bins(piled_of(spark, d), ["sample", "chr"]), "fraction")


# --- calls


def mod_family_filter(spark, d):
    return calls_of(spark, d).where(fr.mod_family(F.col("mod")) == "C").select("ingest_seq", "mod", fr.mod_label(F.col("mod")).alias("label"))


def threshold_calls(spark, d):
    return calls_of(spark, d).where(C.modified(F.col("prob"))).select("ingest_seq", "prob", fr.rounded_probability(F.col("prob")).alias("prob_share"))


def dedup_first(spark, d):
    return C.first_per_id(calls_of(spark, d), ["ingest_seq"]).select("ingest_seq", "sample", "id")


def distinct_reads(spark, d):
    return calls_of(spark, d).groupBy("sample").agg(F.countDistinct("read_name").alias("n_reads"))


def read_extent(spark, d):
    return C.extents(calls_of(spark, d), ["sample", "chr"])


def read_layers(spark, d):
    return C.layers(C.extents(calls_of(spark, d).where(F.col("chr").isNotNull()), ["sample", "chr"]), ["sample", "chr"])


def hidden_reads(spark, d):
    return C.hidden_reads(read_layers(spark, d), ["sample"])


def prob_range(spark, d):
    return C.probability_range(calls_of(spark, d), [])


def prob_any_mod(spark, d):
    p = calls_of(spark, d).where(F.col("read_name").isNotNull() & F.col("prob").between(0, 255)).withColumn("p", F.col("prob") / F.lit(255.0))
    return r6(p.groupBy("sample", "read_name").agg(fr.any_modified(F.col("p")).alias("p_any")), "p_any")


# --- regions


def region_overlap_join(spark, d):
    return R.overlap_join(reads_of(spark, d).select("ingest_seq", "chr", "start", "end"), regions_of(spark, d).select("bed_id", "region_idx", "chr", "begin_pos", "end_pos")).select("ingest_seq", "bed_id", "region_idx")


def region_overlap_binned(spark, d):
    return R.overlap_join(reads_of(spark, d).select("ingest_seq", "chr", "start", "end"), regions_of(spark, d).select("bed_id", "region_idx", "chr", "begin_pos", "end_pos"), few=False).select("ingest_seq", "bed_id", "region_idx")


def _beds(spark, d):
    return regions_of(spark, d).select("bed_id", "region_idx", "chr", "begin_pos", "end_pos", "strand")


def window_strict_filter(spark, d):
    return R.in_window(calls_of(spark, d).select("ingest_seq", "chr", "pos"), _beds(spark, d)).select("ingest_seq", "bed_id", "region_idx")


def center_strand(spark, d):
    return R.around_center(calls_of(spark, d).select("ingest_seq", "chr", "pos"), _beds(spark, d), 1000).select("ingest_seq", "bed_id", "region_idx", "rel_pos")


def enrichment_fraction(spark, d):
    inside = R.in_window(calls_of(spark, d).where(F.col("mod").contains("A")).select("chr", "pos", "prob"), _beds(spark, d))
    return r6(C.enrichment(inside, _beds(spark, d), ["bed_id", "region_idx"]), "fraction")


def region_parse(spark, d):
    text = F.concat("chr", F.lit(":"), F.format_number("begin_pos", 0), F.lit("-"), F.col("end_pos").cast("string"))
    return regions_of(spark, d).select("bed_id", "region_idx", R.parse_region_column(text).alias("r"), R.strand_or_plus(F.col("strand")).alias("strand")).select("bed_id", "region_idx", "strand", "r.*")


def annotation_subset(spark, d):
    return R.annotations(_beds(spark, d), "chr20", 1_000_000, 20_000_000).select("bed_id", "region_idx", "begin_pos", "end_pos", "name")


# --- profiles


def _centred(spark, d):
    return R.around_center(calls_of(spark, d).select("sample", "read_name", "chr", "pos", "prob", "mod"), _beds(spark, d), 1000)


def centred_pileup(spark, d):
    return C.pileup(_centred(spark, d), ["bed_id", "rel_pos", "mod"])


def dense_axis(spark, d):
    return C.dense_axis(centred_pileup(spark, d), ["bed_id", "mod"], "total_bases", "rel_pos")


def single_molecules(spark, d):
    return C.points(_centred(spark, d).select("bed_id", "read_name", "rel_pos", "mod"), ["bed_id"], "rel_pos")


def _smooth(spark, d):
    return C.smoothed(piled_of(spark, d), ["sample", "chr"], "pos", 50, 10)


def rolling_mean(spark, d):
    return r6(_smooth(spark, d).select("sample", "chr", "pos", "mod", "rolling_fraction"), "rolling_fraction")


def rolling_total(spark, d):
    return r6(_smooth(spark, d).select("sample", "chr", "pos", "mod", "rolling_methylated", "rolling_total"), "rolling_methylated", "rolling_total")


def profile_curve(spark, d):
    piled = centred_pileup(spark, d)
    return r6(C.curve(C.smoothed(piled, ["bed_id"], "rel_pos", 50, 10), ["bed_id"], "rolling_fraction", "rel_pos"), "rolling_fraction")


# --- read quality


def qc_quantiles(spark, d):
    return r6(qc.summary(reads_of(spark, d), ["sample"]), "min", "q1", "median", "q3", "max", "mean")


def qc_summary_table(spark, d):
    return qc.summary_table(reads_of(spark, d), ["sample"])


def qc_outlier_hist(spark, d):
    return r6(qc.histogram(reads_of(spark, d), ["sample"]), "bin_start", "width", "density")


def qc_n50(spark, d):
    return qc.n50(reads_of(spark, d), ["sample"])


def qc_totals(spark, d):
    return qc.totals(reads_of(spark, d), ["sample"])


def mean_phred(spark, d):
    return r6(_table(spark, d, "lineitem").groupBy("l_orderkey").agg(fr.mean_phred_agg(F.col("l_quantity").cast("double")).alias("phred")), "phred")


def mean_phred_array(spark, d):
    """The same of arrays, as reads carry them."""
    arrays = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("double")).alias("q"))
    return r6(arrays.select("l_orderkey", fr.mean_phred(F.col("q")).alias("phred")), "phred")


# --- decoding, over reads made of the documents' letters


def seqs(spark, d):
    return spread(_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.regexp_replace(F.translate(F.col("text"), _LETTERS, _MAPPED), "[^ACGT]", "").alias("seq"))


def made_reads(spark: SparkSession, d: str) -> DataFrame:
    """A read per document with at least 60 letters: soft clip, insertion and deletion, two modifications called at every third A and second C."""
    s = seqs(spark, d).where(F.length("seq") >= 60)
    forward = F.when(F.col("doc_id") % 2 == 1, fr.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    count = lambda b: F.length("f") - F.length(F.replace(F.col("f"), F.lit(b), F.lit("")))
    s = s.withColumn("f", forward).withColumn("na", F.floor(count("A") / 3).cast("int")).withColumn("nc", F.floor(count("C") / 2).cast("int"))
    n = F.col("na") + F.col("nc")
    return s.select(
        F.lit("made").alias("sample"), F.col("doc_id").alias("read_idx"), F.concat(F.lit("read"), "doc_id").alias("name"), F.when(F.col("doc_id") % 2 == 1, 16).otherwise(0).alias("flag"),
        F.concat(F.lit("chr"), (F.col("doc_id") % 3).cast("string")).alias("chr"), (F.col("doc_id") * 997 % 100000).alias("start"), (F.col("doc_id") * 997 % 100000 + F.length("seq") - 6).alias("end"),
        F.concat(F.lit("5S20M3I10M2D"), (F.length("seq") - 38).cast("string"), F.lit("M")).alias("cigar"), "seq",
        F.concat(F.lit("A+a"), F.repeat(F.lit(",2"), F.col("na")), F.lit(";C+m"), F.repeat(F.lit(",1"), F.col("nc")), F.lit(";")).alias("mm"),
        F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i * 37 % 256).cast("int"))).otherwise(F.array().cast("array<int>")).alias("ml"),
    )


def made_regions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("bigint")
    return _table(spark, d, "supplier").select(F.lit("made").alias("bed_id"), k.alias("region_idx"), F.concat(F.lit("chr"), (F.col("s_nationkey") % 3).cast("string")).alias("chr"), (k * 997 % 100000).alias("begin_pos"), (k * 997 % 100000 + 101 + k % 400).alias("end_pos"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))


def _decoded(sites: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.col(c).cast("bigint"))
    return sites.groupBy("read_idx", "mod").agg(F.count(F.lit(1)).alias("n_sites"), n("pos").alias("sum_pos"), n("prob").alias("sum_prob"), n("called").alias("n_called"), n("methylated").alias("n_methylated"))


def mm_decode(spark, d):
    return _decoded(D.decode(made_reads(spark, d), ["read_idx"]))


def mm_decode_relational(spark, d):
    return _decoded(D.decode_relational(made_reads(spark, d), "read_idx"))


def cigar_blocks(spark, d):
    reads = made_reads(spark, d).select("read_idx", F.col("cigar"), F.explode(fr.aligned_blocks(F.col("cigar"), F.col("start"))).alias("b"))
    return reads.select("read_idx", "b.*", fr.reference_length(F.col("cigar")).alias("reference_length"), fr.query_length(F.col("cigar")).alias("query_length"))


def revcomp(spark, d):
    return seqs(spark, d).select("doc_id", fr.reverse_complement(F.col("seq")).alias("rc"))


def extract_pileup(spark, d):
    return extract.site_pileup(extract.sites(made_reads(spark, d), made_regions(spark, d), columns=extract.PILEUP))


def extract_centred(spark, d):
    return extract.site_pileup(extract.sites(made_reads(spark, d), made_regions(spark, d), centered=True, window=200, columns=extract.PILEUP), centered=True)


def extract_calls(spark, d):
    return extract.calls(extract.sites(made_reads(spark, d), made_regions(spark, d), "A", columns=extract.CALLS))


def extract_all_bases(spark, d):
    return extract.calls(extract.sites(made_reads(spark, d), made_regions(spark, d), "CG", columns=extract.CALLS), all_bases=True)


def stored_samples(spark, d):
    """Written by sample and read back for one."""
    from calypile.sources.tables import write_samples

    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    write_samples(piled_of(spark, d), path)
    kept = piled_of(spark, d).agg(F.min("sample").alias("s")).first()["s"]
    return read_samples(spark, path, [kept]).select("sample", "chr", "pos", "mod", "methylated_bases", "total_bases")


QUERIES = {
    f.__name__: f
    for f in (
        pileup, pileup_merged, pileup_streamed, pileup_fraction, pileup_totals, summary_bed, bin100_fraction, mod_family_filter, threshold_calls, dedup_first, distinct_reads, read_extent, read_layers,
        hidden_reads, prob_range, prob_any_mod, region_overlap_join, region_overlap_binned, window_strict_filter, center_strand, enrichment_fraction, region_parse, annotation_subset, centred_pileup,
        dense_axis, single_molecules, rolling_mean, rolling_total, profile_curve, qc_quantiles, qc_summary_table, qc_outlier_hist, qc_n50, qc_totals, mean_phred, mean_phred_array, mm_decode,
        mm_decode_relational, cigar_blocks, revcomp, extract_pileup, extract_centred, extract_calls, extract_all_bases, stored_samples,
    )
}

_HIT = "case when prob >= 129 then 1 else 0 end"
_FAMILY = "case when contains(mod, 'A') then 'A' when contains(mod, 'C') then 'C' end"
_PILEUP = f"select sample, chr, pos, mod, cast(sum({_HIT}) as bigint) as methylated_bases, count(*) as total_bases from methylationbybase group by all"
_OVERLAP = """select r.ingest_seq, g.bed_id, g.region_idx from reads_samplename r join regions g on r.chr = g.chr and r.start < g.end_pos and r."end" > g.begin_pos
where r.start < r."end" and g.begin_pos < g.end_pos"""
_CENTRE = """c as (select m.*, g.bed_id, g.region_idx, (case when g.strand = '-' then -1 else 1 end) * (m.pos - cast(round_even((g.end_pos - g.begin_pos) / 2.0 + g.begin_pos, 0) as bigint)) as rel_pos
from methylationbybase m join regions g on m.chr = g.chr where g.begin_pos < g.end_pos and abs(m.pos - cast(round_even((g.end_pos - g.begin_pos) / 2.0 + g.begin_pos, 0) as bigint)) <= 1000)"""
_ROLL = f"""with f as (select *, {_FAMILY} as family, case when total_bases <> 0 then methylated_bases * 1.0 / total_bases end as fr from methylationaggregate),
w as (select sample, chr, pos, mod, family,
  case when count(fr) over x >= 10 then avg(fr) over x end as rolling_fraction, case when count(methylated_bases) over x >= 10 then avg(methylated_bases) over x end as rolling_methylated,
  case when count(total_bases) over x >= 10 then avg(total_bases) over x end as rolling_total from f
  window x as (partition by sample, chr, family order by pos, mod rows between 25 preceding and 24 following))"""
_LONG = """with x as (
  select sample, 'length' metric, cast("length" as double) v from reads_samplename union all select sample, 'mapq', cast(mapq as double) from reads_samplename union all
  select sample, 'ave_baseq', ave_baseq from reads_samplename union all select sample, 'ave_alignq', ave_alignq from reads_samplename),
f as (select sample, metric, v from x where v is not null and isfinite(v)),
s as (select sample, metric, count(*) n, min(v) mn, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.5) md, quantile_cont(v, 0.75) q3, max(v) mx, avg(v) mean from f group by all)"""
_SEQS = f"s0 as (select doc_id, regexp_replace(translate(text, '{_LETTERS}', '{_MAPPED}'), '[^ACGT]', '', 'g') as seq from documents)"
_DECODED = f"""with {_SEQS},
s as (select doc_id, length(seq) n, doc_id * 997 % 100000 st, doc_id % 2 = 1 as rev, case when doc_id % 2 = 1 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as f from s0 where length(seq) >= 60),
t as (select *, (length(f) - length(replace(f, 'A', ''))) // 3 as na, (length(f) - length(replace(f, 'C', ''))) // 2 as nc, string_split(f, '') as l from s),
b as (select doc_id, n, st, rev, na, nc, unnest(l) as base, generate_subscripts(l, 1) - 1 as i from t),
q as (select *, case when rev then n - 1 - i else i end as q from b),
p as (select *, case when q < 5 then null when q < 25 then st + q - 5 when q < 28 then null when q < 38 then st + 20 + q - 28 else st + 32 + q - 38 end as pos from q),
o as (select *, lead(base) over (partition by doc_id order by i) nb, lead(pos) over (partition by doc_id order by i) np, row_number() over (partition by doc_id, base order by i) - 1 as o from p),
k as (select *, case when base = 'A' and o % 3 = 2 and (o - 2) // 3 < na then (o - 2) // 3 when base = 'C' and o % 2 = 1 and (o - 1) // 2 < nc then na + (o - 1) // 2 end as call
      from o where pos is not null and (base = 'A' or (base = 'C' and nb = 'G' and np is not null and abs(np - pos) = 1))),
d as (select doc_id as read_idx, 'read' || doc_id as read_name, 'chr' || (doc_id % 3) as chr, case when base = 'A' then 'A+a' else 'C+m' end as mod, pos, coalesce(call * 37 % 256, 0) as prob, call is not null as called from k),
g as (select cast(s_suppkey as bigint) region_idx, 'chr' || (s_nationkey % 3) chr, cast(s_suppkey as bigint) * 997 % 100000 b, cast(s_suppkey as bigint) * 997 % 100000 + 101 + s_suppkey % 400 e,
             case when s_suppkey % 2 = 0 then 1 else -1 end sg from supplier)"""
_DECODE_SUMS = _DECODED + """
select read_idx, mod, count(*) as n_sites, cast(sum(pos) as bigint) as sum_pos, cast(sum(prob) as bigint) as sum_prob, cast(sum(called::int) as bigint) as n_called,
       cast(sum((called and prob >= 129)::int) as bigint) as n_methylated from d group by all"""
_FIRST = """, h as (select d.*, region_idx, d.read_name || ':' || pos as id, row_number() over (partition by d.read_name || ':' || pos order by region_idx, d.read_idx, d.mod, pos) as rn
from d join g on d.chr = g.chr and pos > b and pos < e where {where})
select 'made' as sample, id, read_name, chr, pos, cast(prob as int) as prob, mod from h where rn = 1"""

SQL = {
    "pileup": _PILEUP,
    "pileup_merged": _PILEUP,
    "pileup_streamed": _PILEUP,
    "pileup_fraction": "select sample, chr, pos, mod, round(case when total_bases <> 0 then methylated_bases * 1.0 / total_bases end, 6) as fraction from methylationaggregate",
    "pileup_totals": "select sample, chr, cast(sum(methylated_bases) as bigint) as methylated_bases, cast(sum(total_bases) as bigint) as total_bases from methylationaggregate group by all",
    "summary_bed": """select chr, pos as start, pos + 1 as "end", methylated_bases, total_bases, case when contains(mod, 'A') then 'A' when contains(mod, 'C') then 'CG' end as label from methylationaggregate""",
    "bin100_fraction": """with b as (select sample, chr, pos // 100 * 100 as bin_start, cast(sum(methylated_bases) as bigint) as methylated_bases, cast(sum(total_bases) as bigint) as total_bases from methylationaggregate group by all)
select *, round(case when total_bases <> 0 then methylated_bases * 1.0 / total_bases else 0 end, 6) as fraction from b""",
    "mod_family_filter": "select ingest_seq, mod, case when contains(mod, 'A') then 'A' else 'CG' end as label from methylationbybase where contains(mod, 'C') and not contains(mod, 'A')",
    "threshold_calls": "select ingest_seq, prob, round_even(prob / 255.0, 2) as prob_share from methylationbybase where prob >= 129",
    "dedup_first": "select ingest_seq, sample, id from (select *, row_number() over (partition by sample, id order by ingest_seq) rn from methylationbybase) where rn = 1 or id is null",
    "distinct_reads": "select sample, count(distinct read_name) as n_reads from methylationbybase group by sample",
    "read_extent": "select sample, chr, read_name, min(pos) as posmin, max(pos) as posmax from methylationbybase where read_name is not null and pos is not null group by all",
    "prob_range": f"select {_FAMILY} as family, min(prob) as prob_min, max(prob) as prob_max from methylationbybase where prob >= 129 and ({_FAMILY}) is not null group by all",
    "prob_any_mod": """with p as (select sample, read_name, prob / 255.0 p from methylationbybase where read_name is not null and prob between 0 and 255)
select sample, read_name, round(1 - exp(coalesce(sum(ln(1 - case when p = 1 then 254 / 255.0 else p end)) filter (where p >= 0.5), 0)), 6) as p_any from p group by all""",
    "region_overlap_join": _OVERLAP,
    "region_overlap_binned": _OVERLAP,
    "window_strict_filter": "select m.ingest_seq, g.bed_id, g.region_idx from methylationbybase m join regions g on m.chr = g.chr and m.pos > g.begin_pos and m.pos < g.end_pos",
    "center_strand": f"with {_CENTRE} select ingest_seq, bed_id, region_idx, rel_pos from c",
    "enrichment_fraction": f"""with s as (select g.bed_id, g.region_idx, sum({_HIT}) m, count(*) t from methylationbybase c join regions g on c.chr = g.chr and c.pos > g.begin_pos and c.pos < g.end_pos where contains(mod, 'A') group by all)
select g.bed_id, g.region_idx, cast(coalesce(m, 0) as bigint) as methylated_bases, coalesce(t, 0) as total_bases, round(case when coalesce(t, 0) > 0 then m * 1.0 / t else 0 end, 6) as fraction
from (select distinct bed_id, region_idx from regions) g left join s using (bed_id, region_idx)""",
    "region_parse": "select bed_id, region_idx, case when strand in ('+', '-') then strand else '+' end as strand, chr, begin_pos, end_pos, chr || '_' || begin_pos || '_' || end_pos as label from regions",
    "annotation_subset": "select bed_id, region_idx, begin_pos, end_pos, 'noname' as name from regions where chr = 'chr20' and begin_pos < 20000000 and end_pos > 1000000",
    "centred_pileup": f"with {_CENTRE} select bed_id, rel_pos, mod, cast(sum({_HIT}) as bigint) as methylated_bases, count(*) as total_bases from c group by all",
    "dense_axis": f"""with {_CENTRE}, p as (select bed_id, mod, rel_pos, count(*) as total_bases from c group by all),
a as (select bed_id, mod, unnest(generate_series(min(rel_pos), max(rel_pos) - 1)) as rel_pos from p group by bed_id, mod having min(rel_pos) < max(rel_pos))
select bed_id, mod, rel_pos, coalesce(total_bases, 0) as total_bases from a left join p using (bed_id, mod, rel_pos)""",
    "single_molecules": f"""with {_CENTRE}, r as (select bed_id, read_name, row_number() over (partition by bed_id order by min(rel_pos), read_name) - 1 as read_row from c where read_name is not null group by bed_id, read_name)
select bed_id, read_name, read_row, rel_pos, mod, {_FAMILY} as family from c join r using (bed_id, read_name)""",
    "rolling_mean": _ROLL + " select sample, chr, pos, mod, round(rolling_fraction, 6) as rolling_fraction from w where family is not null",
    "rolling_total": _ROLL + " select sample, chr, pos, mod, round(rolling_methylated, 6) as rolling_methylated, round(rolling_total, 6) as rolling_total from w where family is not null",
    "profile_curve": f"""with {_CENTRE}, p as (select bed_id, rel_pos, mod, {_FAMILY} as family, sum({_HIT}) * 1.0 / count(*) as fr from c group by bed_id, rel_pos, mod),
w as (select bed_id, family, rel_pos, case when count(fr) over x >= 10 then avg(fr) over x end as v from p where family is not null window x as (partition by bed_id, family order by rel_pos, mod rows between 25 preceding and 24 following))
select bed_id, family, rel_pos, round(avg(v), 6) as rolling_fraction from w group by all""",
    "qc_quantiles": _LONG + " select sample, metric, n, round(mn, 6) as min, round(q1, 6) as q1, round(md, 6) as median, round(q3, 6) as q3, round(mx, 6) as max, round(mean, 6) as mean from s",
    "qc_summary_table": _LONG + "".join(f"{' union all' if i else ''} select sample, metric, '{label}' as statistic, cast(round_even({c}, 0) as bigint) as value from s" for i, (label, c) in enumerate((("Min", "mn"), ("25%", "q1"), ("Median", "md"), ("75%", "q3"), ("Max", "mx"), ("Mean", "mean")))),
    "qc_outlier_hist": _LONG + """, k as (select f.* from f join s using (sample, metric) where v <= q3 + 3 * (q3 - q1)),
e as (select sample, metric, min(v) lo, count(*) m, case when max(v) > min(v) then (max(v) - min(v)) / 200 else 1 end width from k group by all)
select sample, metric, cast(least(floor((v - lo) / width), 199) as int) as bin, round(lo + cast(least(floor((v - lo) / width), 199) as int) * width, 6) as bin_start, round(width, 6) as width,
       count(*) as count, round(count(*) / (m * width), 6) as density from k join e using (sample, metric) group by sample, metric, bin, lo, width, m""",
    "qc_n50": """with c as (select sample, "length" x, sum("length") over (partition by sample order by "length" desc range unbounded preceding) c, sum("length") over (partition by sample) t from reads_samplename where "length" is not null)
select sample, max(x) as n50 from c where 2 * c > t group by sample""",
    "qc_totals": """select sample, count(*) as n_reads, cast(round_even(avg("length"), 0) as bigint) as mean_length, cast(round_even(avg("length"), 0) as bigint) * count(*) as n_bases, cast(sum("length") as bigint) as n_bases_exact from reads_samplename group by sample""",
    "mean_phred": "select l_orderkey, round(-10 * log10(avg(pow(10, -cast(l_quantity as double) / 10))), 6) as phred from lineitem group by l_orderkey",
    "mean_phred_array": "select l_orderkey, round(-10 * log10(avg(pow(10, -cast(l_quantity as double) / 10))), 6) as phred from lineitem group by l_orderkey",
    "mm_decode": _DECODE_SUMS,
    "mm_decode_relational": _DECODE_SUMS,
    "cigar_blocks": f"""with {_SEQS}, s as (select doc_id, length(seq) n, doc_id * 997 % 100000 st from s0 where length(seq) >= 60)
select doc_id as read_idx, cast(unnest([5, 28, 38]) as bigint) as qstart, st + unnest([0, 20, 32]) as rstart, unnest([20, 10, n - 38]) as len, n - 6 as reference_length, n as query_length from s""",
    "revcomp": f"with {_SEQS} select doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) as rc from s0",
    "extract_pileup": _DECODED + """ select 'made' as sample, pos || ':' || mod as id, d.chr, pos, mod, cast(sum((called and prob >= 129)::int) as bigint) as methylated_bases, count(*) as total_bases
from d join g on d.chr = g.chr and pos > b and pos < e group by all""",
    "extract_centred": _DECODED + """, c as (select mod, called, prob, sg * (pos - cast(round_even((e - b) / 2.0 + b, 0) as bigint)) as pos from d join g on d.chr = g.chr
  join (select doc_id, st, n from s) r on r.doc_id = d.read_idx and r.st < g.e and r.st + r.n - 6 > g.b)
select 'made' as sample, pos || ':' || mod as id, cast(null as varchar) as chr, pos, mod, cast(sum((called and prob >= 129)::int) as bigint) as methylated_bases, count(*) as total_bases from c where abs(pos) <= 200 group by all""",
    "extract_calls": _DECODED + _FIRST.format(where="mod = 'A+a' and called and prob >= 129"),
    "extract_all_bases": _DECODED + _FIRST.format(where="mod = 'C+m'"),
    "stored_samples": "select sample, chr, pos, mod, methylated_bases, total_bases from methylationaggregate where sample = (select min(sample) from methylationaggregate)",
}
