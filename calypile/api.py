"""The five reports: extraction, browser, enrichment, enrichment profile and read quality.

Reads are DataFrames of calypile.schemas.READS, or paths of BAM or SAM files; regions are DataFrames of REGIONS, or paths of BED files.
Results are DataFrames; with out_dir they are also written, and the manifest of what was written is in the result. What several of
them are made of is decoded once: then it is written to the checkpoint folder first.
"""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calypile import figures
from calypile.functions.reads import mod_family, rounded_probability
from calypile.operators import calls as C
from calypile.operators import extract, qc
from calypile.operators.decode import BASEMODS
from calypile.operators.regions import BROADCAST_ROWS, annotations, one_region, parse_region
from calypile.session import checkpointed, stored
from calypile.sources import bam, bed, sam, tables

_SAMPLE = re.compile(r"[A-Za-z0-9_]+")


def as_list(value) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


def _paired(files, samples) -> list[tuple]:
    files, samples = as_list(files), as_list(samples)
    if len(files) != len(samples):
        raise ValueError(f"{len(files)} files but {len(samples)} sample names")
    for s in samples:
        if not isinstance(s, str) or not _SAMPLE.fullmatch(s):
            raise ValueError(f"invalid sample name {s!r}: use letters, digits and _")
    return list(zip(files, samples, strict=True))


def _reads(spark: SparkSession, file, sample: str, region: str | None = None, regions: DataFrame | None = None) -> DataFrame:
    """The reads of a file; of a BAM file only those that overlap the region or, if they are few, the regions."""
    if isinstance(file, DataFrame):
        return file.withColumn("sample", F.lit(sample))
    if str(file).endswith(".sam"):
        return sam.read_sam(spark, file, sample)
    spans = None
    if regions is not None:
        rows = regions.where("chr is not null and begin_pos < end_pos").select("chr", "begin_pos", "end_pos").limit(BROADCAST_ROWS + 1).collect()
        spans = [tuple(r) for r in rows] if len(rows) <= BROADCAST_ROWS else None
    return bam.read_bam(spark, file, sample, region=region, regions=spans)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _regions(spark: SparkSession, source, bed_id: str | None = None) -> DataFrame:
    if isinstance(source, DataFrame):
        return source.withColumn("bed_id", F.lit(bed_id)) if bed_id else source
    return bed.read_regions(spark, source, bed_id)


def parse_bam(spark: SparkSession, file, sample: str, out_dir: str | None = None, bed_file=None, basemod: str = "A+CG", center: bool = False, window_size: int = 1000, region: str | None = None, thresh_a: int = 129, thresh_c: int = 129, extract_all_bases: bool = False, shared: bool = False) -> dict:
    """calls and pileup of one sample inside the regions of a BED file or of one region chr:begin-end; shared: both from one decoding."""
    if (bed_file is None) == (region is None):
        raise RuntimeError("give either a BED file or a region")
    if center and region is not None:
        raise RuntimeError("centring needs a BED file")
    if basemod not in BASEMODS:
        raise ValueError(f"basemod is one of {', '.join(BASEMODS)}")
    ((file, sample),) = _paired(file, sample)
    where = one_region(spark, region) if region is not None else _regions(spark, bed_file)
    reads = _reads(spark, file, sample, region, None if region is not None else where)
    if region is not None:
        chr_, begin, end = parse_region(region)
        reads = reads.where((F.col("chr") == chr_) & (F.col("start") < end) & (F.col("end") > begin))
    found, again = extract.tallied(reads, where, basemod, center, window_size, thresh_a, thresh_c, all_bases=extract_all_bases), None
    if out_dir or shared:
        found = stored(found)
        again = extract.names_again(found)
    out = {"calls": extract.tallied_calls(found, again), "pileup": extract.site_pileup(found, center), "manifest": {}}
    if out_dir:
        name = bed.basename(file) if isinstance(file, str) else sample
        base = os.path.join(out_dir, name)
        out["manifest"] = {k: tables.write_samples(out[k], f"{base}_{k}") for k in ("calls", "pileup")}
        if region is not None:
            out["manifest"]["beds"] = tables.write_summary_beds(tables.read_samples(spark, out["manifest"]["pileup"], [sample]), out_dir, f"{name}_{sample}")
    return out


def plot_browser(spark: SparkSession, files, samples, region: str, basemod: str = "A+CG", out_dir: str | None = None, thresh_a: int = 129, thresh_c: int = 129, bed_features=None, smooth: int = 1000, min_periods: int = 100, color_a: str | None = None, color_c: str | None = None, dot_size: float = 4, static: bool = False) -> dict:
    """Single-molecule view of one region: laid-out reads, their calls, smoothed fractions and annotation features."""
    if basemod not in BASEMODS:
        raise ValueError(f"basemod is one of {', '.join(BASEMODS)}")
    chr_, begin, end = parse_region(region)
    parts = [parse_bam(spark, f, s, basemod="A+CG", region=region, extract_all_bases=True, thresh_a=thresh_a, thresh_c=thresh_c, shared=True) for f, s in _paired(files, samples)]
    calls, pileup = _union([p["calls"] for p in parts]), _union([p["pileup"] for p in parts])
    wanted = list(BASEMODS[basemod])
    laid = checkpointed(C.layers(C.extents(calls, ["sample"]), ["sample"]))
    threshold = F.when(mod_family(F.col("mod")) == "A", thresh_a).otherwise(thresh_c)
    shown = calls.where((F.col("prob") >= threshold) & mod_family(F.col("mod")).isin(wanted))
    points = C.at_heights(shown, laid, ["sample"]).select("sample", "read_name", "height", "pos", "mod", mod_family(F.col("mod")).alias("family"), "prob", rounded_probability(F.col("prob")).alias("prob_share"))
    rolling = C.smoothed(pileup.where(mod_family(F.col("mod")).isin(wanted)), ["sample", "chr"], "pos", smooth, min_periods)
    out = {
        "reads": laid,
        "segments": C.segments(laid, ["sample"]),
        "hidden": C.hidden_reads(laid, ["sample"]),
        "points": points,
        "prob_range": shown.groupBy(mod_family(F.col("mod")).alias("family")).agg(F.min("prob").alias("prob_min"), F.max("prob").alias("prob_max")),
        "n_reads": calls.groupBy("sample").agg(F.countDistinct("read_name").alias("n_reads")),
        "rolling": rolling,
        "curve": C.curve(rolling, ["sample"], "rolling_fraction").join(C.curve(rolling, ["sample"], "rolling_total"), ["sample", "family", "pos"]),
        "manifest": {},
    }
    for i, path in enumerate(as_list(bed_features) if bed_features is not None else []):
        source = path if isinstance(path, DataFrame) else bed.read_annotation(spark, path)
        out[f"annotation_{i}"] = annotations(source, chr_, begin, end)
    if out_dir:
        frames = {k: v for k, v in out.items() if isinstance(v, DataFrame)}
        out["manifest"] = figures.write_data(frames, out_dir)
        page = os.path.join(out_dir, f"browser_{chr_}_{begin}_{end}.html")
        curve = out["curve"].withColumn("line", F.concat_ws(" ", "family", "sample"))
        plots = {"reads": ("spans", out["segments"], "x0", "x1", "height"), "calls": (points, "pos", "height", "family"), "fraction": ("line", curve, "pos", "rolling_fraction", "line"), "total": ("line", curve, "pos", "rolling_total", "line")}
        plots |= {k: ("spans", v.withColumn("y", F.lit(0)), "begin_pos", "end_pos", "y") for k, v in frames.items() if k.startswith("annotation_")}
        colors = {k: v for k, v in (("A", color_a), ("C", color_c)) if v}
        out["manifest"]["page"] = figures.write_page(page, region, plots, {"reads": out["n_reads"], "hidden": out["hidden"], "probabilities": out["prob_range"]}, colors, dot_size / 2, static)
    return out


def _many(files, samples, beds) -> tuple[list, list, list]:
    pairs, beds = _paired(files, samples), as_list(beds)
    if len(pairs) > 1 and len(beds) > 1:
        raise RuntimeError("compare several files over one BED file, or several BED files over one file")
    return pairs, beds, [bed.basename(b) if isinstance(b, str) else f"bed{i}" for i, b in enumerate(beds)]


def plot_enrichment(spark: SparkSession, files, samples, bed_files, basemod: str, out_dir: str | None = None, thresh_a: int = 129, thresh_c: int = 129, colors: list[str] | None = None) -> dict:
    """Fraction modified of each sample and BED file; all of them in one plan."""
    if basemod not in ("A", "CG"):
        raise RuntimeError("enrichment is of one modification: A or CG")
    pairs, beds, ids = _many(files, samples, bed_files)
    regions = _union([_regions(spark, b, i) for b, i in zip(beds, ids, strict=True)])
    reads = _union([_reads(spark, f, s, regions=regions) for f, s in pairs])
    found = extract.tallied(reads, regions, basemod, False, 1000, thresh_a, thresh_c, by_bed=True, calls=False)
    grid = spark.createDataFrame([(bed.basename(f) if isinstance(f, str) else s, i, s) for f, s in pairs for i in ids], "file_name string, bed_id string, sample string")
    sums = extract.tallied_pileup(found, ["bed_id", "sample"])
    m, t = F.coalesce("methylated_bases", F.lit(0)), F.coalesce("total_bases", F.lit(0))
    fractions = grid.join(sums, ["bed_id", "sample"], "left").select("file_name", "bed_id", "sample", F.coalesce(C.fraction(m, t), F.lit(0.0)).alias("fraction_methylated"))
    out = {"enrichment": fractions, "manifest": {}}
    if out_dir:
        fractions = out["enrichment"] = checkpointed(fractions)
        out["manifest"] = figures.write_data({"enrichment": fractions}, out_dir)
        bars = fractions.select(F.concat_ws(" ", "sample", "bed_id").alias("bar"), "fraction_methylated", "sample" if len(pairs) > 1 else "bed_id")
        page = os.path.join(out_dir, f"enrichment_{basemod}.html")
        out["manifest"]["page"] = figures.write_page(page, f"Enrichment {basemod}", {"fraction": ("bars", bars, *bars.columns)}, {"enrichment": fractions}, colors)
    return out


def plot_enrichment_profile(spark: SparkSession, files, samples, bed_files, basemod: str = "A+CG", out_dir: str | None = None, thresh_a: int = 129, thresh_c: int = 129, window_size: int = 1000, smooth: int = 50, min_periods: int = 10, color_a: str | None = None, color_c: str | None = None, colors: list[str] | None = None, dot_size: float = 0.5) -> dict:
    """Fractions around the centres of regions: a curve for each sample or BED file; for one of each also its molecules and base counts."""
    if basemod not in BASEMODS:
        raise ValueError(f"basemod is one of {', '.join(BASEMODS)}")
    pairs, beds, ids = _many(files, samples, bed_files)
    overlay = len(pairs) > 1 or len(beds) > 1
    if overlay and basemod == "A+CG":
        raise RuntimeError("an overlay is of one modification: A or CG")
    regions = _union([_regions(spark, b, i) for b, i in zip(beds, ids, strict=True)])
    reads = _union([_reads(spark, f, s, regions=regions) for f, s in pairs])
    tallied = lambda calls: extract.tallied(reads, regions, basemod, True, window_size, thresh_a, thresh_c, by_bed=True, calls=calls)
    found = stored(tallied(not overlay)) if out_dir else tallied(False)
    piled = stored(extract.tallied_pileup(found, ["bed_id", "sample", "pos", "mod"]))
    smooth_rows = C.smoothed(piled, ["bed_id", "sample"], "pos", smooth, min_periods)
    out = {"profile": C.curve(smooth_rows, ["bed_id", "sample"], "rolling_fraction"), "manifest": {}}
    if not overlay:
        first = extract.tallied_calls(found, extract.names_again(found)) if out_dir else extract.tallied_calls(tallied(True)).persist(StorageLevel.DISK_ONLY)  # read twice, but only if they are asked for
        few = bool(out_dir) and found.where("lead").limit(C.FEW_READS + 1).count() <= C.FEW_READS
        fam = piled.withColumn("family", mod_family(F.col("mod")))
        out |= {"molecules": C.points(first, ["sample"], few=few), "base_counts": C.dense_axis(fam, ["bed_id", "sample", "family"], "total_bases")}
    if out_dir:
        out["manifest"] = figures.write_data({k: v for k, v in out.items() if isinstance(v, DataFrame)}, out_dir)
        by = F.concat_ws(" ", "sample" if len(pairs) > 1 else "bed_id") if overlay else F.col("family")
        plots = {"profile": ("line", out["profile"].withColumn("line", by), "pos", "rolling_fraction", "line")}
        if not overlay:
            plots |= {"molecules": (out["molecules"], "pos", "read_row", "family"), "bases": ("line", out["base_counts"], "pos", "total_bases", "family")}
        own = colors if overlay else {k: v for k, v in (("A", color_a), ("C", color_c)) if v}
        out["manifest"]["page"] = figures.write_page(os.path.join(out_dir, f"profile_{basemod}.html"), f"Profile {basemod}", plots, {}, own or None, dot_size)
    return out


def qc_report(spark: SparkSession, files, samples, out_dir: str | None = None, primary_only: bool = False, colors: list[str] | None = None) -> dict:
    """Quality statistics of every read of each sample, unmapped ones included."""
    reads = _union([_reads(spark, f, s) for f, s in _paired(files, samples)])
    rows = qc.qc_rows(reads, primary_only)
    path = None  # the rows are stored first, so that the statistics read the table and not the files again
    if not out_dir:
        rows = stored(rows)
    else:
        path = tables.write_samples(rows, os.path.join(out_dir, "qc_reads"))
        rows = tables.read_samples(spark, path, as_list(samples))
    out = {"reads": rows, "summary": qc.summary_table(rows, ["sample"]), "histogram": qc.histogram(rows, ["sample"], few=True), "n50": qc.n50(rows, ["sample"]), "totals": qc.totals(rows, ["sample"]), "manifest": {}}
    if out_dir:
        out["manifest"] = {"reads": path} | figures.write_data({k: out[k] for k in ("summary", "histogram", "n50", "totals")}, out_dir)
        plots = {m: ("line", out["histogram"].where(F.col("metric") == m), "bin_start", "density", "sample") for m in qc.METRICS}
        out["manifest"]["page"] = figures.write_page(os.path.join(out_dir, "qc_report.html"), "Read quality", plots, {"summary": out["summary"], "totals": out["totals"], "n50": out["n50"]}, colors)
    return out
