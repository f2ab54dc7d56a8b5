"""The queries of the core problems (p2, p4, p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calypile.operators import intervals, profile, skew

READS, CALLS = "reads_samplename", "methylationbybase"
QUALITY = {"ave_baseq": (0, 93), "ave_alignq": (0, 93)}
PROB = {"prob": (0, 255)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.gaps(table(spark, d, READS).where(F.col("chr").isNotNull()), ["sample", "chr"], "start", "end")


def p2_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods(table(spark, d, READS).where(F.col("chr").isNotNull()), ["sample", "chr"], "start", "end")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, value in ((READS, "mapq"), (CALLS, "prob")):
        weighted = skew.compress(table(spark, d, name), ["chr"], [value])
        part = skew.heavy_keys(weighted, "chr", 0.05).select(F.lit(name).alias("table_name"), "chr")
        out = part if out is None else out.unionByName(part)
    return out


def _per_chr(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    keys = ["chr", "column_name"]
    weighted = skew.compress_columns(df, ["chr"], columns, "bigint")
    join = lambda a, b: a.alias("a").join(b.alias("b"), skew.same("a", "b", keys), "left").select("a.*", *[F.col(f"b.{c}") for c in b.columns if c not in keys])
    out = join(skew.key_counts(weighted, keys, "value"), skew.modes(weighted, keys, "value"))
    out = join(out, skew.percentiles(weighted, keys, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}))
    return out.select(F.lit(name).alias("table_name"), "column_name", "chr", "n_rows", "n_distinct", "mode", "mode_rows", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")])


def p4_per_chr(spark: SparkSession, d: str) -> DataFrame:
    return _per_chr(table(spark, d, READS), READS, ["mapq", "length"]).unionByName(_per_chr(table(spark, d, CALLS), CALLS, ["prob"]))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    loads = table(spark, d, "sample_loads")
    return profile.findings_of([(table(spark, d, READS), READS, QUALITY), (table(spark, d, CALLS), CALLS, PROB)], loads, "load_id", "ingest_seq")


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    loads = table(spark, d, "sample_loads")
    args = (loads, "load_id", "ingest_seq")
    both = profile.profile(table(spark, d, READS), READS, *args, QUALITY).unionByName(profile.profile(table(spark, d, CALLS), CALLS, *args, PROB))
    shares = {c: F.round(c, 6) for c in ("null_share", "prev_null_share", "largest_difference")}
    return both.withColumns(shares).drop("prev_n_inside", "prev_n_distinct", "prev_n_null", "prev_n_rows")


def p5_areas(spark: SparkSession, d: str) -> DataFrame:
    """The classifier's areas for every load and column, and the ground on which the column is suspect."""
    pairs = profile.preceding(table(spark, d, "sample_loads"))
    out = None
    for name, domains in ((READS, QUALITY), (CALLS, PROB)):
        tests = profile.two_sample(table(spark, d, name), "load_id", "ingest_seq", domains, pairs)
        part = tests.join(profile.suspects(tests, 0.30), ["load_id", "column_name"], "left").withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def p5_base(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, domains in ((READS, QUALITY), (CALLS, PROB)):
        part = profile.base(profile.value_weights(table(spark, d, name), "load_id", domains)).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {f.__name__: f for f in (p2_found, p2_periods, p4_found, p4_per_chr, p5_found, p5_profile, p5_areas, p5_base)}

_ISLANDS = """
with r as (select sample, chr, start s, "end" e from reads_samplename where chr is not null and start < "end"),
o as (select *, max(e) over (partition by sample, chr order by s, e rows between unbounded preceding and 1 preceding) m from r)
"""

_PER_CHR = """
select '{t}' as table_name, '{v}' as column_name, c.chr, c.n_rows, c.n_distinct, m.v as mode, m.w as mode_rows,
       round(c.p25, 6) as p25, round(c.p50, 6) as p50, round(c.p75, 6) as p75
from (select chr, count(*) n_rows, count(distinct {v}) n_distinct, quantile_cont({v}, 0.25) p25, quantile_cont({v}, 0.5) p50,
             quantile_cont({v}, 0.75) p75 from {t} group by chr) c
left join (select * from (select chr, cast({v} as bigint) v, count(*) w, row_number() over (partition by chr order by count(*) desc, {v}) rn
                          from {t} where {v} is not null group by chr, {v}) where rn = 1) m
on c.chr is not distinct from m.chr
"""

_COLUMNS = """
with x as (
  select 'reads_samplename' table_name, 'ave_baseq' column_name, load_id, ave_baseq v, 93 hi from reads_samplename union all
  select 'reads_samplename', 'ave_alignq', load_id, ave_alignq, 93 from reads_samplename union all
  select 'methylationbybase', 'prob', load_id, cast(prob as double), 255 from methylationbybase),
y as (select *, v is not null and not isnan(v) and v between 0 and hi as inside from x),
b as (select table_name, column_name, load_id, count(*) n_rows, count(*) filter (where v is null) n_null,
             count(*) filter (where v is not null and not inside) n_outside, count(*) filter (where inside) n_inside,
             count(distinct v) filter (where inside) n_distinct, min(v) filter (where inside) min_inside,
             max(v) filter (where inside) max_inside from y group by all)
"""

_CHANGES = """,
pairs as (select a.load_id, p.load_id prev_id from sample_loads a join sample_loads p on a.sample = p.sample and p.load_no = a.load_no - 1),
c as (select b.*, q.n_rows pr, q.n_null pn, q.n_distinct pd, q.n_inside pi, pairs.prev_id from b left join pairs using (load_id)
      left join b q on q.load_id = pairs.prev_id and q.column_name = b.column_name),
vals as (select column_name, load_id, v, count(*) w from y where inside group by all),
both_ as (select pairs.load_id, column_name, v, w a, 0 b from vals join pairs using (load_id) union all
          select pairs.load_id, column_name, v, 0, w from vals join pairs on vals.load_id = pairs.prev_id),
m as (select load_id, column_name, v, sum(a) a, sum(b) b from both_ group by all),
k as (select load_id, column_name, sum(a) over (partition by load_id, column_name order by v) ca, sum(b) over (partition by load_id, column_name order by v) cb,
             sum(a) over (partition by load_id, column_name) na, sum(b) over (partition by load_id, column_name) nb from m)"""

SQL = {
    "p2_found": _ISLANDS + "select sample, chr, m as gap_start, s as gap_end from o where m < s",
    "p2_periods": _ISLANDS + """, p as (select *, sum(case when m is null or m < s then 1 else 0 end) over (partition by sample, chr order by s, e rows unbounded preceding) g from o)
select sample, chr, min(s) as period_start, max(e) as period_end from p group by sample, chr, g""",
    "p4_found": """
select 'reads_samplename' as table_name, chr from reads_samplename where chr is not null group by chr
having count(*) * 20 >= (select count(*) from reads_samplename)
union all
select 'methylationbybase', chr from methylationbybase where chr is not null group by chr
having count(*) * 20 >= (select count(*) from methylationbybase)""",
    "p4_per_chr": " union all ".join(_PER_CHR.format(t=t, v=v) for t, v in ((READS, "mapq"), (READS, "length"), (CALLS, "prob"))),
    "p5_base": _COLUMNS + "select table_name, column_name, load_id, n_rows, n_null, n_outside, n_inside, n_distinct, min_inside, max_inside from b",
    "p5_found": _COLUMNS + _CHANGES + """,
d as (select load_id, column_name from k where na > 0 and nb > 0 group by all having max(10 * abs(ca * nb - cb * na) - 3 * na * nb) >= 0)
select table_name, column_name, load_id, 'range' as aspect from b where n_outside > 0 union all
select table_name, column_name, load_id, 'nulls' from c where pr is not null and 10 * abs(n_null * pr - pn * n_rows) >= n_rows * pr union all
select table_name, column_name, load_id, 'distinct' from c where pr is not null and n_distinct <> pd and (4 * n_distinct <= pd or n_distinct >= 4 * pd) union all
select b.table_name, b.column_name, b.load_id, 'distribution' from b join d using (load_id, column_name)""",
    "p5_profile": _COLUMNS + _CHANGES + """,
d as (select load_id, column_name, max(abs(ca * nb - cb * na)) * 1.0 / any_value(na * nb) as x from k where na > 0 and nb > 0 group by all)
select c.table_name, c.column_name, c.load_id, c.prev_id, n_rows, n_null, n_outside, n_inside, n_distinct, min_inside, max_inside, round(n_null * 1.0 / n_rows, 6) as null_share,
       round(pn * 1.0 / pr, 6) as prev_null_share, round(x, 6) as largest_difference from c left join d using (load_id, column_name)""",
}
