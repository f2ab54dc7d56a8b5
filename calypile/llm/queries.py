"""The queries of the llm problems (p1, p3, p6, p7, p8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calypile.llm import distinct, packing, percentiles, residue, tokens

METRICS = ["length", "mapq", "ave_baseq", "ave_alignq"]
BY_READ = ["sample", "chr", "run_day"]
BY_CALL = ["run_day", "mod", "chr"]
QS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles for every combination of sample, chr and run_day, from one pass of daily partial sketches."""
    partial = percentiles.partials(_table(spark, d, "reads_samplename"), BY_READ, METRICS)
    return percentiles.percentiles(percentiles.combine(partial, BY_READ, METRICS, cube=True), [*BY_READ, "grouping_set"], METRICS, QS)


def p1_small_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of at most K values, for which the sketch is exact."""
    partial = percentiles.partials(_table(spark, d, "reads_samplename"), BY_READ, METRICS)
    return percentiles.percentiles(partial, BY_READ, METRICS, QS).where(F.col("n").between(1, percentiles.K)).drop("rank_error")


def _masked(df: DataFrame, keys: list[str], *others) -> DataFrame:
    """Each row once for every subset of keys, with grouping_set and the keys that are summed over null."""
    subsets = [F.struct(F.lit(mask).alias("grouping_set"), *[(F.lit(None).cast(df.schema[k].dataType) if mask >> (len(keys) - 1 - i) & 1 else F.col(k)).alias(k) for i, k in enumerate(keys)]) for mask in range(1 << len(keys))]
    return df.select(F.explode(F.array(*subsets)).alias("_g"), *others).select("_g.*", *[c for c in df.columns if c not in keys])


def _same(keys: list[str]):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return out


def p1_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Per combination of sample, chr and run_day and per column: its groups, and whether the percentiles keep the stated bound.

    A percentile misses if its true rank is further from the asked one than the stated error; that holds with probability 0.99 each, so
    one in a hundred may miss, and two more.
    """
    reads = _table(spark, d, "reads_samplename")
    got = p1_percentiles(spark, d)
    finite = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in METRICS]
    long = reads.select(*BY_READ, F.explode(F.array(*finite)).alias("v")).select(*BY_READ, "v.*").where("x is not null and not isnan(x) and abs(x) < double('infinity')")
    own, x = ["grouping_set", *BY_READ, "column_name"], F.col("x")
    rows = _masked(long.groupBy(*BY_READ, "column_name", "x").agg(F.count(F.lit(1)).alias("w")), BY_READ, "column_name", "x", "w")
    both = rows.alias("a").join(got.where("n > 0").alias("b"), _same(own)).select("a.*", "b.n", *[f"b.{q}" for q in QS], "b.rank_error")
    ranks = both.groupBy(*own, "n", "rank_error").agg(*[F.sum(F.when(x < F.col(q), F.col("w")).otherwise(0)).alias(f"{q}_lt") for q in QS], *[F.sum(F.when(x <= F.col(q), F.col("w")).otherwise(0)).alias(f"{q}_le") for q in QS])
    slack = F.col("n") * F.col("rank_error") + 1
    misses = sum(((F.col(f"{q}_lt") > F.col("n") * p + slack) | (F.col(f"{q}_le") < F.col("n") * p - slack)).cast("int") for q, p in QS.items())
    return ranks.groupBy("grouping_set", "column_name").agg(F.count(F.lit(1)).alias("n_groups"), (F.sum(misses) <= F.ceil(F.count(F.lit(1)) * len(QS) / 100) + 2).alias("within"))


def p3_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct reads for every combination of run_day, mod and chr, from partial bit matrices per day."""
    partial = distinct.matrices(_table(spark, d, "methylationbybase"), BY_CALL, "read_name")
    return distinct.estimates(distinct.combine(partial, BY_CALL, cube=True), [*BY_CALL, "grouping_set"])


def p3_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Per combination of run_day, mod and chr: its groups, the sum of their exact counts, and whether the estimates keep the stated bounds.

    A group misses if the exact count is outside lower and upper, three standard errors away; one in a hundred may, and one more.
    """
    calls = _table(spark, d, "methylationbybase").where("read_name is not null").select(*BY_CALL, "read_name").distinct()
    own = ["grouping_set", *BY_CALL]
    exact = _masked(calls, BY_CALL, "read_name").groupBy(*own).agg(F.countDistinct("read_name").alias("n"))
    both = exact.alias("a").join(p3_distinct(spark, d).alias("b"), _same(own), "left").select("a.*", "lower", "upper")
    missed = F.sum((~F.coalesce((F.col("n") >= F.col("lower") - 0.5) & (F.col("n") <= F.col("upper") + 0.5), F.lit(False))).cast("int"))
    return both.groupBy("grouping_set").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_exact"), (missed <= F.ceil(F.count(F.lit(1)) / 100) + 1).alias("within"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_ids(_table(spark, d, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tokens.round_trip(_table(spark, d, "documents"), "doc_id", "text")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.count_tokens(_table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per document: whether its pieces are in order, complete and no more than needed, and no container holds too much."""
    packed = _packed(spark, d)
    full = packing.containers(packed).where("unused < 0").agg(F.count(F.lit(1)).alias("n")).scalar()
    pieces = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.max(F.col("start_token") + F.col("n_tokens")).alias("last"), F.countDistinct("piece").alias("p"))
    kept = (F.col("n") == F.col("last")) & (F.col("k") == F.greatest(F.ceil(F.col("n") / packing.CAPACITY), F.lit(1))) & (F.col("k") == F.col("p")) & (full == 0)
    return pieces.select("doc_id", kept.alias("kept"))


def p7_unused(spark: SparkSession, d: str) -> DataFrame:
    """The texts packed by their characters, 8,192 to a container: the pieces, the least number of containers, and whether there is at most 1 % more."""
    packed = packing.pack(_table(spark, d, "documents").select("doc_id", F.length("text").alias("n")), "doc_id", "n", 8192)
    least = F.ceil(F.sum("used") / 8192)
    return packing.containers(packed, 8192).agg(F.sum("n_pieces").alias("n_pieces"), least.alias("least"), (F.count(F.lit(1)) <= F.ceil(least * 1.01) + 1).alias("tight"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(_table(spark, d, "documents"), "doc_id", "text")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return residue.decide(_table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_small_groups, p1_within_bound, p3_distinct, p3_within_bound, p6_ids, p6_round_trip, p7_packed, p7_kept, p7_unused, p8_found, p8_scores)}

_LONG = """
with x as (
  select sample, chr, run_day, 'length' column_name, cast("length" as double) v from reads_samplename union all
  select sample, chr, run_day, 'mapq', cast(mapq as double) from reads_samplename union all
  select sample, chr, run_day, 'ave_baseq', ave_baseq from reads_samplename union all
  select sample, chr, run_day, 'ave_alignq', ave_alignq from reads_samplename),
f as (select * from x where v is not null and isfinite(v))
"""

SQL = {
    "p1_small_groups": _LONG
    + "select sample, chr, run_day, column_name, count(*) as n, "
    + ", ".join(f"list_sort(list(v))[greatest(cast(ceil({q} * count(*)) as bigint), 1)] as {n}" for n, q in QS.items())
    + " from f group by all having count(*) <= 200",
    "p1_within_bound": _LONG + """, g as (select distinct grouping_id(sample, chr, run_day) as gs, sample, chr, run_day, column_name, count(*) n from f group by column_name, cube (sample, chr, run_day))
select cast(gs as int) as grouping_set, column_name, count(*) as n_groups, true as within from g group by all""",
    "p3_within_bound": """with g as (select grouping_id(run_day, mod, chr) as gs, count(distinct read_name) n from methylationbybase where read_name is not null group by cube (run_day, mod, chr))
select cast(gs as int) as grouping_set, count(*) as n_groups, cast(sum(n) as bigint) as n_exact, true as within from g group by gs""",
    "p6_round_trip": "select doc_id, coalesce(strlen(text), 0) as n_bytes, true as same from documents",
    "p7_unused": "select cast(sum(greatest(ceil(coalesce(length(text), 0) / 8192), 1)) as bigint) as n_pieces, cast(ceil(sum(length(text)) / 8192) as bigint) as least, true as tight from documents",
    "p7_kept": "select doc_id, true as kept from documents",
}
