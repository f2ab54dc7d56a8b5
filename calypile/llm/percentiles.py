"""Percentiles of very large numeric columns, per group, from partial results that can be combined.

A sketch is a hierarchy of randomized compactors (KLL): a full level is sorted, every other value, from a random offset, moves
up with twice the weight, and sketches merge level by level. Spark's own aggregate of that kind is used, so the work stays in
the JVM, combines before the shuffle, and a hot group costs one sketch per input partition. A partial table holds one binary
sketch per group and column and can be stored per load or day; combining partials gives the same bound as one pass.

The rank of a returned value differs from the asked rank by at most rank_error(k) * n, with probability 0.99 for one
percentile. Groups of at most k values are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 200


def rank_error(k: int = K) -> float:
    """Normalized rank error of one percentile with 99 % confidence; the constants are those published for this sketch."""
    return 2.296 / k**0.9723


def _finite(name: str) -> Column:
    x = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def partials(df: DataFrame, keys: list[str], values: list[str], k: int = K) -> DataFrame:
    """One row per keys with, for each value column, its sketch (same name) and exact count (n_ + name).

    Null, NaN and infinite values do not count. Null keys form a group of their own. A sketch without values is null.
    """
    aggs = []
    for v in values:
        x = _finite(v)
        aggs += [F.count(x).alias(f"n_{v}"), F.kll_sketch_agg_double(x, F.lit(k)).alias(v)]
    out = df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(*aggs)
    return out.select(*[F.col(f"`{c}`") for c in keys], *[F.col(f"n_{v}") for v in values], *[F.when(F.col(f"n_{v}") > 0, F.col(v)).alias(v) for v in values])


def combine(partial: DataFrame, keys: list[str], values: list[str], cube: bool = False, k: int = K) -> DataFrame:
    """Partials of the same columns merged over keys; cube: for every subset of keys, with the column grouping_set.

    grouping_set has a bit for each key, the first key's highest; a set bit means that the key is summed over (null then).
    """
    aggs = []
    for v in values:
        aggs += [F.sum(f"n_{v}").alias(f"n_{v}"), F.kll_merge_agg_double(F.col(v), F.lit(k)).alias(v)]
    own = [F.col(f"`{c}`") for c in keys]
    grouped = partial.cube(*own) if cube else partial.groupBy(*own)
    out = grouped.agg(*([F.grouping_id().cast("int").alias("grouping_set")] if cube else []), *aggs)
    return out.select(*own, *(["grouping_set"] if cube else []), *[f"n_{v}" for v in values], *[F.when(F.col(f"n_{v}") > 0, F.col(v)).alias(v) for v in values])


def percentiles(sketches: DataFrame, keys: list[str], values: list[str], qs: dict[str, float], k: int = K) -> DataFrame:
    """One row per keys and value column: column_name, n, one column per entry of qs, and the rank error of the sketch.

    A column without values in its group has n = 0 and null percentiles.
    """
    parts = F.explode(F.array(*[F.struct(F.lit(v).alias("column_name"), F.col(f"n_{v}").alias("n"), F.col(v).alias("sketch")) for v in values])).alias("x")
    ranks = F.array(*[F.lit(float(q)) for q in qs.values()])
    got = sketches.select(*keys, parts).select(*keys, "x.*").withColumn("_q", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", ranks)))
    return got.select(*keys, "column_name", "n", *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(qs)], F.when(F.col("n") > k, F.lit(rank_error(k))).otherwise(F.lit(0.0)).alias("rank_error"))
