"""Distinct counts over huge identifier sets from mergeable bit matrices of hash ranks.

A set is a matrix of 2**p rows (stochastic averaging: the identifier's hash picks one) and 64 - p columns (the rank: trailing
zeros of the rest of the hash). An identifier sets one bit. Matrices merge by bitwise or, which is idempotent, so identifiers that
recur across days, chromosomes or modifications, and rows delivered twice, change nothing. In Spark a matrix is kept sparsely, one
row per (group, matrix row) with its bits in a bigint, built by the built-in bit_or: it combines before the shuffle and a hot
group is spread over its matrix rows.

Under Poisson sampling the cells are independent: cell (row, j) is set with probability 1 - exp(-n / m * 2**-(j + 1)), m = 2**p. The
estimate maximises that likelihood, and its standard error follows from the Fisher information at the estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

P = 10
#: Ranks that are told apart; higher ones count as the last. 2**(P + RANKS) identifiers are far beyond 2**40.
RANKS = 44


def matrices(df: DataFrame, keys: list[str], identifier: str, p: int = P) -> DataFrame:
    """Partial results: (keys, slot, bits). Null identifiers are not counted; null keys form groups of their own."""
    h = F.xxhash64(F.col(f"`{identifier}`"))
    slot = F.col("_h").bitwiseAND(F.lit((1 << p) - 1)).cast("int")
    rest = F.shiftrightunsigned(F.col("_h"), p)
    low = rest.bitwiseAND(-rest)  # the lowest set bit alone
    bit = F.when((low == 0) | (low > F.lit(1 << (RANKS - 1))), F.lit(1 << (RANKS - 1))).otherwise(low)
    own = [F.col(f"`{k}`") for k in keys]
    hashed = df.where(F.col(f"`{identifier}`").isNotNull()).select(*own, h.alias("_h"))
    return hashed.groupBy(*own, slot.alias("slot")).agg(F.bit_or(bit).alias("bits"))


def combine(partial: DataFrame, keys: list[str], cube: bool = False) -> DataFrame:
    """Union of partial results by bitwise or; cube: for every subset of keys, with the column grouping_set.

    grouping_set has a bit for each key, the first key's highest; a set bit means that the key is summed over (null then).
    """
    own = [F.col(f"`{k}`") for k in keys]
    if not cube:
        return partial.groupBy(*own, "slot").agg(F.bit_or("bits").alias("bits"))
    subsets = [F.struct(F.lit(mask).alias("grouping_set"), *[(F.lit(None).cast(partial.schema[k].dataType) if mask >> (len(keys) - 1 - i) & 1 else F.col(f"`{k}`")).alias(f"k{i}") for i, k in enumerate(keys)]) for mask in range(1 << len(keys))]
    rows = partial.select("slot", "bits", F.explode(F.array(*subsets)).alias("x"))
    grouped = rows.groupBy("x.grouping_set", *[F.col(f"x.k{i}").alias(k) for i, k in enumerate(keys)], "slot").agg(F.bit_or("bits").alias("bits"))
    return grouped.select(*own, "grouping_set", "slot", "bits")


def maximum_likelihood(counts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, standard error) from the number of set bits at each rank; a row of counts per set.

    The derivative of the log-likelihood falls in n, so Newton steps on log n are kept within a shrinking bracket.
    """
    weight = np.append(2.0 ** -np.arange(1, counts.shape[1]), 2.0 ** -(counts.shape[1] - 1))
    low, high = np.full(len(counts), -3.0), np.full(len(counts), 50.0)
    t = np.log(np.maximum(counts.sum(axis=1), 1))

    def parts(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = weight * (np.exp(t) / m)[:, None]
        odds = a / np.expm1(np.minimum(a, 700))  # a * exp(-a) / (1 - exp(-a))
        slope = (counts * odds - (m - counts) * a).sum(axis=1)
        return slope, (m * odds * a).sum(axis=1)  # d/dlog n, and the information about log n

    for _ in range(60):
        slope, info = parts(t)
        low, high = np.where(slope > 0, t, low), np.where(slope > 0, high, t)
        step = t + slope / np.maximum(info, 1e-12)
        new = np.where((step > low) & (step < high), step, (low + high) / 2)
        if np.abs(new - t).max(initial=0) < 1e-10:
            break
        t = new
    none = counts.sum(axis=1) == 0
    n = np.where(none, 0.0, np.exp(t))
    return n, np.where(none, 0.0, n / np.sqrt(np.maximum(parts(t)[1], 1e-12)))


def estimates(merged: DataFrame, keys: list[str], p: int = P, sigmas: float = 3.0) -> DataFrame:
    """One row per keys: distinct_estimate, std_error, lower, upper (sigmas standard errors around), all double.

    A group without identifiers has no row in merged and none here.
    """
    own = [F.col(f"`{k}`") for k in keys]
    set_at = [F.sum(F.shiftrightunsigned("bits", j).bitwiseAND(F.lit(1))).alias(f"c{j}") for j in range(RANKS)]
    counts = merged.groupBy(*own).agg(*set_at).select(*own, F.array(*[F.col(f"c{j}") for j in range(RANKS)]).alias("_counts"))

    def solve(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for counts in columns:
            if not len(counts):
                yield pd.DataFrame({"e": [], "s": []}, dtype=float)
                continue
            n, error = maximum_likelihood(np.stack(counts.to_numpy()).astype(float), 1 << p)
            yield pd.DataFrame({"e": n, "s": error})

    solved = F.pandas_udf(solve, "e double, s double")
    e, s = F.col("_x.e"), F.col("_x.s")
    return counts.withColumn("_x", solved("_counts")).select(
        *own, e.alias("distinct_estimate"), s.alias("std_error"), F.greatest(e - sigmas * s, F.lit(0.0)).alias("lower"), (e + sigmas * s).alias("upper")
    )
