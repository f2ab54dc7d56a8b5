import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from calypile.operators import skew


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [("hot", float(v)) for v in np.round(rng.lognormal(3, 2, 4000), 2)] + [("cold", float(v)) for v in rng.integers(-5, 5, 60)]
    return [*out, ("hot", None), ("none", None), (None, 1.0), (None, 3.0), ("one", 7.0), ("zero", 0.0), ("zero", -2.0)]


@pytest.mark.parametrize("interpolate", [True, False])
def test_percentiles_equal_numpy(spark, rows, interpolate):
    df = spark.createDataFrame(rows, "k string, v double")
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["k"]: r for r in skew.percentiles(skew.compress(df, ["k"], ["v"]), ["k"], "v", qs, interpolate=interpolate).collect()}
    for key in {k for k, _ in rows}:
        values = [v for k, v in rows if k == key and v is not None]
        if not values:
            assert key not in got
            continue
        want = np.quantile(values, list(qs.values()), method="linear" if interpolate else "inverted_cdf")
        assert [got[key][n] for n in qs] == pytest.approx(want)


def test_counts_and_modes(spark, rows):
    weighted = skew.compress(spark.createDataFrame(rows, "k string, v double"), ["k"], ["v"])
    counts = {r["k"]: (r["n_rows"], r["n_distinct"]) for r in skew.key_counts(weighted, ["k"], "v").collect()}
    modes = {r["k"]: (r["mode"], r["mode_rows"]) for r in skew.modes(weighted, ["k"], "v").collect()}
    for key in {k for k, _ in rows}:
        values = [v for k, v in rows if k == key]
        have = [v for v in values if v is not None]
        assert counts[key] == (len(values), len(set(have)))
        if have:
            best = max(set(have), key=lambda v: (have.count(v), -v))
            assert modes[key] == (best, have.count(best))
        else:
            assert key not in modes


def test_heavy_keys_bound_is_included_and_nulls_count(spark):
    rows = [("a",)] * 5 + [("b",)] * 4 + [(None,)] * 91
    weighted = skew.compress(spark.createDataFrame(rows, "k string").selectExpr("k", "1 v"), ["k"], ["v"])
    assert [r["k"] for r in skew.heavy_keys(weighted, "k", 0.05).collect()] == ["a"]
    assert skew.heavy_keys(skew.compress(spark.createDataFrame([], "k string, v int"), ["k"], ["v"]), "k", 0.05).count() == 0


@given(st.lists(st.one_of(st.floats(allow_nan=False), st.integers(-(10**6), 10**6).map(float)), min_size=2, max_size=30))
@settings(max_examples=8, deadline=None)
def test_order_bucket_never_falls(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", skew.order_bucket(df_col("v")).alias("b"))
    got = sorted((r["v"], r["b"]) for r in df.collect())
    assert [b for _, b in got] == sorted(b for _, b in got)


def df_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_close_values_of_a_hot_key_are_split(spark):
    from pyspark.sql import functions as F

    # a million different values within one of order_bucket's buckets, beside far outliers
    close = spark.range(1_000_000).select(F.lit("hot").alias("k"), (F.lit(1e6) + F.col("id") / 1000).alias("v"))
    df = close.union(spark.createDataFrame([("hot", -1e300), ("hot", 1e300), ("cold", 1e6), ("cold", 1e6 + 1)], "k string, v double"))
    bucket, place = skew._digits(F.col("v"))
    assert df.groupBy("k", bucket).count().agg({"count": "max"}).first()[0] > 900_000
    most = df.groupBy("k", bucket, place).count().agg({"count": "max"}).first()[0]
    assert most < 1000  # of the 2**23 a task may get
    got = {r["k"]: r for r in skew.percentiles(skew.compress(df, ["k"], ["v"]), ["k"], "v", {"a": 0.25, "b": 0.5, "c": 1.0}).collect()}
    values = np.sort(np.r_[1e6 + np.arange(1_000_000) / 1000, -1e300, 1e300])
    assert [got["hot"][c] for c in "abc"] == pytest.approx(np.quantile(values, [0.25, 0.5, 1.0]))
    assert got["cold"]["b"] == 1e6 + 0.5


@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=2, max_size=40, unique=True))
@settings(max_examples=8, deadline=None)
def test_digits_are_in_the_order_of_the_values(spark, values):
    values += [np.nextafter(v, np.inf) for v in values[:5] if abs(v) < 1e308] + [2.0**k for k in (-1074, -3, 0, 29, 1023)]
    bucket, place = skew._digits(df_col("v"))
    got = sorted((r["v"], r["b"], r["p"]) for r in spark.createDataFrame([(float(v),) for v in values], "v double").select("v", bucket.alias("b"), place.alias("p")).collect())
    assert [x[1:] for x in got] == sorted(x[1:] for x in got)


def test_small_integers_and_long_columns(spark):
    rng = np.random.default_rng(9)
    rows = [("a", int(x), int(y)) for x, y in zip(rng.integers(-(2**31), 2**31, 700), rng.integers(-(2**62), 2**62, 700))] + [("a", None, None)]
    long = skew.compress_columns(spark.createDataFrame(rows, "k string, i int, l bigint"), ["k"], ["i", "l"], "bigint")
    got = {r["column_name"]: r for r in skew.percentiles(long, ["k", "column_name"], "value", {"m": 0.5}, interpolate=False).collect()}
    for c, at in (("i", 1), ("l", 2)):
        assert got[c]["m"] == float(np.quantile([r[at] for r in rows[:-1]], 0.5, method="inverted_cdf"))
    small = skew.compress(spark.createDataFrame(rows, "k string, i int, l bigint"), ["k"], ["i"])
    assert skew.percentiles(small, ["k"], "i", {"m": 0.5}).first()["m"] == float(np.median([r[1] for r in rows[:-1]]))


def test_one_scan_serves_all_that_is_made_of_a_compression(spark, tmp_path):
    from calypile.plans import problems

    spark.createDataFrame([("c", i % 7, i) for i in range(500)] + [(None, None, 3)], "chr string, mapq int, length bigint").write.parquet(f"{tmp_path}/{problems.READS}.parquet")
    spark.createDataFrame([("c", i % 9) for i in range(500)], "chr string, prob int").write.parquet(f"{tmp_path}/{problems.CALLS}.parquet")
    for query in (problems.p4_found, problems.p4_per_chr):
        df = query(spark, str(tmp_path))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ColumnarToRow") == 2 < plan.count("FileScan parquet")  # scans of plans that ran stand under ColumnarToRow
