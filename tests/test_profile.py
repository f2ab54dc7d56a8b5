import numpy as np
import pandas as pd
import pytest

from calypile.operators import profile as P

SCHEMA = "ingest_seq bigint, load_id int, x double, value string, weight int"
LOADS = "load_id int, sample string, load_no int"


def brute(rows, loads, lo=0, hi=93):
    by = {}
    for _, load, x, *_ in rows:
        by.setdefault(load, []).append(x)
    inside = {k: sorted(v for v in xs if v is not None and not np.isnan(v) and lo <= v <= hi) for k, xs in by.items()}
    at = {(s, n): i for i, s, n in loads}
    out = set()
    for k, xs in by.items():
        if any(v is not None and not (lo <= v <= hi) for v in xs):
            out.add(("range", k))
        prev = next((at.get((s, n - 1)) for i, s, n in loads if i == k), None)
        if prev not in by:
            continue
        a, b = by[k], by[prev]
        if abs(a.count(None) * len(b) - b.count(None) * len(a)) * 10 >= len(a) * len(b):
            out.add(("nulls", k))
        d, p = len(set(inside[k])), len(set(inside[prev]))
        if d != p and (4 * d <= p or d >= 4 * p):
            out.add(("distinct", k))
        u, v = inside[k], inside[prev]
        if u and v:
            gap = max(abs(np.searchsorted(u, x, "right") * len(v) - np.searchsorted(v, x, "right") * len(u)) for x in {*u, *v})
            if 10 * gap >= 3 * len(u) * len(v):
                out.add(("distribution", k))
    return out


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(5)
    rows, loads, n = [], [], 0
    kinds = ["plain", "plain", "shift", "shift", "nulls", "plain", "few", "plain", "spread", "out", "tiny", "empty", "plain", "border"]
    for sample in ("a", "b"):
        for no, kind in enumerate(kinds, 1):
            load = len(loads) + 1
            loads.append((load, sample, no))
            size = 3 if kind == "tiny" else 300
            x = rng.normal(20, 4, size).round(2)
            if kind == "shift":
                x = x + 6
            if kind == "few":
                x = rng.choice([18.0, 22.0], size)
            if kind == "spread":
                x = 20 + (x - 20) * 6
            values = [None if (kind == "nulls" and i % 4 == 0) or kind == "empty" else float(v) for i, v in enumerate(x)]
            if kind == "out":
                values[:3] = [float("nan"), float("inf"), -0.5]
            if kind == "border":
                values[:3] = [0.0, 93.0, -0.0]
            for v in values:
                n += 1
                rows.append((n, load, v, "clash", 9))
    return rows, loads


def test_findings_equal_brute_force(spark, made):
    rows, loads = made
    got = P.findings(spark.createDataFrame(rows, SCHEMA), "t", spark.createDataFrame(loads, LOADS), "load_id", "ingest_seq", {"x": (0, 93)})
    assert {(r["aspect"], r["load_id"]) for r in got.collect()} == brute(rows, loads)
    assert got.columns == ["table_name", "column_name", "load_id", "aspect"]


def test_empty_tables_and_rows_of_unknown_loads(spark):
    loads = spark.createDataFrame([], LOADS)
    assert P.findings(spark.createDataFrame([], SCHEMA), "t", loads, "load_id", "ingest_seq", {"x": (0, 93)}).count() == 0
    rows = spark.createDataFrame([(1, 7, 500.0, "", 0), (2, None, 1.0, "", 0)], SCHEMA)
    assert [r["aspect"] for r in P.findings(rows, "t", loads, "load_id", "ingest_seq", {"x": (0, 93)}).collect()] == ["range"]


def test_classifier_discriminates_what_changed(spark):
    rng = np.random.default_rng(1)
    a = pd.DataFrame({"ingest_seq": range(4000), "load_id": np.repeat([1, 2], 2000), "x": np.r_[rng.normal(20, 3, 2000), rng.normal(23, 3, 2000)], "y": rng.normal(30, 5, 4000)})
    loads = spark.createDataFrame([(1, "s", 1), (2, "s", 2)], LOADS)
    got = {r["column_name"]: r for r in P.two_sample(spark.createDataFrame(a), "load_id", "ingest_seq", {"x": (0, 93), "y": (0, 93)}, P.preceding(loads)).collect()}
    assert got["x"]["auc_alone"] > 0.7 and abs(got["y"]["auc_alone"] - 0.5) < 0.05
    assert got["x"]["auc_full"] > 0.7 and got["x"]["auc_without"] < 0.56 and got["y"]["auc_without"] > 0.7


def test_base_counts(spark, made):
    rows, _ = made
    got = P.base(P.value_weights(spark.createDataFrame(rows, SCHEMA), "load_id", {"x": (0, 93)}))
    one = got.where("load_id = 10").first()
    assert (one["n_rows"], one["n_outside"], one["n_null"], one["n_inside"]) == (300, 3, 0, 297)


@pytest.mark.parametrize("shift", [0.05, 0.1, 0.2, 0.3, 0.5])
def test_the_gate_keeps_every_change_of_the_asked_size(spark, shift):
    """Loads that differ by a little less, as much and a little more than shift, in four shapes and sizes: every change is found, no other is."""
    rng = np.random.default_rng(int(shift * 100))
    rows, loads, n = [], [], 0
    for sample, size in (("small", 300), ("middle", 3000), ("large", 12_000)):
        for no in range(1, 9):
            part = shift * (0.9, 1.15, 1.02, 1.4)[no // 2 % 4] if no % 2 == 0 else 0.0
            x = rng.normal(40, 8, size)
            moved = rng.random(size) < part
            x = np.where(moved, (x + 45, 3.0, 90 - x / 9, x / 4)[no // 2 % 4], x).clip(0, 93)
            load = len(loads) + 1
            loads.append((load, sample, no))
            rows.append(pd.DataFrame({"ingest_seq": np.arange(n, n + size), "load_id": load, "x": x.round(3)}))
            n += size
    df = pd.concat(rows)
    values = {k: np.sort(g["x"].to_numpy()) for k, g in df.groupby("load_id")}
    want = set()
    for load, _, no in loads:
        if no > 1:
            a, b = values[load], values[load - 1]
            at = np.union1d(a, b)
            if np.abs(np.searchsorted(a, at, "right") * len(b) - np.searchsorted(b, at, "right") * len(a)).max() >= round(shift * len(a) * len(b), 3):
                want.add(load)
    got = P.findings(spark.createDataFrame(df), "t", spark.createDataFrame(loads, LOADS), "load_id", "ingest_seq", {"x": (0, 93)}, shift=shift)
    assert {r["load_id"] for r in got.where("aspect = 'distribution'").collect()} == want and want


def test_a_column_that_the_others_know_of_is_told_by_ablation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(20, 3, 8000)
    frame = pd.DataFrame({"ingest_seq": range(8000), "load_id": np.repeat([1, 2], 4000), "x": x, "y": 60 - x + np.repeat([0, 1], 4000) * 4 + rng.normal(0, 1, 8000), "z": rng.normal(30, 5, 8000)})
    loads = spark.createDataFrame([(1, "s", 1), (2, "s", 2)], LOADS)
    tests = P.two_sample(spark.createDataFrame(frame), "load_id", "ingest_seq", {c: (0, 93) for c in "xyz"}, P.preceding(loads))
    got = {r["column_name"]: r for r in tests.collect()}
    grounds = {r["column_name"]: r["ground"] for r in P.suspects(tests, 0.3).collect()}
    # x itself did not change, but what it says of y did: without it the model tells less
    assert got["x"]["auc_full"] - got["x"]["auc_without"] > 0.05 and abs(got["x"]["auc_alone"] - 0.5) < 0.03
    assert grounds["y"] == "alone" and "z" not in grounds and abs(got["z"]["auc_full"] - got["z"]["auc_without"]) < 0.02


def test_columns_without_usable_values(spark):
    """Of one or both loads, in one or all columns: no distribution is found, and nothing fails."""
    rows = [(i, 1 + i // 40, [None, 500.0, 20.0 + i % 7][(i // 20) % 3] if i < 120 else None, float("nan") if i < 80 else 5.0) for i in range(160)]
    loads = spark.createDataFrame([(k, "s", k) for k in range(1, 7)], LOADS)
    df = spark.createDataFrame(rows, "ingest_seq bigint, load_id int, x double, y double")
    got = P.findings(df, "t", loads, "load_id", "ingest_seq", {"x": (0, 93), "y": (0, 93)}).collect()
    assert {(r["column_name"], r["load_id"]) for r in got if r["aspect"] == "distribution"} <= {("x", 2), ("x", 3)}
    assert {(r["column_name"], r["load_id"]) for r in got if r["aspect"] == "range"} == {("x", 1), ("x", 3), ("y", 1), ("y", 2)}
    none = P.findings(df.where("load_id = 4"), "t", loads, "load_id", "ingest_seq", {"x": (0, 93)}).collect()
    assert [r["aspect"] for r in none] == []


def test_each_table_is_scanned_once(spark, tmp_path):
    from calypile.plans import problems

    spark.createDataFrame([(i, i % 2 + 1, float(i % 50), float(i % 40)) for i in range(600)], "ingest_seq bigint, load_id int, ave_baseq double, ave_alignq double").write.parquet(f"{tmp_path}/{problems.READS}.parquet")
    df = P.findings(spark.read.parquet(f"{tmp_path}/{problems.READS}.parquet"), "t", spark.createDataFrame([(1, "s", 1), (2, "s", 2)], LOADS), "load_id", "ingest_seq", problems.QUALITY)
    assert problems.READS not in df._jdf.queryExecution().optimizedPlan().toString() and problems.READS not in " ".join(df.inputFiles())


def test_tables_with_a_column_of_one_name_are_kept_apart(spark, made):
    """Of tables in one call each column has the findings it has alone."""
    rows, loads = made
    x = spark.createDataFrame(rows, SCHEMA)
    moved = x.selectExpr("ingest_seq", "load_id", "90 - x as y", "x * 2 + load_id % 3 * 10 as x")
    parts = [(x, "one", {"x": (0, 93)}), (moved, "two", {"y": (0, 93), "x": (0, 255)}), (x.limit(0), "none", {"x": (0, 93)})]
    table = spark.createDataFrame(loads, LOADS)
    got = [tuple(r) for r in P.findings_of(parts, table, "load_id", "ingest_seq").collect()]
    assert len(got) == len(set(got)) and {(a, k) for t, c, k, a in got if t == "one"} == brute(rows, loads)
    for c, hi in (("x", 255), ("y", 93)):
        values = [(r["ingest_seq"], r["load_id"], r[c]) for r in moved.collect()]
        assert {(a, k) for t, n, k, a in got if (t, n) == ("two", c)} == brute(values, loads, 0, hi)
    assert {t for t, *_ in got} == {"one", "two"}


def test_p5_found_runs_in_few_stages(spark):
    """The driver keeps a thread of each stage for a minute and replans what is left after it; with 122 stages here it came beyond its 1,500 MB."""
    from calypile.plans import problems

    spark.sparkContext.setJobGroup("p5_found", "")
    try:
        problems.p5_found(spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    tracker = spark.sparkContext.statusTracker()
    stages = sum(len(tracker.getJobInfo(job).stageIds) for job in tracker.getJobIdsForGroup("p5_found"))
    assert 0 < stages <= 70
