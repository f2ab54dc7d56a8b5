import numpy as np
import pytest

from calypile.operators import qc


def test_statistics_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.lognormal(8, 1, 501).astype(int)
    df = spark.createDataFrame([("s", int(v), 60, float(v) / 100, None) for v in x] + [("s", None, 60, float("nan"), None)], "sample string, length bigint, mapq int, ave_baseq double, ave_alignq double")
    got = {r["metric"]: r for r in qc.summary(df, ["sample"]).collect()}
    assert "ave_alignq" not in got and got["ave_baseq"]["n"] == 501
    r = got["length"]
    assert [r["min"], r["q1"], r["median"], r["q3"], r["max"], r["mean"]] == pytest.approx([x.min(), *np.quantile(x, [0.25, 0.5, 0.75]), x.max(), x.mean()])
    q1, q3 = np.quantile(x, [0.25, 0.75])
    kept = x[x <= q3 + 3 * (q3 - q1)]
    want, edges = np.histogram(kept, 200, density=True)
    hist = {r["bin"]: r["density"] for r in qc.histogram(df, ["sample"], ("length",)).collect()}
    np.testing.assert_allclose([hist.get(i, 0.0) for i in range(200)], want, atol=1e-12)
    flat = qc.histogram(df, ["sample"], ("mapq",)).collect()
    assert [(r["bin"], r["count"], r["density"]) for r in flat] == [(0, 502, 1.0)]
    down = np.sort(x)[::-1]
    assert qc.n50(df, ["sample"]).first()["n50"] == down[np.argmax(np.cumsum(down) > down.sum() / 2)]
    t = qc.totals(df, ["sample"]).first()
    assert (t["n_reads"], t["n_bases"], t["n_bases_exact"]) == (502, round(x.mean()) * 502, x.sum())


def test_empty(spark):
    df = spark.createDataFrame([], "sample string, length bigint, mapq int, ave_baseq double, ave_alignq double")
    for f in (qc.summary, qc.summary_table, qc.histogram, qc.n50, qc.totals):
        assert f(df, ["sample"]).count() == 0


def test_a_null_sample_is_a_sample(spark):
    rows = [(s, n, 1, float(n), 1.0) for s in ("a", None) for n in (10, 20, 30, 40)]
    df = spark.createDataFrame(rows, "sample string, length bigint, mapq int, ave_baseq double, ave_alignq double")
    for f in (qc.summary, qc.n50, qc.totals, qc.histogram, lambda d, k: qc.histogram(d, k, few=False)):
        got = {}
        for r in f(df, ["sample"]).collect():
            got.setdefault(r["sample"], set()).add(tuple(r)[1:])
        assert set(got) == {"a", None} and got["a"] == got[None]
