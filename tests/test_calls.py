import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from calypile.functions import reads as fr
from calypile.operators import calls as C
from calypile.operators import regions as R


def test_rolling_equals_pandas_over_blocks(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"sample": rng.choice(["a", "b"], 900, p=[0.9, 0.1]), "chr": "c", "pos": rng.permutation(200_000)[:900], "mod": "A+a", "methylated_bases": rng.integers(0, 5, 900), "total_bases": rng.integers(0, 9, 900)})
    for window, least, block in ((50, 10, 60), (7, 7, 30), (4, 1, 1000), (1, 1, 10)):
        got = C.smoothed(spark.createDataFrame(pdf), ["sample", "chr"], "pos", window, least, block).toPandas()
        for s, part in pdf.groupby("sample"):
            part = part.sort_values("pos")
            part = part.assign(f=np.where(part.total_bases > 0, part.methylated_bases / part.total_bases.where(part.total_bases > 0), np.nan))
            mine = got[got["sample"] == s].sort_values("pos")
            for a, b in (("rolling_total", "total_bases"), ("rolling_fraction", "f")):
                np.testing.assert_allclose(mine[a].astype(float), part[b].rolling(window, least, center=True).mean(), atol=1e-9)


def greedy(rows, limit=1000):
    layers, out = [], {}
    for name, a, b in sorted(rows, key=lambda r: (r[1], -r[2], r[0])):
        for k in range(limit):
            if k == len(layers):
                layers.append(None)
            if layers[k] is None or a > layers[k]:
                layers[k], out[name] = b, k + 1
                break
        else:
            out[name] = None
    return out


@pytest.mark.parametrize("limit", [1000, 3])
def test_layers_equal_greedy(spark, limit):
    rng = np.random.default_rng(limit)
    rows = [(f"r{i}", int(a), int(a + rng.integers(0, 400))) for i, a in enumerate(rng.integers(0, 5000, 150))]
    df = spark.createDataFrame([("s", *r) for r in rows], "sample string, read_name string, posmin bigint, posmax bigint")
    got = C.layers(df, ["sample"], limit)
    assert {r["read_name"]: r["height"] for r in got.collect()} == greedy(rows, limit)
    assert C.hidden_reads(got, ["sample"]).first()["n_hidden"] == sum(v is None for v in greedy(rows, limit).values())


def test_first_per_id_dense_axis_and_bins(spark):
    df = spark.createDataFrame([("s", "a", 2), ("s", "a", 1), ("s", None, 3), ("s", None, 4), ("t", "a", 5)], "sample string, id string, seq int")
    assert sorted(r["seq"] for r in C.first_per_id(df, ["seq"]).collect()) == [1, 3, 4, 5]
    piled = spark.createDataFrame([("k", 5, 2, 4), ("k", 8, 1, 1), ("k", 8, 1, 3), ("one", 7, 1, 1)], "k string, pos bigint, methylated_bases bigint, total_bases bigint")
    assert sorted(map(tuple, C.dense_axis(piled, ["k"], "total_bases").collect())) == [("k", 5, 4), ("k", 6, 0), ("k", 7, 0)]
    got = {(r["k"], r["bin_start"]): r["fraction"] for r in C.bins(piled, ["k"], 4).collect()}
    assert got == {("k", 4): 0.5, ("k", 8): 0.5, ("one", 4): 1.0}


def test_enrichment_is_zero_without_sites(spark):
    groups = spark.createDataFrame([("x",), ("y",)], "bed_id string")
    sites = spark.createDataFrame([("x", 200), ("x", 128), ("x", 129), ("x", None)], "bed_id string, prob int")
    assert sorted(map(tuple, C.enrichment(sites, groups, ["bed_id"]).collect())) == [("x", 2, 4, 0.5), ("y", 0, 0, 0.0)]


def test_overlaps_windows_and_centres(spark):
    reads = spark.createDataFrame([(1, "c", 0, 10), (2, "c", 10, 20), (3, "d", 0, 10), (4, "c", None, 5), (5, "c", 9, 9), (6, None, 0, 9), (7, "c", 0, 1 << 20)], "i int, chr string, start bigint, end bigint")
    regions = spark.createDataFrame([("b", 0, "c", 5, 10, "+"), ("b", 1, "c", 4, 15, "-"), ("b", 2, "c", 8, 8, "x"), ("b", 3, "c", 1 << 18, (1 << 18) + 9, None)], "bed_id string, region_idx bigint, chr string, begin_pos bigint, end_pos bigint, strand string")
    want = [(1, 0), (1, 1), (2, 1), (7, 0), (7, 1), (7, 3)]
    for few in (None, False, True):
        assert sorted((r["i"], r["region_idx"]) for r in R.overlap_join(reads, regions, few=few).collect()) == want
    calls = spark.createDataFrame([("c", p) for p in (4, 5, 6, 9, 10, 14, 15)], "chr string, pos bigint")
    inside = sorted((r["region_idx"], r["pos"]) for r in R.in_window(calls, regions).collect())
    assert inside == [(0, 6), (0, 9), (1, 5), (1, 6), (1, 9), (1, 10), (1, 14)]
    around = sorted((r["region_idx"], r["rel_pos"]) for r in R.around_center(calls, regions, 2).collect())
    # centres: 7.5 -> 8, 9.5 -> 10 (half to even)
    assert around == [(0, -2), (0, 1), (0, 2), (1, 0), (1, 1)]


def test_region_literals(spark):
    assert R.parse_region("chr1:2,907,273-2909473") == ("chr1", 2907273, 2909473)
    assert R.parse_region("7:1-2")[0] == "7"
    for bad in ("chr1", "chr1:5", "chr1:a-b", "", 5, None):
        with pytest.raises(TypeError):
            R.parse_region(bad)
    got = spark.createDataFrame([("x:1,000-2000",), ("bad",), (None,)], "t string").select(R.parse_region_column(F.col("t")).alias("r")).select("r.*").collect()
    assert tuple(got[0]) == ("x", 1000, 2000, "x_1000_2000") and tuple(got[1]) == (None,) * 4 == tuple(got[2])


def test_small_functions(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (0.2,), (None,)], "p double")
    assert df.select(fr.any_modified(F.col("p")).alias("x")).first()["x"] == pytest.approx(1 - 0.5 / 255)
    assert df.where("p < 0.3").select(fr.any_modified(F.col("p")).alias("x")).first()["x"] == 0
    one = spark.range(1)
    assert one.select(fr.reverse_complement(F.lit("ACGTN")).alias("x")).first()["x"] == "NACGT"
    assert [one.select(fr.mod_family(F.lit(m)).alias("x")).first()["x"] for m in ("A+Y", "C+h", "G+x")] == ["A", "C", None]


def test_pileups_merge_and_stream(spark, tmp_path):
    from calypile.streaming import pileup as S

    rows = [("s", "c", i % 7, 100 + i % 60, "A+a") for i in range(300)] + [("s", "c", 1, None, "A+a")]
    df = spark.createDataFrame(rows, "sample string, chr string, pos bigint, prob int, mod string")
    want = sorted(map(tuple, C.pileup(df, S.KEYS).collect()))
    merged = C.merge_pileups(*(C.pileup(df.where(F.col("pos") % 2 == k), S.KEYS) for k in (0, 1)), keys=S.KEYS)
    assert sorted(map(tuple, merged.collect())) == want
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    source = lambda: S.stream_calls(spark, str(tmp_path / "in"), df.schema)
    S.upsert_batches(source(), str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, S.stored_pileup(spark, str(tmp_path / "out")).collect())) == want
    regions = spark.createDataFrame([("b", 0, "c", 1, 5, "+")], "bed_id string, region_idx bigint, chr string, begin_pos bigint, end_pos bigint, strand string")
    q = S.streaming_pileup(source(), regions).writeStream.outputMode("complete").format("memory").queryName("piled").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("piled").collect())) == [r for r in want if 1 < r[2] < 5]
