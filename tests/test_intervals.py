import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from calypile.operators import intervals as I

SCHEMA = "sample string, chr string, start bigint, end bigint, tile string, lo int"


def covered(rows):
    out = {}
    for s, c, a, b, *_ in rows:
        if a is not None and b is not None and a < b:
            out.setdefault((s, c), set()).update(range(a, b))
    return out


def brute_periods(rows):
    out = []
    for key, positions in covered(rows).items():
        at = sorted(positions)
        start = prev = at[0]
        for p in at[1:]:
            if p != prev + 1:
                out.append((*key, start, prev + 1))
                start = p
            prev = p
        out.append((*key, start, prev + 1))
    return sorted(out, key=repr)


def brute_gaps(rows):
    per = {}
    for s, c, a, b in brute_periods(rows):
        per.setdefault((s, c), []).append((a, b))
    return sorted(((*k, x[1], y[0]) for k, v in per.items() for v in [sorted(v)] for x, y in zip(v, v[1:])), key=repr)


@given(st.lists(st.tuples(st.integers(0, 127), st.integers(1, 60)), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_union_of_dyadic_blocks_is_the_union(pairs):
    lo = np.array([a for a, _ in pairs])
    hi = np.minimum(lo + np.array([n for _, n in pairs]), 128)
    starts, ends = I.union_runs(lo, hi, 7)
    want = set().union(*(range(a, b) for a, b in zip(lo, hi)))
    assert set().union(set(), *(range(a, b) for a, b in zip(starts, ends))) == want
    assert (starts[1:] > ends[:-1]).all()


@given(st.lists(st.tuples(st.integers(0, 200), st.integers(1, 50)), max_size=25))
@settings(max_examples=100, deadline=None)
def test_blocks_are_canonical(pairs):
    lo, hi = np.array([a for a, _ in pairs], int), np.array([a + n for a, n in pairs], int)
    levels = I.merge_siblings(I.without_descendants(I.dyadic_blocks(lo, hi, 8)))
    spans = [(int(i) << l, (int(i) + 1) << l) for l, own in enumerate(levels) for i in own]
    assert sum(b - a for a, b in spans) == len(set().union(set(), *(range(a, b) for a, b in zip(lo, hi))))  # disjoint
    for l, own in enumerate(levels[:-1]):
        assert not set(own[own % 2 == 0] + 1) & set(own)  # no pair of siblings is left


@pytest.mark.parametrize("bits", [3, 5, 20])
def test_gaps_and_periods_equal_brute_force(spark, bits):
    rng = np.random.default_rng(bits)
    rows = []
    for i in range(600):
        a = int(rng.integers(0, 3000))
        rows.append((f"s{i % 2}" if i % 50 else None, f"c{min(int(rng.geometric(0.5)), 4)}", a, a + int(rng.integers(-3, 25)), "t", 1))
    rows += [("s0", "c1", None, 5, "t", 1), ("s0", "c1", 5, None, "t", 1), ("s0", "c9", 7, 7, "t", 1), ("s1", "c8", 0, 4000, None, None)] + rows[:40]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, I.gaps(df, ["sample", "chr"], "start", "end", bits=bits).collect()), key=repr)
    assert got == brute_gaps(rows)
    got = sorted(map(tuple, I.periods(df, ["sample", "chr"], "start", "end", bits=bits).collect()), key=repr)
    assert got == brute_periods(rows)


def test_empty_touching_and_nested(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert I.gaps(empty, ["sample", "chr"], "start", "end").count() == 0
    assert I.periods(empty, ["sample", "chr"], "start", "end").count() == 0
    edge = 1 << I.TILE_BITS
    rows = [("s", "c", edge - 5, edge, "x", 0), ("s", "c", edge, edge + 5, "x", 0), ("s", "c", 3, 2 * edge + 1, "x", 0), ("s", "c", 2 * edge + 4, 2 * edge + 6, "x", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in I.gaps(df, ["sample", "chr"], "start", "end").collect()] == [("s", "c", 2 * edge + 1, 2 * edge + 4)]
    assert sorted(tuple(r)[2:] for r in I.periods(df, ["sample", "chr"], "start", "end").collect()) == [(3, 2 * edge + 1), (2 * edge + 4, 2 * edge + 6)]


def test_many_rows_of_one_key_are_reduced_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(I, "CHUNK_ROWS", 1000)
    df = spark.range(60_000).selectExpr("'s' sample", "'c' chr", "id % 500 * 10 start", "id % 500 * 10 + 9 `end`", "'' tile", "1 lo")
    assert I.gaps(df, ["sample", "chr"], "start", "end").count() == 499
