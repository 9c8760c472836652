import numpy as np
import pytest

from kmerloom.operators.intervals import accurate_enough, coverage_segments, interval_clusters, periods_and_gaps


def brute(rows):
    out = {}
    for e, b, f in rows:
        if None in (e, b, f) or b == f:
            continue
        out.setdefault(e, []).append((min(b, f), max(b, f)))
    found = set()
    for e, own in out.items():
        merged = []
        for b, f in sorted(own):
            if merged and b <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], f)
            else:
                merged.append([b, f])
        found |= {(e, "period", b, f) for b, f in merged} | {(e, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return found


def data():
    rng = np.random.default_rng(6)
    rows = [(["a", "a", "b", "c", None][int(rng.integers(5))], int(x), int(x + rng.integers(-30, 31))) for x in rng.integers(-100, 3000, 300)]
    return rows + rows[:20] + [("d", None, 4), ("d", 5, 5), ("e", 0, 4), ("e", 4, 8), ("e", 100_000, 7_000_000)]


@pytest.mark.parametrize("block", [1 << 16, 7, 1])
def test_periods_and_gaps(spark, block):
    rows = data() if block > 1 else [r for r in data() if r[2] != 7_000_000]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "h string, b int, f int, entity string, pos int").repartition(3)
    got = [tuple(r) for r in periods_and_gaps(df, "h", "b", "f", block=block).select("entity", "kind", "beg", "end").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_depths(spark):
    df = spark.createDataFrame([("x", 0, 4), ("x", 2, 6), ("x", 8, 9)], "h string, b int, f int")
    assert sorted(tuple(r) for r in coverage_segments(df, "h", "b", "f").select("beg", "end", "depth").collect()) == [(0, 2, 1), (2, 4, 2), (4, 6, 1), (6, 8, 0), (8, 9, 1)]
    two = periods_and_gaps(df, "h", "b", "f", min_depth=2).collect()
    assert [(r.kind, r.beg, r["end"]) for r in two] == [("period", 2, 4)]
    assert {(r.beg, r["end"], r.n) for r in interval_clusters(df, "h", "b", "f").collect()} == {(0, 6, 2), (8, 9, 1)}
    none = df.limit(0)
    assert periods_and_gaps(none, "h", "b", "f").count() == coverage_segments(none, "h", "b", "f").count() == 0


def test_accuracies(spark):
    df = spark.createDataFrame([(80.0,), (80.1,), (0.8,), (0.81,), (1.0,), (float("nan"),), (None,)], "a double")
    assert [r.x for r in df.select(accurate_enough("a", 80).alias("x")).collect()] == [False, True, False, True, True, False, False]
