from collections import Counter
from itertools import combinations
from math import log

import numpy as np

from kmerloom.llm import together
from kmerloom.llm.together import pairs_together


def brute(baskets, least, lift):
    sets = [{x for x in b if x is not None} for b in baskets if b]
    sets = [s for s in sets if s]
    n, one, two = len(sets), Counter(), Counter()
    for s in sets:
        one.update(s)
        two.update(combinations(sorted(s), 2))
    return {(a, b): (one[a], one[b], c, n) for (a, b), c in two.items() if c >= least and c * n >= lift * one[a] * one[b]}


def data(n=300):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        g = int(rng.integers(12))
        rows.append((i, [f"g{g}_{x}" for x in rng.integers(0, 6, int(rng.integers(0, 6)))] + (["hot"] if rng.random() < 0.4 else []) + [None] * int(rng.random() < 0.2), "clash"))
    return rows + [(n, None, ""), (n + 1, [], ""), (n + 2, [None], ""), (n + 3, ["solo"], ""), (n + 4, ["hot", "hot"], "")]


def check(spark, rows, least, lift):
    df = spark.createDataFrame(rows, "k bigint, items array<string>, item string").repartition(3)
    got = {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab, r.n_baskets) for r in pairs_together(df, "k", "items", least, lift).collect()}
    assert got == brute([r[1] for r in rows], least, lift)
    return got


def test_pairs_against_brute_force(spark):
    assert check(spark, data(), 3, 2)
    assert check(spark, data(), 1, 0.5)


def test_blocks_of_large_baskets(spark, monkeypatch):
    monkeypatch.setattr(together, "BLOCK", 4)
    check(spark, data(120), 1, 0.01)


def test_empty_and_likelihood(spark):
    df = spark.createDataFrame([], "k bigint, items array<string>")
    assert pairs_together(df, "k", "items", 1, 1).count() == 0
    rows = [(i, ["a", "b"]) for i in range(10)] + [(10 + i, ["c"]) for i in range(30)]
    r = pairs_together(spark.createDataFrame(rows, "k bigint, items array<string>"), "k", "items", 2, 1).first()
    assert abs(r.llr - 2 * (10 * log(10 * 40 / 100) + 30 * log(30 * 40 / 900))) < 1e-6 and r.lift == 4.0


def test_significance_is_a_bound(spark):
    df = spark.createDataFrame([(i, ["a", "b"]) for i in range(10)] + [(10 + i, ["c"] if i % 2 else ["c", "d"]) for i in range(30)], "k bigint, items array<string>")
    every = {(r.item_a, r.item_b): r.llr for r in pairs_together(df, "k", "items", 1, 1).collect()}
    some = {(r.item_a, r.item_b) for r in pairs_together(df, "k", "items", 1, 1, 20.0).collect()}
    assert len(every) == 2 and some == {k for k, x in every.items() if x >= 20} != set(every)


def test_many_large_baskets_are_paired_piece_by_piece():
    rng = np.random.default_rng(2)
    sizes = np.r_[rng.integers(900, 1000, 40), 0, 1, 3]
    ranges = list(together._by_pairs(np.r_[0, np.cumsum(sizes)]))
    assert [lo for lo, _ in ranges][1:] == [hi for _, hi in ranges][:-1] and ranges[-1][1] == len(sizes)
    assert all(hi - lo == 1 or sum(n * (n - 1) // 2 for n in sizes[lo:hi]) <= together.AT_ONCE for lo, hi in ranges)
