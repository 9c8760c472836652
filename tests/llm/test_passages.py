"""Passages are whole: matches of any length, seeds of any number of places."""

import numpy as np

from kmerloom.llm.spans import merged, shared_spans


def dna(rng, n):
    return "".join(rng.choice(list("ACGT"), n))


def test_matches_of_a_diagonal_are_merged():
    rows = [(1, 2, 0, 5, 10), (1, 2, 8, 13, 10), (1, 2, 18, 23, 4), (1, 2, 23, 28, 3), (1, 2, 2, 3, 5), (1, 3, 0, 5, 10), (1, 2, 1, 6, 2)]
    got = list(zip(*(x.tolist() for x in merged(*np.array(rows).T))))
    assert got == [(1, 2, 0, 5, 22), (1, 2, 2, 3, 5), (1, 2, 23, 28, 3), (1, 3, 0, 5, 10)]
    assert all(len(x) == 0 for x in merged(*np.zeros((5, 0), np.int64)))


def test_long_matches_are_one(spark):
    rng = np.random.default_rng(1)
    s, t = dna(rng, 600), dna(rng, 300)
    rows = [(1, "A" + s + "A" + t), (2, "CC" + s + "C" + t)]
    r = shared_spans(spark.createDataFrame(rows, "k bigint, seq string"), "k", "seq", 100).passages().collect()
    assert [(x.n_matches, x.longest_match, x.a_beg, x.b_beg, x.n_equal, x.n_edits) for x in r] == [(2, 600, 1, 2, 900, 1)]


def test_passages_of_a_hot_stretch(spark, monkeypatch):
    from kmerloom.llm import spans

    monkeypatch.setattr(spans, "PART", 7)
    rng = np.random.default_rng(2)
    hot = dna(rng, 130)
    rows = [(i, dna(rng, i % 5) + "ACGT"[i % 4] + hot + dna(rng, 60)) for i in range(40)] + [(50, hot.lower() + "N"), (51, hot + "n")]
    own = shared_spans(spark.createDataFrame(rows, "k bigint, seq string"), "k", "seq", 100)
    got = [(r.read_a, r.read_b, r.longest_match) for r in own.passages().collect()]
    assert len(got) == 41 * 40 // 2 and len({x[:2] for x in got}) == len(got) and min(x[2] for x in got) >= 130
    assert sorted(map(tuple, own.copies.collect())) == [(50, 50), (51, 50)]


def test_one_stretch_is_one_passage(spark):
    rng = np.random.default_rng(3)
    s = dna(rng, 1000)
    rows = [(1, dna(rng, 50) + s + dna(rng, 40)), (2, dna(rng, 50) + s + dna(rng, 70))]
    (r,) = shared_spans(spark.createDataFrame(rows, "k bigint, seq string"), "k", "seq", 100).passages().collect()
    assert r.n_matches == 1 and r.longest_match >= 1000 and r.n_edits == 0 and abs(r.score - r.longest_match) < 1e-9
