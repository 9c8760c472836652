from collections import defaultdict

import numpy as np
import pytest

from kmerloom.llm.spans import SharedSpans, chains, edits, linked, seeds_of, shared_spans
from kmerloom.llm.batches import BASE_CODES

SPAN = 20


def brute(rows, span):
    seqs = {k: s.upper() for k, s in rows if s}
    held = defaultdict(set)
    for k, s in seqs.items():
        for i in range(len(s) - span + 1):
            if set(s[i : i + span]) <= set("ACGT"):
                held[s[i : i + span]].add(k)
    out = set()
    for k, s in seqs.items():
        on = [False] * len(s)
        for i in range(len(s) - span + 1):
            if len(held.get(s[i : i + span], ())) > 1:
                on[i : i + span] = [True] * span
        i = 0
        while i < len(s):
            j = i
            while j < len(s) and on[j]:
                j += 1
            if j > i:
                out.add((k, i, j))
            i = j + 1
    return out


def data():
    rng = np.random.default_rng(9)
    dna = lambda n: "".join(rng.choice(list("ACGT"), n))
    repeat = dna(40)
    rows = []
    for i in range(40):
        parts = [dna(int(rng.integers(5, 60)))]
        for _ in range(3):
            kind = rng.random()
            if kind < 0.3 and rows:
                other = rows[int(rng.integers(len(rows)))][1]
                b = int(rng.integers(0, max(1, len(other) - 30)))
                piece = other[b : b + int(rng.integers(18, 45))]
                parts.append(piece.lower() if rng.random() < 0.3 else piece)
            elif kind < 0.5:
                parts.append(repeat[: int(rng.integers(15, 40))])
            elif kind < 0.6:
                parts.append("N" * int(rng.integers(1, 3)))
            parts.append(dna(int(rng.integers(0, 30))))
        rows.append((i, "".join(parts)))
    return rows + [(100, rows[0][1]), (101, rows[0][1]), (102, "A" * 70), (103, "a" * 90), (104, None), (105, ""), (106, "ACG"), (107, "AC" * 4000), (108, "CA" * 100)]


@pytest.mark.parametrize("joined", [1000, 3, 0])
def test_spans_against_brute_force(spark, joined):
    rows = data()
    df = spark.createDataFrame([(k, s, "clash") for k, s in rows], "k bigint, seq string, read string").repartition(3)
    got = {(r.read, r.span_beg, r.span_end) for r in SharedSpans(df, "k", "seq", SPAN, 11, joined).spans().collect()}
    assert got == brute(rows, SPAN)


def test_repeated_rows_and_empty_tables(spark):
    rows = data()[:10]
    df = spark.createDataFrame(rows + rows[:4], "k bigint, seq string")
    own = shared_spans(df, "k", "seq", 100)
    assert own.spans().count() == 0 and own.passages().count() == 0
    assert shared_spans(df.limit(0), "k", "seq", 100).spans().count() == 0


def test_equal_stretches_have_equal_seeds():
    rng = np.random.default_rng(1)
    a = "".join(rng.choice(list("ACGT"), 300))
    b = "".join(rng.choice(list("ACGT"), 77)) + a[120:220] + "N" + a[:50]
    sa, sb = (seeds_of(BASE_CODES[np.frombuffer(x.encode(), np.uint8)], 100, 50) for x in (a, b))
    in_a = {(int(p) - 120, int(h)) for p, h in zip(*sa) if 120 <= p <= 170}
    in_b = {(int(p) - 77, int(h)) for p, h in zip(*sb) if 77 <= p <= 127}
    assert in_a & in_b


def test_chains_keep_the_order_and_every_match():
    chain, scores = chains([0, 10, 20, 30], [0, 10, 500, 30], [15, 15, 15, 15], 0.05)
    assert chain[0] == chain[1] == chain[3] != chain[2] and min(chain) >= 0
    assert sorted(scores) == [15.0, 39.5]  # 40 bases are matched, overlaps once, and 10 lie between matches


def best_chain(a, b, size, cost, over):
    score = []
    for i in range(len(a)):
        top = 0.0
        for j in range(len(a)):
            gaps = (a[i] - a[j] - size[j], b[i] - b[j] - size[j])
            if min(gaps) >= -over and a[j] < a[i]:
                top = max(top, score[j] - cost * sum(max(0, g) for g in gaps) - max(0, -min(gaps)))
        score.append(size[i] + top)
    return max(score)


def test_chains_against_all_predecessors():
    rng = np.random.default_rng(6)
    for _ in range(80):
        n = int(rng.integers(1, 12))
        rows = sorted({(int(rng.integers(0, 300)), int(rng.integers(0, 300))) for _ in range(n)})
        a, b = (list(x) for x in zip(*rows))
        size = rng.integers(20, 60, len(a)).tolist()
        chain, scores = chains(a, b, size, 0.05)
        assert min(chain) >= 0 and all(scores[c] >= s for c, s in zip(chain, size))
        assert max(scores) <= best_chain(a, b, size, 0.05, min(25, min(size) // 2)) + 1e-9
        small = [1] * len(a)  # no overlaps are possible: the tree's choice is the best one
        assert abs(max(chains(a, b, small, 0.001)[1]) - best_chain(a, b, small, 0.001, 0)) < 1e-9


def test_overlaps_count_once():
    chain, scores = chains([0, 90], [0, 95], [100, 100], 0.05)
    assert chain == [0, 0] and abs(scores[0] - 190) < 1e-9
    chain, scores = chains([0, 30], [0, 40], [100, 100], 0.05)
    assert len(scores) == 2 and scores == [100, 100]


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y or x == "N")))
        row = now
    return row[-1]


def test_edits_against_a_plain_table():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("ACGTN"), int(rng.integers(0, 15)))) for _ in range(2))
        assert edits(*(BASE_CODES[np.frombuffer(x.encode(), np.uint8)] for x in (a, b))) == plain_edits(a, b)
    for n, m in ((200, 90), (150, 150), (0, 70), (130, 260)):
        a, b = ("".join(rng.choice(list("ACGTN"), x)) for x in (n, m))
        assert edits(*(BASE_CODES[np.frombuffer(x.encode(), np.uint8)] for x in (a, b))) == plain_edits(a, b)


def test_links_cut_overlaps_and_leave_gaps():
    got = linked([0, 5, 40, 41], [0, 8, 50, 30], [20, 20, 10, 5], [0, 0, 0, 1])
    assert got == [(20, 0, 0, 0, 0), (5, 20, 20, 20, 23), (10, 25, 40, 28, 50), (5, 41, 41, 30, 30)]
    assert linked([0, 3], [0, 3], [20, 10], [0, 0])[1][0] == 0


def test_passages_are_aligned(spark):
    rng = np.random.default_rng(5)
    a, b, c = ("".join(rng.choice(list("ACGT"), 150)) for _ in range(3))
    other = "ACGT"["ACGT".index(b[70]) - 1]
    rows = [(1, a + b + c), (2, "GATTACA" + a + b[:70] + other + b[71:] + c), (3, a + c), (4, "T" * 120 + a + "GG" + b)]
    df = spark.createDataFrame(rows, "k bigint, seq string")
    got = {(r.read_a, r.read_b): r for r in shared_spans(df, "k", "seq", 100).passages().collect()}
    assert len(got) == 6
    assert got[1, 2].n_edits == 1 and got[1, 2].n_equal == 449 and got[1, 2].identity == round(449 / 450, 6)
    assert got[1, 3].n_edits == 150 and got[1, 3].n_equal == 300
    assert got[1, 4].n_edits == 2 and got[1, 4].n_equal == 300
    assert (got[1, 2].a_beg, got[1, 2].a_end, got[1, 2].b_beg, got[1, 2].b_end) == (0, 450, 7, 457)
