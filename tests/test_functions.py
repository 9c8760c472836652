from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.functions import align, dna

DNA = st.text("ACGT", max_size=40)


def value(spark, column, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return row.select(column.alias("x")).first()["x"]


def test_hand_sized_cases(spark):
    assert value(spark, dna.reverse_complement("s"), s="ACGTT") == "AACGT"
    assert value(spark, dna.reverse_complement("s"), s="AC-gN") == "NC-GT"
    assert value(spark, dna.is_palindrome("s"), s="ACGT") and not value(spark, dna.is_palindrome("s"), s="AAAA")
    assert value(spark, dna.is_low_complexity("s"), s="AAAAAAAC") and not value(spark, dna.is_low_complexity("s"), s="AAAC")
    assert value(spark, dna.hamming("a", "b"), a="ACGT", b="AGGA") == 2 and value(spark, dna.hamming("a", "b"), a="A", b="AC") == -1
    assert sorted(value(spark, dna.deletions("s"), s="AAC")) == ["AA", "AC"]
    assert sorted(value(spark, dna.insertions("s"), s="AC")) == sorted({b + "AC" for b in "ACGT"} | {"A" + b + "C" for b in "ACGT"})
    assert value(spark, dna.kmer_array("s", 3), s="ACGT") == ["ACG", "CGT"] and value(spark, dna.kmer_array("s", 5), s="ACGT") == []
    assert value(spark, dna.path_string("p"), p=["ACG", "CGT", "GTT"]) == "ACGTT"
    assert value(spark, dna.alignment_accuracy("m", "n"), m=0, n=0) == 0.0
    assert value(spark, dna.read_id("h"), h=">r/1 note") == "r/1" and value(spark, dna.without_last_field("h"), h="a/b/c") == "a/b"
    f = value(spark, dna.simulated_fields("h"), h="read_2b/genome_5_90/mat7_mis1_ins2_del3/0_80")
    assert (f.number, f.half, f.beg, f["end"], f.mat, f["del"], f.len) == (2, "b", 5, 90, 7, 3, 80)
    assert dna.every_kmer(spark, 3).distinct().count() == 64
    for fn in (dna.reverse_complement, dna.is_palindrome, dna.deletions):
        assert spark.sql("select cast(null as string) s").select(fn("s").alias("x")).first()["x"] is None


def one_indel(k):
    less = {k[:i] + k[i + 1 :] for i in range(len(k))}
    more = {k[:i] + b + k[i:] for i in range(len(k) + 1) for b in "ACGT"}
    less = {x for x in less if x not in (k[:-1], k[1:])}
    more = {x for x in more if k not in (x[:-1], x[1:])}
    ins = {x[:i] + b + x[i:] for x in less for i in range(len(x) + 1) for b in "ACGT"}
    return sorted((ins | {x[:i] + x[i + 1 :] for x in more for i in range(len(x))}) - {k})


@pytest.mark.parametrize("kmer", ["ACGTA", "AAAAC", "GGTTA"])
def test_indel_neighbours(spark, kmer):
    assert value(spark, dna.indel_neighbours("s"), s=kmer) == one_indel(kmer)


def is_subsequence(x, y):
    it = iter(y)
    return all(c in it for c in x)


@settings(max_examples=100, deadline=None)
@given(DNA, DNA)
def test_sequence_laws(a, b):
    lcs, scs = align.common_subsequence(a, b), align.common_supersequence(a, b)
    assert is_subsequence(lcs, a) and is_subsequence(lcs, b) and is_subsequence(a, scs) and is_subsequence(b, scs)
    assert len(scs) == len(a) + len(b) - len(lcs)
    sub = align.common_substring(a, b)
    assert sub in a and sub in b
    every = {a[i:j] for i, j in combinations(range(len(a) + 1), 2)}
    assert len(sub) == max((len(x) for x in every if x in b), default=0)
    x, y = align.gapped_rows(a, b)
    assert x.replace("-", "") == a and y.replace("-", "") == b and all(p == q or "-" in (p, q) for p, q in zip(x, y))


def slow_affine(a, b, fitting):
    low = -1e18
    s = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    d = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    r = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        d[i][0] = -1 - 0.5 * i
        if fitting:
            s[i][0] = d[i][0]
    for j in range(1, len(b) + 1):
        r[0][j] = -1 - 0.5 * j
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = max(d[i - 1][j] - 0.5, s[i - 1][j] - 1.5)
            r[i][j] = max(r[i][j - 1] - 0.5, s[i][j - 1] - 1.5)
            s[i][j] = max(s[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), d[i][j], r[i][j], *([] if fitting else [0]))
    return max(0.0, *(s[len(a)][1:] if fitting else [x for row in s for x in row]), 0.0)


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=15), st.text("ACGT", min_size=1, max_size=15))
def test_affine_scores(a, b):
    for fitting in (False, True):
        score, n, same, other, gaps, extends, e1, e2 = align.affine(a, b, fitting=fitting)
        assert score == slow_affine(a, b, fitting) and n == same + other + gaps and extends <= gaps
        assert n == 0 or not fitting or (e1 == len(a) and n >= len(a))


def test_alignment_columns(spark):
    rows = spark.createDataFrame([("ACGTACGT", "TTACGTACGTTT"), ("", "A"), (None, None)], "a string, b string")
    out = rows.select(align.alignment()("a", "b").alias("x"), align.linear_score("a", "b").alias("s")).select("x.*", "s").collect()
    assert (out[0].matches, out[0].end2, out[0].score) == (8, 10, 8.0) and out[1].align_len == out[2].align_len == 0 and out[1].s == 0


def test_consensus_restores_a_noisy_sequence():
    import numpy as np

    rng = np.random.default_rng(7)
    truth = "".join(rng.choice(list("ACGT"), 100))
    noisy = ["".join("" if rng.random() < 0.02 else c + (rng.choice(list("ACGT")) if rng.random() < 0.02 else "") for c in truth) for _ in range(12)]
    out = align.progressive_consensus(noisy)
    assert len(align.common_subsequence(out, truth)) >= 95 and align.progressive_consensus([]) == ""
    reads = [("".join(rng.choice(list("ACGT"), 40)))] * 3
    assert align.consensus_tree(reads) == (None, 0, False)
    same = ["".join(rng.choice(list("ACGT"), 500))] * 6
    assert align.consensus_tree(same) == (same[0], 6, True)


def slow_common_rows(a, b):
    t = [[0] * (len(b) + 1)]
    for i, x in enumerate(a):
        t.append([0])
        for j, y in enumerate(b):
            t[-1].append(max(t[i][j] + (x == y), t[i][j + 1], t[-1][j]))
    return t


@settings(max_examples=60, deadline=None)
@given(DNA, DNA)
def test_rows_of_bits(a, b):
    t, rows = slow_common_rows(a, b), align.lcs_table(align._bytes(a), align._bytes(b))
    for i in range(len(a) + 1)[::-1]:
        row = rows.one(i)
        assert isinstance(row, int) and [int(not row >> j & 1) for j in range(len(b))] == [y - x for x, y in zip(t[i], t[i][1:])]
    assert align.common_length(a, b) == t[-1][-1]


def relatives(seed, n):
    r = np.random.default_rng(seed)
    own = "".join(r.choice(list("ACGT"), 300))

    def part():
        x = r.integers(250)
        return "".join("" if r.random() < 0.05 else c + ("T" if r.random() < 0.05 else "") for c in own[x : x + r.integers(1, 120)])

    return [(part(), part()) for _ in range(n)] + [("", "A"), (None, "ACGT"), ("A", "T"), ("ACGTN-", "ACGTN-")]


@pytest.mark.parametrize("fitting", [False, True])
def test_pairs_side_by_side_are_as_alone(fitting, monkeypatch):
    pairs = relatives(7, 60)
    want = [align.affine(a, b, fitting=fitting) for a, b in pairs]
    assert align.affine_all(*zip(*pairs), fitting) == want
    monkeypatch.setattr(align, "SIDE_TABLE", 10_000)  # the larger ones alone
    assert align.affine_all(*zip(*pairs), fitting) == want
    many = [("".join(map(chr, range(60, 100))), "".join(map(chr, range(65, 99))))]  # too many letters
    assert align.affine_all(*zip(*many), fitting) == [align.affine(*many[0], fitting=fitting)]


def test_anchored_scores_side_by_side_are_as_alone():
    pairs = relatives(8, 60)
    assert align.anchored_all(*zip(*pairs)) == [align.anchored_score(a, b) for a, b in pairs]


def test_stretches_that_come_often():
    for a, b in (("A" * 300, "A" * 200), ("ACGTTGCA" * 9, "TTTT" + "ACGTTGCA" * 7), ("GATTACAGATTACA" + "CCCC", "CCCCGATTACAGATTACC")):
        every = [a[i:j] for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b] if len(a) < 100 else [a[:200]]
        assert align.common_substring(a, b) == max(every, key=len)


@pytest.mark.parametrize("kept", [1 << 25, 0])
def test_aligned_places_are_those_of_the_rows(monkeypatch, kept):
    from kmerloom.operators.assembly import region_walk

    monkeypatch.setattr(align, "WHOLE", kept)
    rng = np.random.default_rng(8)
    for n in range(300):
        letters = list(("A", "AC", "ACGT", "ACGTN")[n % 4])
        a, b = ("".join(rng.choice(letters, rng.integers(1, 90))) for _ in range(2))
        if n % 3 == 0:
            b = a[5:40] + b + a[60:]
        t_row, q_row = align.gapped_rows(a, b)
        assert (t_row.replace("-", ""), q_row.replace("-", "")) == (a, b)
        for beg, end in ((10, 30), (0, 200), (30, 10), (5, 5)):
            assert align.aligned_places(a, b, beg, end) == region_walk(0, len(b), 0, q_row, t_row, False, beg, end)


def noisy(rng, s, rate):
    out = []
    for c, x in zip(s, rng.random(len(s))):
        out += [] if x < rate / 3 else ["ACGTN"[rng.integers(5)]] if x < rate * 2 / 3 else [c] + list("ACGT"[: rng.integers(1, 4)]) if x < rate else [c]
    return "".join(out)


def overlapping(seed, n):
    """Pairs that overlap at an end, lie in each other, hold repeats or an insertion, or have nothing in common."""
    rng = np.random.default_rng(seed)
    dna = lambda n: "".join(rng.choice(list("ACGT"), n))
    for k in range(n):
        g = dna(rng.integers(200, 800))
        g = (g, g[:70] * 6, g + g[:90] + g)[k % 7 % 3 if k % 7 < 3 else 0]
        x, y = sorted(rng.integers(0, len(g), 2))
        a, b = noisy(rng, g[: y + 60], 0.15 * (k % 3)), noisy(rng, g[x // 2 :], 0.1)
        b = b[:150] + dna(90) + b[150:] if k % 5 == 0 else dna(300) if k % 11 == 0 else b
        yield ((dna(100) + a) if k % 4 == 0 else a, b)[:: 1 if k % 2 else -1]


@pytest.mark.parametrize("places, looks", [(30_000, 32), (700, 32), (30_000, 16)])
def test_alignments_within_bounds_are_those_of_the_whole_table(monkeypatch, places, looks):
    pairs = list(overlapping(places + looks, 66))
    monkeypatch.setattr(align, "NARROW", places)
    monkeypatch.setattr(align, "LOOK", looks)
    want = [align.affine(*p) for p in pairs]
    made = align._local_all([tuple(x.encode() for x in p) for p in pairs])
    assert len(made) > 20 and all(want[i] == x for i, x in made.items())
    assert align.affine_all(*zip(*pairs)) == want


def test_overlaps_need_no_whole_table(monkeypatch):
    rng = np.random.default_rng(3)
    g = "".join(rng.choice(list("ACGT"), 1500))
    pairs = [(noisy(rng, g[:1100], 0.06), noisy(rng, g[100 * k :], 0.06)) for k in range(6)]
    want = [align.affine(*p) for p in pairs]
    monkeypatch.setattr(align, "_affine_together", None)
    monkeypatch.setattr(align, "affine", None)
    assert align.affine_all(*zip(*pairs)) == want
