from collections import Counter

import numpy as np
import pytest

from kmerloom.llm.words import containers, packed_container, unpacked_container, word_counts


def brute(seqs, k):
    occ, rec = Counter(), Counter()
    for s in seqs:
        s = (s or "").upper()
        ws = [s[i : i + k] for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")]
        occ.update(ws)
        rec.update(set(ws))
    return {w: (occ[w], rec[w]) for w in occ}


def sequences(n=60):
    rng = np.random.default_rng(3)
    own = ["".join(rng.choice(list("ACGTacgN"), p=[0.2, 0.2, 0.2, 0.2, 0.06, 0.06, 0.06, 0.02], size=int(rng.integers(0, 200)))) for _ in range(n)]
    return own + [None, "", "ACG", "A" * 500, "A" * 500, own[0], "ACGT" * 3000]


@pytest.mark.parametrize("k", [5, 18, 27, 31])
def test_word_counts_against_brute_force(spark, k):
    seqs = sequences()
    df = spark.createDataFrame([(s, "x") for s in seqs], "seq string, word string").repartition(3)
    got = {r.word: (r.n_occurrences, r.n_records) for r in word_counts(df, "seq", k, held=3000, capacity=40).collect()}
    assert got == brute(seqs, k)


def test_listed_words(spark):
    seqs = sequences()
    want = brute(seqs, 6)
    asked = sorted(want)[::7] + ["GGGGGG", "CCCCCA"]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(2)
    words = spark.createDataFrame([(w,) for w in asked], "kmer string")
    got = {r.word: (r.n_occurrences, r.n_records) for r in word_counts(df, "seq", 6, words, held=2000, capacity=30).collect()}
    assert got == {w: want.get(w, (0, 0)) for w in asked}
    assert word_counts(df.limit(0), "seq", 6).count() == 0
    assert {r.n_records for r in word_counts(df.limit(0), "seq", 6, words).collect()} == {0}
    assert word_counts(df, "seq", 6, words.limit(0)).count() == 0


def test_a_trie_bursts_and_packs_without_loss():
    words = np.unique(np.r_[np.arange(1000), np.random.default_rng(1).integers(0, 4**12, 3000)]).astype(np.uint64)
    occ, rec = np.arange(len(words)) % 5 + 1, np.arange(len(words)) % 2 + 1
    seen = []
    for route, first, after, lo, hi in containers(words, 12, 2, 50):
        assert hi - lo <= 50 and first <= words[lo] and words[hi - 1] < after and route == first >> 20
        w, at, o, r = unpacked_container(packed_container(words[lo:hi], first, occ[lo:hi], rec[lo:hi]), first)
        assert (w == words[lo:hi]).all()
        full = np.ones(hi - lo, int)
        full[at] = o
        assert (full == occ[lo:hi]).all()
        seen.append((lo, hi))
    assert seen[0][0] == 0 and seen[-1][1] == len(words) and all(a[1] == b[0] for a, b in zip(seen, seen[1:]))
