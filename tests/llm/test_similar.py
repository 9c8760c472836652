from itertools import combinations

import numpy as np
import pytest

from kmerloom.llm import similar
from kmerloom.llm.similar import all_pairs, similar_sets


def brute(rows, t, least):
    sets = {k: {x for x in m if x is not None} for k, m, *_ in rows if m}
    sets = {k: s for k, s in sets.items() if len(s) >= least}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def data(n=150, seed=2):
    rng = np.random.default_rng(seed)
    hot = [f"h{i}" for i in range(4)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            base = list(rows[int(rng.integers(len(rows)))][1] or [])
            base = [x for x in base if rng.random() > 0.12] + [f"x{rng.integers(400)}" for _ in range(int(rng.integers(0, 3)))]
        else:
            base = [f"x{rng.integers(60)}" for _ in range(int(rng.integers(3, 20)))] + hot[: int(rng.integers(0, 5))]
        rows.append((i, base + base[:1] + [None], "clash"))
    return rows + [(n, None, ""), (n + 1, [], ""), (n + 2, rows[3][1], ""), (n + 3, rows[3][1][::-1], "")]


@pytest.mark.parametrize("common,cost,part,t,least", [(100, 4, 20_000, 0.6, 6), (2, 0, 3, 0.6, 6), (1, 0, 5, 0.6, 2), (3, 0.1, 20_000, 0.8, 5), (1, 0, 7, 0.5, 1), (1, 0, 7, 0.3, 1)])
def test_pairs_against_brute_force(spark, monkeypatch, common, cost, part, t, least):
    monkeypatch.setattr(similar, "COMMON", common)
    monkeypatch.setattr(similar, "KEY_COST", cost)
    monkeypatch.setattr(similar, "PART", part)
    rows = data()
    df = spark.createDataFrame(rows, "key bigint, m array<string>, id string").repartition(3)
    pairs, copies = similar_sets(df, "key", "m", t, least)
    got = [(r.key_a, r.key_b) for r in all_pairs(pairs, copies).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, t, least) and got


def test_copies_are_classes_not_pairs(spark):
    rows = [(i, [f"a{j}" for j in range(8)]) for i in range(200)] + [(500, [f"a{j}" for j in range(9)])]
    pairs, copies = similar_sets(spark.createDataFrame(rows, "key bigint, m array<string>"), "key", "m", 0.6, 6)
    assert [(r.id_a, r.id_b, r.common) for r in pairs.collect()] == [(0, 500, 8)]
    assert sorted((r.id, r.key, r.n_copies) for r in copies.collect()) == [(0, i, 200) for i in range(200)]
    none = spark.createDataFrame([], "key bigint, m array<string>")
    assert all_pairs(*similar_sets(none, "key", "m", 0.6, 6)).count() == 0


def test_large_sets_of_common_members(spark):
    rng = np.random.default_rng(7)
    pool = [f"c{i}" for i in range(1300)]
    rows = [(i, list(rng.choice(pool, 1000, replace=False))) for i in range(60)] + [(100, pool[:900]), (101, pool[50:950])]
    pairs, copies = similar_sets(spark.createDataFrame(rows, "key bigint, m array<string>").repartition(4), "key", "m", 0.6, 6)
    assert {(r.id_a, r.id_b) for r in pairs.collect()} == brute(rows, 0.6, 6) and copies.count() == 0


def test_every_choice_of_levels_is_made(spark):
    rows = [(float(f), float(r)) for f, r in ((50, 3), (2000, 3), (2000, 40), (90_000, 30), (90_000, 8), (900_000, 400))]
    df = spark.createDataFrame(rows, "f double, r double").select(similar._level(3, 1_000_000).alias("x"))
    assert [r.x for r in df.collect()] == [1, 3, 2, 1, 3, 1]
