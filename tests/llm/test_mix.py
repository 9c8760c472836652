import numpy as np
import pytest

from kmerloom.llm.mix import Mix, permuted, plan


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutations(n):
    assert sorted(permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert n < 10 or (permuted(np.arange(n), n, 5) != permuted(np.arange(n), n, 6)).any()


def test_plan_meets_targets_or_gives_what_repeats_allow():
    shares = {s.source: s for s in plan([("a", 0.5, 1, 100_000), ("b", 0.3, 2, 5_000), ("c", 0.2, 4, 0)], 100)}
    assert shares["c"].slots == 0 and shares["b"].slots <= 100
    total = shares["a"].slots + shares["b"].slots
    assert abs(shares["a"].slots / total - 0.625) < 0.02
    forced = {s.source: s.slots for s in plan([("a", 0.5, 1, 100_000), ("b", 0.5, 2, 5_000)], 100, 80_000)}
    assert forced == {"a": 700, "b": 100}
    assert plan([], 100) == [] and plan([("a", 1.0, 0, 10)], 100)[0].slots == 0


def rows():
    rng = np.random.default_rng(4)
    out = [(i, ["big", "mid", "small", "other", None][int(rng.choice(5, p=[0.6, 0.25, 0.05, 0.05, 0.05]))], int(rng.integers(0, 300)), "clash") for i in range(800)]
    return out + [(None, "big", 50, ""), (900, "big", 20_000, ""), (901, "big", None, "")]


def test_mix_shares_and_repeats(spark):
    sizes = spark.createDataFrame(rows(), "doc bigint, source string, n_tokens bigint, block string")
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.4, 2), ("small", 0.2, 5), ("none", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mix = Mix(sizes, targets, block=64)
    used = mix.uses().collect()
    total = sum(r.tokens_used for r in used)
    for name, share in (("big", 1 / 3), ("mid", 4 / 9), ("small", 2 / 9)):
        assert abs(sum(r.tokens_used for r in used if r.source == name) / total - share) < 0.01
    repeats = {"big": 1, "mid": 2, "small": 5}
    assert all(1 <= r.n_uses <= repeats[r.source] and r.tokens_used <= r.n_tokens * r.n_uses for r in used)
    slots = mix.slots().collect()
    assert sorted(r.slot for r in slots) == list(range(len(slots)))
    for s in mix.shares:
        times = np.bincount([r.block for r in slots if r.source == s.source], minlength=max(1, s.blocks))
        assert times.max() - times.min() <= 1 or s.slots == 0


def test_empty_tables(spark):
    sizes = spark.createDataFrame([], "doc bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert Mix(sizes, targets).uses().count() == 0
    some = spark.createDataFrame([(1, "a", 100)], sizes.schema)
    assert Mix(some, targets.limit(0)).uses().count() == 0


def test_blocks_give_back_the_documents(spark):
    rng = np.random.default_rng(6)
    texts = {i: rng.integers(0, 1000, int(n)).tolist() for i, n in enumerate([5, 700, 1, 64, 63, 0, 128, 40, 300])}
    source = {i: "ab"[i % 2] for i in texts}
    sizes = spark.createDataFrame([(i, source[i], len(t)) for i, t in texts.items()], "doc bigint, source string, n_tokens bigint")
    ids = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc bigint, ids array<int>, source string")
    mix = Mix(sizes, spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3)], "source string, target_share double, max_repeats int"), block=64)
    got = mix.blocks(ids).collect()
    assert sorted(r.slot for r in got) == list(range(sum(s.slots for s in mix.shares)))
    start = {r.doc: r.start for r in mix.docs.collect()}
    for name in "ab":
        whole = sum((texts[i] for i in sorted((i for i in start if source[i] == name), key=start.get)), [])
        for r in got:
            assert r.source != name or r.tokens == whole[64 * r.block : 64 * (r.block + 1)]
