"""Windows over hot entities run in blocks; near k-mers are found by pieces."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.operators import evaluate, nhood
from kmerloom.operators.evaluate import low_coverage_runs, seed_clusters, support_percentile
from kmerloom.operators.hammer import hamming_pairs
from kmerloom.operators.intervals import interval_clusters, seed_islands


def rows_of_intervals():
    rng = np.random.default_rng(8)
    rows = [(["hot", "hot", "hot", "b"][int(rng.integers(4))], int(x), int(x + rng.integers(-12, 13))) for x in rng.integers(-50, 900, 160)]
    return rows + rows[:9] + [("t", 0, 4), ("t", 4, 8), ("t", 8, 8), (None, 1, 2), ("u", None, 3), ("v", 9, 2)]


def brute_clusters(rows):
    out = {}
    for e, b, f in rows:
        if None not in (e, b, f) and b != f:
            out.setdefault(e, []).append((min(b, f), max(b, f)))
    found = set()
    for e, own in out.items():
        merged = []
        for b, f in sorted(own):
            if merged and b < merged[-1][1]:
                merged[-1][1:] = [max(merged[-1][1], f), merged[-1][2] + 1]
            else:
                merged.append([b, f, 1])
        found |= {(e, *m) for m in merged}
    return found


@pytest.mark.parametrize("block", [1 << 16, 13, 1])
def test_clusters_in_blocks(spark, block):
    rows = rows_of_intervals()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "h string, b int, f int, entity string").repartition(3)
    got = [(r.entity, r.beg, r.end, r.n) for r in interval_clusters(df, "h", "b", "f", block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_clusters(rows)
    assert interval_clusters(df.limit(0), "h", "b", "f", block).count() == 0


def test_low_runs(spark):
    segments = [("a", 0, 5, 1), ("a", 5, 9, 3), ("a", 9, 12, 4), ("a", 12, 13, 0), ("b", 0, 2, 9), ("b", 2, 8, 2)]
    df = spark.createDataFrame(segments, "entity string, beg bigint, end bigint, depth bigint")
    assert sorted(map(tuple, low_coverage_runs(df).collect())) == [("a", 0, 9), ("b", 2, 8)]


def test_percentile_over_parts(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "PARTS", 5)
    rng = np.random.default_rng(1)
    rows = [("hot", int(x)) for x in rng.integers(0, 40, 200)] + [("b", 7), ("b", 7), ("c", 5), ("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    want = {g: sorted(v for h, v in rows if h == g and v is not None) for g in "hot b c".split()}
    for nth in (1, 3):
        assert {r.g: r.v for r in support_percentile(df, "g", "v", nth).collect()} == {g: x[min(nth, len(x)) - 1] for g, x in want.items()}


@pytest.mark.parametrize("block", [1 << 16, 9])
def test_islands_and_seeds(spark, block):
    rng = np.random.default_rng(5)
    places = sorted(set(rng.integers(0, 600, 90).tolist()))
    df = spark.createDataFrame([("a", p, 1) for p in places], "entity string, pos bigint, n bigint").repartition(3)
    got = {r.pos: r.island for r in seed_islands(df, 10, block).collect()}
    assert len(got) == len(places) and all((got[x] == got[y]) == (y - x < 10) for x, y in zip(places, places[1:]))
    seeds = []
    for p in places:
        if not seeds or p - seeds[-1][0] >= 10:
            seeds.append([p, 0])
        seeds[-1][1] += 1
    assert sorted((r.seed, r.n) for r in seed_clusters(df, "entity", "pos", 10).collect()) == [tuple(x) for x in seeds]


def test_near_kmers_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    kmers = {"".join(rng.choice(list("AC"), 9)) for _ in range(120)} | {"ACGT", "ACGA", "TTTT"}
    df = spark.createDataFrame([(k,) for k in kmers] + [(None,), ("ACGT",)], "kmer string")
    far = lambda a, b: sum(x != y for x, y in zip(a, b))
    for most in (0, 1, 2):
        want = {(a, b, far(a, b)) for a, b in combinations(sorted(kmers), 2) if len(a) == len(b) and far(a, b) <= most}
        got = list(map(tuple, hamming_pairs(df, "kmer", most).collect()))
        assert len(got) == len(set(got)) and set(got) == want


def test_reads_by_edges_moves_no_row_of_its_result(spark, monkeypatch):
    rng = np.random.default_rng(8)
    postings = [("hot", f"r{i}") for i in range(400)] + [("warm", f"r{i}") for i in range(200, 500)] + [(f"k{i}", f"r{j}") for i in range(50) for j in set(rng.integers(0, 500, 5).tolist())]
    edges = [(f"s{i}", k, 1) for i in range(60) for k in ("hot", "warm", "none", None, *(f"k{j}" for j in rng.integers(0, 60, 4)))][: -8 * 20] + [(f"t{i}", f"k{i}", 1) for i in range(50)] + [("t0", "k0", 2), ("u", "none", 1), (None, "hot", 1)]
    of = {}
    for k, r in postings:
        of.setdefault(k, set()).add(r)
    want = {(s, r) for s, k, _ in edges if s for r in of.get(k, ())}
    monkeypatch.setattr(nhood, "AT_ONCE", 1000)
    df = nhood.reads_by_edges(spark.createDataFrame(edges, "src string, dst string, dist int"), spark.createDataFrame(postings, "kmer string, read_id string"))
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) > 15_000 and set(got) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange")  # nothing is shuffled once the pairs are made


def test_reads_by_edges_moves_a_posting_to_one_task(spark, monkeypatch):
    monkeypatch.setattr(nhood, "TASK_READS", 50)
    postings = spark.createDataFrame([(k, f"r{i}") for k in ("hot", "warm") for i in range(400)] + [("hot", "r1"), ("alone", "r2")], "kmer string, read_id string")  # rows can repeat
    edges = spark.createDataFrame([(f"s{i}", k, 1) for i in range(60) for k in ("hot", "warm", "none")] + [("s0", "hot", 1)], "src string, dst string, dist int")
    df = nhood.reads_by_edges(edges, postings)
    assert sorted(map(tuple, df.collect())) == sorted((f"s{i}", f"r{j}") for i in range(60) for j in range(400))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(hash(read_id" in plan and "pmod(hash(src" not in plan
    assert len({r.part for r in df.select("read_id", F.spark_partition_id().alias("part")).distinct().collect()}) > 4
    assert df.select("read_id", F.spark_partition_id()).distinct().count() == 400
