"""Queries do the whole job: no length window, no cap of rounds or hops."""

import numpy as np
import pytest

from kmerloom.functions import align
from kmerloom.operators import graph


def dna(rng, n):
    return "".join(rng.choice(list("ACGT"), n))


def tables(spark, folder, reads, creads=()):
    spark.createDataFrame(reads, "read_idx long, header string, seq string").write.parquet(f"{folder}/fasta_reads.parquet")
    spark.createDataFrame(list(creads), "read_idx long, read_id string, ktmers array<string>, dists array<int>").write.parquet(f"{folder}/creads.parquet")
    return str(folder)


def test_pairs_of_any_length_are_aligned(spark, tmp_path):
    from kmerloom.plans import align_queries as q
    from kmerloom.plans import assembly_queries

    rng = np.random.default_rng(1)
    s = dna(rng, 1400)
    own = {1: s, 2: s[600:], 3: s[700:1000]}
    kts = [s[i : i + 20] for i in range(720, 980, 50)]
    sf = tables(spark, tmp_path, [(i, f">r{i}", x) for i, x in own.items()], [(i, f"r{i}", kts, [1] + [50] * len(kts)) for i in own])
    got = {(r.base, r.neighbour): (r.score, r.align_len) for r in q.local_align(spark, sf).collect()}
    assert got == {(1, 2): (800.0, 800), (1, 3): (300.0, 300), (2, 3): (300.0, 300)}
    assert [(r.base, r.neighbour, r.matches) for r in q.fitting_align(spark, sf).filter("matches = base * 0 + 800").collect()] == [(1, 2, 800)]
    assert {(r.base, r.neighbour, r.lcs) for r in q.subsequences(spark, sf).collect()} == {(1, 2, 800), (1, 3, 300), (2, 3, 300)}
    assert [(r.n_reads) for r in q.cluster_by_alignment(spark, sf).collect()] == [2]
    assert assembly_queries.aligned_regions(spark, sf).count() > 0 and assembly_queries.alignment_layout(spark, sf).count() > 0


@pytest.mark.parametrize("fitting", [False, True])
def test_tables_made_again_in_blocks(monkeypatch, fitting):
    rng = np.random.default_rng(2)
    a, c = dna(rng, 150), dna(rng, 40)
    b = a[20:60] + c + a[70:]
    f = lambda: (align.affine(a, b, fitting=fitting), align.gapped_rows(a, b), align.common_subsequence(a, b), align.common_supersequence(b, a))
    whole = f()
    monkeypatch.setattr(align, "WHOLE", 100)
    assert f() == whole


def test_long_pairs_need_little_memory():
    import tracemalloc

    s = dna(np.random.default_rng(3), 9000)
    tracemalloc.start()
    assert align.affine(s, s[50:])[:3] == (8950.0, 8950, 8950)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


@pytest.mark.parametrize("forests", [0, 1, 3])
def test_clusters_align_only_pairs_between_groups(spark, tmp_path, monkeypatch, forests):
    from kmerloom.plans import align_queries as q

    rng = np.random.default_rng(7)
    genomes = [dna(rng, 2600), dna(rng, 1500)]
    own = {10 * g + i: genomes[g][b : b + 900] for g, begins in enumerate([(0, 80, 160, 240, 320, 1100, 1650), (0, 100, 600)]) for i, b in enumerate(begins)}
    begun = {10 * g + i: b for g, begins in enumerate([(0, 80, 160, 240, 320, 1100, 1650), (0, 100, 600)]) for i, b in enumerate(begins)}
    kts = {i: [(p, genomes[i // 10][p : p + 20]) for p in range(0, 2580, 20) if begun[i] <= p <= begun[i] + 880 and p + 20 <= len(genomes[i // 10])] for i in own}
    sf = tables(spark, tmp_path, [(i, f">r{i}", x) for i, x in own.items()], [(i, f"r{i}", [k for _, k in x], [x[0][0] - begun[i]] + [20] * (len(x) - 1) + [40]) for i, x in kts.items()])
    monkeypatch.setattr(q, "FORESTS", forests)
    asked, keep = [], q._with_sequences
    monkeypatch.setattr(q, "_with_sequences", lambda reads, pairs, cells: asked.extend(tuple(r)[:2] for r in pairs.collect()) or keep(reads, pairs, cells))
    found = {r.component: r.n_reads for r in q.cluster_by_alignment(spark, sf).collect()}
    tried = list(asked)
    everything = graph.components(q._aligned(spark, sf, False).filter("align_len > 400").selectExpr("base as src", "neighbour as dst")).groupBy("component").count()
    assert found == {r.component: r["count"] for r in everything.collect()} and set(found.values()) >= {5, 2}
    assert len(tried) == len(set(tried)) and (len(tried) < len(asked) - len(tried) if forests else len(tried) == len(asked) - len(tried))


def test_walks_go_on_to_their_end(spark):
    chain = [(f"n{i}", f"n{i + 1}", 2) for i in range(100)] + [("n5", "side", 1), ("c0", "c1", 1), ("c1", "c2", 1), ("c2", "c1", 1), ("s", "s", 1)]
    starts = spark.createDataFrame([("n0",), ("n50",), ("c0",), ("s",), ("alone",)], "node string")
    got = {}
    for r in graph.walk(spark.createDataFrame(chain, "src string, dst string, n_reads long"), starts).collect():
        got.setdefault(r.start, []).append((r.n, r.node))
    want = {"n0": [f"n{i}" for i in range(101)], "n50": [f"n{i}" for i in range(50, 101)], "c0": ["c0", "c1", "c2"], "s": ["s"], "alone": ["alone"]}
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(v)) for k, v in want.items()}


def test_neighbourhood_is_bounded_by_distance_only(spark):
    edges = [(f"n{i}", f"n{i + 1}", 20) for i in range(15)]
    got = graph.bounded_neighbourhood(spark.createDataFrame(edges, "src string, dst string, dist int"), spark.createDataFrame([("n2",)], "node string"), 200).collect()
    assert {(r.node, r.pos) for r in got} == {(f"n{i}", 20 * (i - 2)) for i in range(13)}


def test_neighbourhood_takes_no_round_a_hop(spark, monkeypatch):
    rng = np.random.default_rng(6)
    edges = [(f"n{i}", f"n{i + 1}", 3) for i in range(60)] + [(f"n{a}", f"n{b}", int(d)) for a, b, d in zip(rng.integers(0, 150, 300), rng.integers(0, 150, 300), rng.integers(-300, 300, 300))] + [("far", "n0", 500), ("n1", None, 5), ("n2", "n9", None)]
    e, seeds = spark.createDataFrame(edges, "src string, dst string, dist int"), spark.createDataFrame([(f"n{i}",) for i in range(0, 150, 7)] + [("alone",), ("far",)], "node string")
    joined = sorted(map(tuple, graph.bounded_neighbourhood(e, seeds, 200, held=0).collect()))
    rounds, keep = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, *x: rounds.append(1) or keep(df, *x))
    monkeypatch.setattr(graph, "MARKS", 1000)
    assert sorted(map(tuple, graph.bounded_neighbourhood(e, seeds, 200).collect())) == joined
    assert len(joined) > 500 and len(rounds) < 5
    # a chain of 60 hops, whose last place is 180
    chain = graph.bounded_neighbourhood(spark.createDataFrame(edges[:60], "src string, dst string, dist int"), spark.createDataFrame([("n0",)], "node string"), 200).collect()
    assert sorted(r.pos for r in chain) == list(range(0, 181, 3)) and len(rounds) < 10


def test_consensus_draws_sixty_four_quartets(spark, tmp_path, monkeypatch):
    from kmerloom.plans import align_queries as q

    rng = np.random.default_rng(4)
    truth = dna(rng, 480)
    own = {i: "".join("" if rng.random() < 0.02 else c + (dna(rng, 1) if rng.random() < 0.02 else "") for c in truth) for i in range(8)}
    kts = [f"{'ACGT' * 4}{x}" for x in "ACGT"] + ["CA" * 8]
    sf = tables(spark, tmp_path, [(i, f">r{i}", x) for i, x in own.items()], [(i, f"r{i}", kts, [1] + [50] * len(kts)) for i in own])
    got = {r.base: (r.consensus, r.n_support, r.accepted) for r in q.consensus_tree(spark, sf).collect()}
    groups = {}
    for r in sorted(q._groups(spark, sf).collect(), key=lambda r: r["rank"]):
        groups.setdefault(r.base, []).append(r.seq)
    drawn, four = [], align.sample_of_four
    monkeypatch.setattr(align, "sample_of_four", lambda *x: drawn.append(set(x) <= set(own.values())) or four(*x))
    want = {k: align.consensus_tree(v) for k, v in groups.items()}
    assert len(own) == len(want) and sum(drawn) == 64 * len(own) and got == want
    assert got != {k: align.consensus_tree(v, groups=1) for k, v in groups.items()}


def test_longest_paths_of_many_reads(spark, tmp_path):
    from kmerloom.plans import graph_queries as q

    rng = np.random.default_rng(5)
    begins = np.r_[np.arange(0, 300_000, 500), rng.integers(0, 300_000, 300)].tolist() + [900_000, 900_400]
    reads = {i: (b, b + int(rng.integers(520, 900))) for i, b in enumerate(begins)}
    creads = [(i, f"r/genome_{b}_{e}", None, None) for i, (b, e) in reads.items()]
    want, order = {}, sorted(reads, key=lambda i: reads[i])
    edges = [(i, j) for n, i in enumerate(order) for j in order[n + 1 : n + 20] if reads[i][0] < reads[j][0] < reads[i][1] < reads[j][1]]
    for i, j in edges:
        want[j] = max(want.get(j, 0), want.setdefault(i, 0) + reads[j][1] - reads[i][1])
    sf = tables(spark, tmp_path, [(0, "", "")], creads)
    assert {r.node: r.best for r in q.longest_paths(spark, sf).collect()} == want and max(want.values()) > 290_000
