"""Assembly steps against plain versions on small made-up sequences."""

import numpy as np
import pytest

from kmerloom.functions.align import affine_span, gapped_rows
from kmerloom.operators import assembly, graph
from kmerloom.operators.assembly import layout_line, region_walk


def dna(rng, n):
    return "".join(rng.choice(list("ACGT"), n))


def test_span_of_a_local_alignment():
    assert affine_span("TTTTACGTACGTCC", "GGACGTACGTAA") == (4, 12, 2, 10, 8, 8)
    assert affine_span("", "ACGT") == affine_span(None, "A") == affine_span("AAA", "CCC") == (0,) * 6


def edges_of(*paths):
    return [(a, b, t) for path, t in paths for a, b in zip(path, path[1:])]


def test_bulges_keep_the_heavier_path(spark):
    rows = edges_of(("abc", 9), ("cxyd", 3), ("cpqd", 7), ("de", 9), ("emf", 2), ("enf", 2), ("fg", 9), ("gh", 1))
    got = {(r.src, r.dst) for r in assembly.merge_bulges(spark.createDataFrame(rows, "src string, dst string, t long")).collect()}
    assert got == {(a, b) for a, b, _ in edges_of(("abcpqdemfgh", 0))}


def test_nested_bulges_and_empty_graph(spark):
    rows = edges_of(("ab", 9), ("bcd", 5), ("dxf", 4), ("dyf", 3), ("fz", 5), ("bwz", 1), ("zt", 9))
    df = spark.createDataFrame(rows, "src string, dst string, t long")
    assert {(r.src, r.dst) for r in assembly.merge_bulges(df).collect()} == {(a, b) for a, b, _ in edges_of(("abcdxfzt", 0))}
    assert assembly.merge_bulges(df.limit(0)).count() == 0


def test_nodes_are_split_by_read_clusters(spark):
    rng = np.random.default_rng(3)
    one, two = dna(rng, 200), dna(rng, 200)
    reads = [(i, (one if i < 4 else two)) for i in range(8)] + [(8, dna(rng, 150))]
    creads = [(i, 1, "K", 10) for i in range(9)] + [(i, 2, "A" if i < 4 else "B", 40) for i in range(8)] + [(0, 3, "K", 90)]
    df = spark.createDataFrame(creads, "read_idx long, ord int, kmer string, pos int")
    got = assembly.node_clusters(df, spark.createDataFrame(reads, "read_idx long, seq string"))
    assert sorted(map(tuple, got.select("kmer", "read_idx", "cluster").collect())) == [("K", i, 1 if i < 4 else 2) for i in range(8)]
    edges = {(r.src, r.dst) for r in graph.a_bruijn(graph.split_nodes(df, got)).collect()}
    assert edges == {("head", "K_1"), ("head", "K_2"), ("head", "K"), ("K_1", "A"), ("K_2", "B"), ("A", "K_1")}


def test_contigs_grow_along_overlaps(spark):
    rng = np.random.default_rng(8)
    genome = dna(rng, 1000)
    starts = {5: 0, 3: 200, 9: 400, 1: 600}
    reads = [(i, genome[b : b + 400]) for i, b in starts.items()] + [(7, dna(rng, 300))]
    creads = [(i, genome[p : p + 18], p - b, 400) for i, b in starts.items() for p in range(0, 982, 25) if b <= p <= b + 382]
    df = spark.createDataFrame(creads, "read_idx long, kmer string, pos int, len int")
    got = assembly.extended_contigs(df, spark.createDataFrame(reads, "read_idx long, seq string")).collect()
    assert [(r.contig, r.part, r.n_segments, r.seq) for r in got] == [(5, 0, 4, genome)]


def test_segments_that_do_not_join_begin_a_part(spark):
    rng = np.random.default_rng(2)
    a, b = dna(rng, 300), dna(rng, 200)
    rows = [("c", 0, a[:200]), ("c", 1, a[120:]), ("c", 2, "A" * 3 + "T" * 80), ("c", 3, b), ("d", 0, b)]
    got = assembly.combine_segments(spark.createDataFrame(rows, "contig string, ord long, seq string"), 100, 20, 80.0).collect()
    assert {(r.contig, r.seq) for r in got} >= {("c", a), ("c", b), ("d", b)} and len(got) == 4
    assert assembly.combine_segments(spark.createDataFrame([], "contig string, ord long, seq string")).count() == 0


def test_circular_contigs_lose_their_repeat(spark):
    rng = np.random.default_rng(6)
    s = dna(rng, 400)
    rows = [(1, s + s[:60]), (2, s), (3, None), (4, ""), (5, s[:100])]
    got = {r.k: (r.seq, r.n_cut) for r in assembly.trim_circular(spark.createDataFrame(rows, "k int, seq string"), "k", "seq", 100, 5).collect()}
    assert got == {1: (s, 60), 2: (s, 0), 3: (None, None), 4: ("", 0), 5: (s[:100], 0)}


def test_multiplicity_against_counting(spark):
    rng = np.random.default_rng(1)
    reads = [dna(rng, 300) for _ in range(4)] + ["ACGACGNACG", "A"]
    prefixes = {s[20:23] for s in reads[:4]}
    df = spark.createDataFrame(list(enumerate(reads)), "read_idx long, seq string")
    got = assembly.extension_multiplicity(df, spark.createDataFrame([(p,) for p in [*prefixes, *prefixes, "AC", None]], "prefix string"), 3, 2)
    want = {}
    for s in reads:
        for i in range(len(s) - 4):
            want.setdefault(s[i : i + 5], [0, 0])[0] += 1
        for i in range(len(s) - 5):
            for x in {s[i : i + j] + s[i + j + 1 : i + 6] for j in range(6)}:
                want.setdefault(x, [0, 0])[1] += 1
    want = {(k[:3], k[3:], *v) for k, v in want.items() if k[:3] in prefixes and set(k[3:]) <= set("ACGT")}
    assert set(map(tuple, got.select("prefix", "extension", "exact", "inserted").collect())) == want
    best = {r.prefix: r.extension for r in assembly.best_extensions(got).collect()}
    assert best == {p: min((-e - i, -e, x) for q, x, e, i in want if q == p)[2] for p in prefixes if any(q == p for q, *_ in want)}


def test_reads_take_the_part_of_a_contig(spark):
    rng = np.random.default_rng(7)
    s = dna(rng, 120)
    wrong = s[:50] + "T" * 4 + s[53:]
    reads = spark.createDataFrame([(1, "GG" + wrong + "CC"), (2, s[:60]), (3, dna(rng, 80))], "read_idx long, seq string")
    contigs = spark.createDataFrame([(50, s)], "contig long, seq string")
    kt = spark.createDataFrame([(s[10:25],), (s[80:95],)], "kmer string")
    got = assembly.separate_parts(assembly.substitution_plan(reads, contigs, kt, 15)).collect()
    assert [(r.read_idx, r.contig, r.beg, r.end, r.piece) for r in got] == [(1, 50, 12, 98, s[10:95])]


def plain_walk(q_beg, q_end, t_beg, q, t, flipped, beg, end):
    comp = dict(zip("ACGT-", "TGCA-"))
    if flipped:
        q, t = ("".join(comp[c] for c in reversed(x)) for x in (q, t))
    g, r, a, out = t_beg, (q_end if flipped else q_beg), 0, []
    for stop in (beg, end):
        while g < stop and a < len(t):
            r += (q[a] != "-") * (-1 if flipped else 1)
            g += t[a] != "-"
            a += 1
        out.append((r, g))
    (r1, g1), (r2, g2) = out
    return (r2, r1, g1, g2) if flipped else (r1, r2, g1, g2)


@pytest.mark.parametrize("flipped", [False, True])
def test_walk_against_steps(flipped):
    rng = np.random.default_rng(11)
    for _ in range(80):
        t, q = gapped_rows(dna(rng, int(rng.integers(1, 30))), dna(rng, int(rng.integers(1, 30))))
        t_beg = int(rng.integers(0, 20))
        beg = int(rng.integers(0, 50))
        args = (3, 3 + len(q.replace("-", "")), t_beg, q, t, flipped, beg, beg + int(rng.integers(0, 30)))
        assert region_walk(*args) == plain_walk(*args)


def test_layout_puts_equal_places_under_each_other(spark):
    rng = np.random.default_rng(12)
    genome = dna(rng, 2600)
    rows = [("g", 100, 0, "", "")][:0]
    for i in range(12):
        b = int(rng.integers(0, 2400))
        piece = genome[b : b + 150]
        noisy = "".join(c + (dna(rng, 1) if rng.random() < 0.1 else "") for c in piece if rng.random() > 0.1)
        t, q = gapped_rows(piece, noisy)
        rows.append(("g", i, b, q, t))
    df = spark.createDataFrame(rows, "target string, row long, t_beg int, q_aligned string, t_aligned string")
    got = {r.row: r for r in assembly.layout(df).collect()}
    widths = {}
    for _, _, b, _, t in rows:
        for p, n in assembly._inserted(t, b).items():
            widths[p] = max(widths.get(p, 0), n)
    for _, i, b, q, t in rows:
        assert got[i].offset == b + sum(w for p, w in widths.items() if p < b)
        assert got[i].line == layout_line(b, q, t, widths) and got[i].line.replace("-", "") == q.replace("-", "")
    assert layout_line(2, "A-CG", "AT-G", {2: 1, 3: 0, 4: 2}) == "-A-C-G"


def test_nulls_do_not_break_the_layout(spark):
    rows = [("g", 1, 0, "AC", "AC"), ("g", 2, None, "A", "A"), (None, 3, 0, "A", "A"), ("g", 4, 0, None, None)]
    got = assembly.layout(spark.createDataFrame(rows, "target string, row long, t_beg int, q_aligned string, t_aligned string")).collect()
    assert [(r.row, r.offset, r.line) for r in got] == [(1, 0, "AC")]


def test_contigs_merge_by_place(spark):
    rng = np.random.default_rng(13)
    g = dna(rng, 300)
    left = g[:95] + "A" * 5  # its last bases are wrong, and so lose by t
    rows = [(1, 0, 100, left), (2, 90, 200, g[90:200]), (3, 195, 300, g[195:]), (4, 120, 150, g[120:150]), (5, 500, 520, "ACGT" * 5), (6, None, 3, "ACG")]
    df = spark.createDataFrame(rows, "id long, beg long, end long, seq string")
    kt = spark.createDataFrame([(g[90:98], 5, 1), (g[192:200], None, 2)], "kmer string, t int, degree int")
    got = {r.id: (r.beg, r.end, r.seq) for r in assembly.merge_by_place(df, kt, 8, 20).collect()}
    assert got == {1: (0, 300, g), 5: (500, 520, "ACGT" * 5)}
    assert assembly.merge_by_place(df.limit(0), kt, 8, 20).count() == 0


def test_layout_rows_keep_gaps_as_bits(spark, monkeypatch):
    from kmerloom.operators import assembly

    kept = []
    monkeypatch.setattr(assembly, "stored", lambda df, compression="snappy": kept.append((df.columns, compression)) or df)
    rows = spark.createDataFrame([(1, 2, 0, "A-CGTTTTTTT", "ATCG-------"), (1, 3, 0, "AGT", "AT-")], "target long, row long, t_beg int, q_aligned string, t_aligned string")
    got = {r.row: (r.offset, r.line) for r in assembly.layout(rows).collect()}
    assert got == {2: (0, "A--CGTTTTTTT"), 3: (0, "AGT")} and "t_aligned" not in kept[0][0] and kept[0][1] == "zstd"


def test_pairs_are_laid_out_without_widths_for_each_row(spark):
    rng = np.random.default_rng(14)
    target, other = dna(rng, 1300), dna(rng, 40)
    noisy = lambda x: "".join(c + (dna(rng, int(rng.integers(1, 4))) if rng.random() < 0.1 else "") for c in x if rng.random() > 0.1)
    pairs = [(1, i, target, noisy(target[b:])) for i, b in enumerate((0, 0, 400, 900), 2)] + [(1, 9, target, "TT" + target + "GGG"), (3, 4, other, noisy(other)), (3, 5, other, ""), (5, 6, other, None)]
    df = spark.createDataFrame(pairs, "base long, neighbour long, s1 string, s2 string").repartition(3)
    rows = [(b, n, 0, *gapped_rows(x, y)[::-1]) for b, n, x, y in pairs if y is not None]
    want = assembly.layout(spark.createDataFrame(rows, "target long, row long, t_beg int, q_aligned string, t_aligned string"))
    made = assembly.pair_layout(df)
    assert made.dtypes == want.dtypes and sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect())) and len(rows) == 7


def test_alignment_layout_joins_no_widths(spark):
    from kmerloom.plans import assembly_queries

    plan = assembly_queries.alignment_layout(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "FlatMapGroupsInArrow" in plan
