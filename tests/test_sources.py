import pytest

from kmerloom.sources import readers, writers


@pytest.fixture
def file(tmp_path):
    def put(text, name="x.txt"):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return put


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_fasta(spark, file):
    path = file("; no record\n>r1 note\nACg\nTT\n\n>r2\n>r3\nN\n")
    assert rows(readers.read_fasta(spark, path)) == [("r1 note", "ACGTT"), ("r2", ""), ("r3", "N")]
    assert rows(readers.read_fasta(spark, path, upper=False, first_line_only=True)) == [("r1 note", "ACg"), ("r2", ""), ("r3", "N")]
    assert rows(readers.read_fasta(spark, file("", "e.fa"))) == []
    assert rows(readers.read_headers(spark, path)) == [("r1 note",), ("r2",), ("r3",)]
    assert readers.read_genome(spark, path).count() == 1


def test_fastq(spark, file):
    assert rows(readers.read_fastq(spark, file("@a 1\nacgt\n+\nIIII\n@b\nTT\n+b\n@I\n"))) == [("a 1", "ACGT", "IIII"), ("b", "TT", "@I")]


def test_lists(spark, file):
    assert rows(readers.read_creads(spark, file("2 GTA 8\n10\n"))) == [(0, ["GTA"], [2, 8]), (1, [], [10])]
    assert rows(readers.read_headers_index(spark, file("K a b a\n"))) == [("K", "a"), ("K", "b")]
    assert rows(readers.read_headers_index_old(spark, file("K a 1 9 b 2 8\n"))) == [("K", "a", 1, 9), ("K", "b", 2, 8)]
    assert rows(readers.read_edges(spark, file("K a -5 b 7\n"))) == [("K", "a", -5), ("K", "b", 7)]
    assert rows(readers.read_truth(spark, file("1: 2 3\n4 5\nx: 1\n"))) == [(1, 2), (1, 3), (4, 5)]
    assert rows(readers.read_ktmer_list(spark, file("Found 3\nACG, 5\nTTT\n"))) == [("ACG",), ("TTT",)]
    assert rows(readers.read_list_log(spark, file("x\n['12', 'ACGT', '7']\n"))) == [(1, ["12", "ACGT", "7"])]
    assert rows(readers.read_trimmed_lines(spark, file("a\nb\nc\nd\n"), 1, 1)) == [(1, "b"), (2, "c")]


def test_alignments(spark, file):
    m1 = "q/0 t 0 1 -500 99.5 1 90 100 2 91 95 1000"
    assert rows(readers.read_m1(spark, file(f"pre am ble x {m1}\n{m1}\nbad\n")), "q_name", "accuracy", "q_end") == [("q/0", 99.5, 91)] * 2
    m5 = "q 10 0 4 +  t 20 3 7 + -20 4 0 0 0 254 ACGT |||| ACGT"
    assert rows(readers.read_m5(spark, file(m5 + "\n")), "q_name", "t_end", "n_match", "t_aligned") == [("q", 7, 4, "ACGT")]
    m0 = "         Query: r1/0\n    %sim: x\n   QueryRange: 1 -> 9 of 20\n  TargetRange: 5 -> 13 of 99\n"
    assert rows(readers.read_m0(spark, file(m0.replace("   QueryRange", "   QueryRange").replace("         Query", "         Query")))) == [("r1/0", 1, 9, 20, 5, 13)]
    assert rows(readers.read_m0_accuracies(spark, file("   %%%%\n      % sim: 88.5\n"))) == [(88.5,)]
    assert rows(readers.read_sam(spark, file("@HD x\nr 0 g 77 60 4M * 0 0 ACGT IIII\n"))) == [("r", 77.0, "ACGT")]


def test_reports(spark, file):
    assert rows(readers.read_overlap_info(spark, file("Chimeric 1\nRight a b 5\nNonChimeric\nRight a c 7\n"))) == [("a", "b", 5, True), ("a", "c", 7, False)]
    assert rows(readers.read_kmer_report(spark, file("ACG Deg = 5 t = 7 correct pos = 2.5\nTTT Deg = 1 t = 2 incorrect\n"))) == [("ACG", 5, 7, True, 2.5), ("TTT", 1, 2, False, None)]
    seq = "ACGT" * 5
    assert rows(readers.read_contig_locations(spark, file(f"[1.5] [30] {seq}\n[1] [2] ACGT\n"))) == [(1.5, 30.0, seq)]
    assert rows(readers.read_replacement_plan(spark, file("h 1 5 c.fa 0 4\n"))) == [("h", 1, 5, "c.fa", 0, 4)]
    assert rows(readers.read_matching_log(spark, file("/d/nhood_nh12_ACG.fasta\n>r1\n>r2\n\n>r3\n")), "pos", "header") == [(12, "r1"), (12, "r2")]


def test_folders(spark, tmp_path, file):
    file(">a x\nac\n", "nhood_nh5_ACG.fasta")
    file(">c\nGT\n", "9_corr.fasta")
    assert rows(readers.read_nhoods(spark, str(tmp_path))) == [("nhood_nh5_ACG.fasta", 5, "ACG", "a x", "AC")]
    assert rows(readers.read_consensuses(spark, str(tmp_path))) == [("9_corr.fasta", "c", "GT")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("c1", "h1", "ACGT"), ("c2", ">h2", None)], "contig string, header string, seq string")
    writers.write_fasta(df, str(tmp_path / "f"))
    assert rows(readers.read_fasta(spark, str(tmp_path / "f"))) == [("h1", "ACGT"), ("h2", "")]
    writers.write_contigs(df.filter("seq is not null"), str(tmp_path / "c"))
    assert (tmp_path / "c" / "contig=c1").exists()
    edges = spark.createDataFrame([("a", "b", 3), ("a", "c", -1)], "src string, dst string, dist int")
    writers.write_dot(edges, spark.createDataFrame([("a",)], "node string"), str(tmp_path / "d"))
    text = "".join(p.read_text() for p in (tmp_path / "d").glob("part-*"))
    assert text.startswith("digraph G {") and text.rstrip().endswith("}") and '"a" -> "c";' in text and '"b" [color=red];' in text
    writers.write_report(edges, str(tmp_path / "r"))
    writers.write_lines(edges, str(tmp_path / "l"), "dist")
    assert "src = a" in "".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))
