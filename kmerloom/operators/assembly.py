"""From reads to contigs: bulges, node splitting, extension by best overlaps, joining, trimming, substitution, layout.

Steps that a sequential program takes read by read are taken for all reads at once:
an extension is a join that finds everyone's best successor, and the chains of
successors are ranked by doubling pointers (graph.unitigs).
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.functions.align import affine_span, gapped_rows
from kmerloom.functions.dna import deletions, kmer_rows
from kmerloom.operators import graph
from kmerloom.operators.evaluate import not_contained, range_overlaps
from kmerloom.session import broadcast_if_small, stored

_BLOCK = 1000


def merge_bulges(edges: DataFrame, most_rounds: int = 20) -> DataFrame:
    """Edges (src, dst, t) left when of parallel paths only the best stays.

    Paths without branching that leave one path and enter the same other path, and
    have no other neighbours, are parallel; the one with the highest mean t of its
    nodes stays, then the longer, then the one whose first node is less. Nested
    bulges take a round each; a graph not settled after most_rounds is an error.
    """
    for _ in range(most_rounds):
        edges = stored(edges.select("src", "dst", "t"))
        paths = stored(graph.unitigs(edges))
        sums = [edges.groupBy(F.col(x).alias("node")).agg(F.sum("t").alias("t")) for x in ("src", "dst")]
        weight = sums[0].unionByName(sums[1]).groupBy("node").agg(F.max("t").alias("t"))
        paths_of = stored(paths.join(weight, "node").groupBy("unitig").agg(F.avg("t").alias("mean"), F.count("*").alias("n"), F.max_by("node", "ord").alias("last")))
        links = stored(edges.join(paths_of.select(F.col("last").alias("src"), F.col("unitig").alias("u")), "src").join(paths_of.select(F.col("unitig").alias("dst")), "dst").select("u", F.col("dst").alias("v")).distinct())
        before = links.groupBy(F.col("v").alias("unitig")).agg(F.count("*").alias("n_in"), F.min("u").alias("behind")).filter("n_in = 1")
        after = links.groupBy(F.col("u").alias("unitig")).agg(F.count("*").alias("n_out"), F.min("v").alias("ahead")).filter("n_out = 1")
        best = Window.partitionBy("behind", "ahead").orderBy(F.desc("mean"), F.desc("n"), "unitig")  # as many rows as a node has successors
        branches = before.join(after, "unitig").filter("behind <> ahead").join(paths_of, "unitig")
        lost = branches.withColumn("place", F.row_number().over(best)).filter("place > 1").select("unitig")
        nodes = stored(paths.join(lost, "unitig").select("node"))
        if nodes.isEmpty():
            return edges
        for x in ("src", "dst"):
            edges = edges.join(nodes.withColumnRenamed("node", x), x, "left_anti")
    raise RuntimeError(f"bulges are left after {most_rounds} rounds")


def shared_words(k: int):
    """A column function (s1, s2) -> number of places of s2 whose k-mer is among those of s1."""

    @F.pandas_udf(T.IntegerType())
    def own(a: pd.Series, b: pd.Series) -> pd.Series:
        def words(s: str) -> np.ndarray:
            x = np.frombuffer(s.encode("latin-1", "replace"), np.uint8)
            return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, k)).view(f"S{k}").ravel() if len(x) >= k else np.zeros(0, f"S{k}")

        return pd.Series([int(np.isin(words(y), words(x)).sum()) for x, y in zip(a, b)], dtype="int32")

    return own


def node_clusters(creads: DataFrame, reads: DataFrame, more_than: int = 5, k: int = 15, cutoff: int = 50) -> DataFrame:
    """(kmer, read_idx, cluster): the read clusters of the kt-mers of more than `more_than` reads, but for each kt-mer's last cluster.

    The first read left is a seed and takes all left reads that share `cutoff` k-mers
    with it. creads must be without kt-mers of very many reads (nhood.usable), which
    bounds the pairs of a kt-mer; a pair is compared once for all its kt-mers.
    """
    member = stored(creads.select("kmer", "read_idx").distinct())
    large = member.groupBy("kmer").agg(F.sort_array(F.collect_list("read_idx")).alias("reads")).filter(F.size("reads") > more_than)
    inside = stored(member.join(large.select("kmer"), "kmer"))
    pairs = inside.select("kmer", F.col("read_idx").alias("a")).join(inside.select("kmer", F.col("read_idx").alias("b")), "kmer").filter("a < b")
    alike = pairs.select("a", "b").distinct()
    for x in "ab":
        alike = alike.join(reads.select(F.col("read_idx").alias(x), F.col("seq").alias(f"seq_{x}")), x)
    alike = stored(alike.withColumn("n", shared_words(k)("seq_a", "seq_b")).filter(F.col("n") >= cutoff).select("a", "b"))
    links = pairs.join(alike, ["a", "b"]).groupBy("kmer").agg(F.collect_list(F.struct("a", "b")).alias("links"))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def folded(reads: pd.Series, links: pd.Series) -> pd.Series:
        def one(ids, pairs) -> list[int]:
            near: dict[int, list[int]] = {}
            for p in () if pairs is None else pairs:
                near.setdefault(p["a"], []).append(p["b"])
            of, n = {}, 0
            for r in ids:
                if r not in of:
                    n += 1
                    for x in (r, *near.get(r, ())):
                        of.setdefault(x, n)
            return [of[r] for r in ids]

        return pd.Series([one(r, x) for r, x in zip(reads, links)])

    found = large.join(links, "kmer", "left").withColumn("of", folded("reads", "links"))
    rows = found.select("kmer", F.array_max("of").alias("last"), F.explode(F.arrays_zip("reads", "of")).alias("x"))
    return rows.filter("x.of < last").select("kmer", F.col("x.reads").alias("read_idx"), F.col("x.of").alias("cluster"))


def best_successors(creads: DataFrame, least_shared: int = 4) -> DataFrame:
    """(src, dst): reads that are each other's best extension, dst going on to the right of src.

    A read extends another if, placed by the last kt-mer they share, it begins inside
    it and ends beyond it; the best shares most kt-mers, ties by the least read_idx.
    """
    side = lambda x: creads.select("kmer", F.col("read_idx").alias(x), F.col("pos").alias(f"pos_{x}"), F.col("len").alias(f"len_{x}"))
    pairs = side("a").join(side("b"), "kmer").filter("a <> b").withColumn("shift", F.col("pos_a") - F.col("pos_b"))
    anchors = pairs.groupBy("a", "b").agg(F.countDistinct("kmer").alias("n"), F.max_by(F.struct("shift", (F.col("shift") + F.col("len_b") - F.col("len_a")).alias("more")), F.struct("pos_a", "pos_b")).alias("x"))
    found = stored(anchors.filter(F.col("n") >= least_shared).filter("x.shift > 0 and x.more > 0").select("a", "b", "n"))
    right = found.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    left = found.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    return right.join(left, ["a", "b"]).select(F.col("a").alias("src"), F.col("b").alias("dst"))


_SPAN = T.StructType([T.StructField(x, T.IntegerType()) for x in ("beg1", "end1", "beg2", "end2", "matches", "align_len")])


@F.pandas_udf(_SPAN)
def local_span(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([affine_span(x, y) for x, y in zip(a, b)], columns=_SPAN.names)


def combine_segments(segments: DataFrame, tail: int = 150, near_end: int = 50, percent: float = 0.0, least: int = 30) -> DataFrame:
    """(contig, part, n_segments, seq): the segments (contig, ord, seq; ord counts from 0) joined at the ends of their alignments.

    The last `tail` bases of a segment are aligned to the next segment. If the
    alignment has at least `least` columns, is more than `percent` accurate and ends
    less than `near_end` before the end of the segment, it is cut there and goes on
    with the next behind the alignment; otherwise the next segment begins a new part. All joints are aligned at
    once; only a part's pieces come together, as the one row that they make.
    """
    rows = stored(segments.select("contig", "ord", "seq"))
    ahead = rows.select("contig", (F.col("ord") - 1).alias("ord"), F.col("seq").alias("next"))
    joint = rows.join(ahead, ["contig", "ord"]).select("contig", "ord", F.length("seq").alias("len"), F.right("seq", F.lit(tail)).alias("end"), "next").repartition("contig", "ord")
    found = joint.withColumn("x", local_span("end", "next"))
    short = F.length("end") - F.col("x.end1")
    good = (F.col("x.align_len") >= least) & (short < near_end) & (100.0 * F.col("x.matches") > percent * F.col("x.align_len"))
    cuts = stored(found.filter(good).select("contig", "ord", (F.col("len") - short).alias("stop"), F.col("x.end2").alias("begin")))
    every = rows.join(cuts.select("contig", "ord", "stop"), ["contig", "ord"], "left").join(cuts.select("contig", (F.col("ord") + 1).alias("ord"), "begin"), ["contig", "ord"], "left")
    order = Window.partitionBy("contig").orderBy("ord")
    part = stored(every.select("contig", "ord", F.col("begin").isNull().cast("int").alias("new")).withColumn("part", F.sum("new").over(order) - 1).drop("new"))
    piece = F.expr("substring(seq, coalesce(begin, 0) + 1, greatest(coalesce(stop, length(seq)) - coalesce(begin, 0), 0))")
    lists = every.select("contig", "ord", piece.alias("piece")).join(part, ["contig", "ord"]).groupBy("contig", "part").agg(F.array_sort(F.collect_list(F.struct("ord", "piece"))).alias("l"))
    return lists.select("contig", "part", F.size("l").alias("n_segments"), F.array_join(F.col("l.piece"), "").alias("seq"))


def extended_contigs(creads: DataFrame, reads: DataFrame, least_shared: int = 4) -> DataFrame:
    """(contig, part, n_segments, seq): chains of best successors joined to contigs, named by their first read. Reads without a successor make none."""
    chain = graph.unitigs(best_successors(creads, least_shared))
    segments = chain.select(F.col("unitig").alias("contig"), "ord", F.col("node").alias("read_idx")).join(reads.select("read_idx", "seq"), "read_idx")
    return combine_segments(segments)


def trim_circular(contigs: DataFrame, key: str, seq: str, length: int, near: int = 100, percent: float = 99.3) -> DataFrame:
    """(key, seq, n_cut): contigs whose end repeats their begin, cut by what is repeated, until none is.

    The last `length` bases are aligned to the first ones; the contig is cut if the
    alignment begins within `near` bases of the begin, ends within `near` of the end
    and is more than `percent` accurate. Contigs shorter than twice `length` stay.
    """

    def trimmed(s: str | None) -> str | None:
        while s is not None and len(s) >= 2 * length:
            beg1, end1, _, end2, matches, n = affine_span(s[:length], s[-length:])
            if not n or beg1 >= near or length - end2 >= near or 100.0 * matches <= percent * n:
                break
            s = s[:-end1]
        return s

    @F.pandas_udf(T.StringType())
    def own(s: pd.Series) -> pd.Series:
        return s.map(trimmed)

    return contigs.select(key, F.col(seq).alias("_was"), own(seq).alias("seq")).select(key, "seq", (F.length("_was") - F.length("seq")).alias("n_cut"))


def extension_multiplicity(reads: DataFrame, prefixes: DataFrame, base_k: int, add_k: int) -> DataFrame:
    """(prefix, extension, exact, inserted): how often each extension of a prefix by add_k bases is read, as it is and with one base inserted.

    prefixes has a column prefix of base_k bases. Only extensions that are read come out.
    """
    k = base_k + add_k
    wanted = broadcast_if_small(stored(prefixes.select("prefix").filter(F.length("prefix") == base_k).distinct()))
    counts = [kmer_rows(reads, "seq", n).groupBy("kmer").agg(F.count("*").alias("t")) for n in (k, k + 1)]
    plain = counts[0].select("kmer", F.col("t").alias("exact"), F.lit(0).cast("bigint").alias("inserted"))
    more = counts[1].select(F.explode(F.array_distinct(deletions("kmer"))).alias("kmer"), F.lit(0).cast("bigint").alias("exact"), F.col("t").alias("inserted"))
    rows = plain.unionByName(more).withColumn("prefix", F.substring("kmer", 1, base_k)).join(wanted, "prefix", "left_semi")
    return rows.groupBy("prefix", F.substring("kmer", base_k + 1, add_k).alias("extension")).agg(F.sum("exact").alias("exact"), F.sum("inserted").alias("inserted")).filter("extension rlike '^[ACGT]+$'")


def best_extensions(counts: DataFrame) -> DataFrame:
    """(prefix, extension, exact, inserted): the extension read most often; ties by the exact count, then the lesser string."""
    order = F.struct((-F.col("exact") - F.col("inserted")).alias("a"), (-F.col("exact")).alias("b"), "extension")
    best = counts.groupBy("prefix").agg(F.min_by(F.struct("extension", "exact", "inserted"), order).alias("x"))
    return best.select("prefix", "x.*")


def substitution_plan(reads: DataFrame, contigs: DataFrame, ktmers: DataFrame, k: int) -> DataFrame:
    """(read_idx, contig, beg, end, piece): parts of reads between the first and the last kt-mer shared with a contig, with the contig's own part.

    In a read the last place of a kt-mer counts, in a contig all do, in their order.
    Pairs whose first and last places don't come in the same order in both, or whose
    parts are equal, have no row. ktmers must be bounded in their counts.
    """
    known = broadcast_if_small(stored(ktmers.select("kmer")))
    hits = kmer_rows(reads, "seq", k, "read_idx").join(known, "kmer", "left_semi").groupBy("read_idx", "kmer").agg(F.max("pos").alias("r"))
    anchors = kmer_rows(contigs, "seq", k, "contig").join(known, "kmer", "left_semi").select("contig", "kmer", F.col("pos").alias("c"))
    ends = hits.join(anchors, "kmer").filter("read_idx <> contig").groupBy("read_idx", "contig").agg(F.min(F.struct("c", "r")).alias("f"), F.max(F.struct("c", "r")).alias("l")).filter("f.c < l.c and f.r < l.r")
    cut = ends.join(contigs.select("contig", "seq"), "contig").select("read_idx", "contig", F.col("f.r").cast("int").alias("beg"), (F.col("l.r") + k).cast("int").alias("end"), F.expr(f"substring(seq, cast(f.c as int) + 1, cast(l.c - f.c as int) + {k})").alias("piece"))
    return cut.join(reads.select("read_idx", "seq"), "read_idx").filter("substring(seq, beg + 1, end - beg) <> piece").select("read_idx", "contig", "beg", "end", "piece")


def separate_parts(plan: DataFrame) -> DataFrame:
    """The rows of a plan(read_idx, contig, beg, end, ..) that begin at or behind the ends of all before them; first comes the lesser begin, then the longer, then the lesser contig."""
    order = Window.partitionBy("read_idx").orderBy("beg", F.desc("end"), "contig")
    return plan.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).filter("reach is null or beg >= reach").drop("reach")


def _turned(s: str) -> str:
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def region_walk(q_beg: int, q_end: int, t_beg: int, q_row: str, t_row: str, flipped: bool, beg: int, end: int) -> tuple[int, int, int, int]:
    """(read begin, read end, target begin, target end) of the aligned columns between two places of the target.

    A row on the other strand (flipped) is turned first, so that the target goes
    forward; the read's places then count down from its end.
    """
    if flipped:
        q_row, t_row = _turned(q_row), _turned(t_row)
    q, t = (np.cumsum(np.frombuffer(x.encode("latin-1"), np.uint8) != ord("-")) for x in (q_row, t_row))
    at = [0 if x <= t_beg else min(int(np.searchsorted(t, x - t_beg)) + 1, len(t)) for x in (beg, max(beg, end))]
    read, target = ([0 if a == 0 else int(x[a - 1]) for a in at] for x in (q, t))
    places = (q_end - read[1], q_end - read[0]) if flipped else (q_beg + read[0], q_beg + read[1])
    return (*places, t_beg + target[0], t_beg + target[1])


_WALK = T.StructType([T.StructField(x, T.IntegerType()) for x in ("read_beg", "read_end", "region_beg", "region_end")])


@F.pandas_udf(_WALK)
def _walked(q_beg: pd.Series, q_end: pd.Series, t_beg: pd.Series, q_row: pd.Series, t_row: pd.Series, flipped: pd.Series, beg: pd.Series, end: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([region_walk(*x) for x in zip(q_beg, q_end, t_beg, q_row, t_row, flipped, beg, end)], columns=_WALK.names)


def aligned_regions(alignments: DataFrame, beg: str, end: str, least: int = 0) -> DataFrame:
    """alignments in the 20-column format (readers.read_m5) that overlap the region by more than `least` bases, with its places in the read and the strand of it.

    beg and end are columns, so each row can have its own region. Rows with a null in
    what is needed are left out.
    """
    need = ["q_beg", "q_end", "t_beg", "t_end", "q_aligned", "t_aligned", beg, end]
    rows = alignments.dropna(subset=need).filter((F.col("t_end") - least > F.col(beg)) & (F.col("t_beg") + least < F.col(end)))
    flipped = F.coalesce(F.col("t_strand") == "-", F.lit(False))
    strand = F.when(flipped, F.translate("q_strand", "+-", "-+")).otherwise(F.col("q_strand"))
    x = _walked("q_beg", "q_end", "t_beg", "q_aligned", "t_aligned", flipped, F.col(beg).cast("int"), F.col(end).cast("int"))
    return rows.withColumn("strand", strand).withColumn("flipped", flipped).withColumn("x", x).select("*", "x.*").drop("x")


def _inserted(t_row: str, t_beg: int) -> dict[int, int]:
    """Number of inserted columns before each place of the target that has some."""
    out: dict[int, int] = {}
    at = t_beg
    for c in t_row:
        if c == "-":
            out[at] = out.get(at, 0) + 1
        else:
            at += 1
    return out


def layout_line(t_beg: int, q_row: str, t_row: str, widths: dict[int, int]) -> str:
    """The row of a layout from its first to its last column; inserted columns of others are '-', its own come first in theirs."""
    out, at, n = [], t_beg, 0
    for q, t in zip(q_row, t_row):
        if t == "-":
            n += 1
        else:
            out.append("-" * (widths.get(at, 0) - n))
            at, n = at + 1, 0
        out.append(q)
    return "".join(out)


def layout(alignments: DataFrame) -> DataFrame:
    """(target, row, offset, line): alignments(target, row, t_beg, q_aligned, t_aligned) under each other, with a column for each base of the target and for each inserted one.

    `offset` is the column that the line begins in. Widths of inserted columns meet
    the rows by blocks of the target, so a row needs those of its own stretch only.
    """
    ins = T.ArrayType(T.StructType([T.StructField("p", T.IntegerType()), T.StructField("n", T.IntegerType())]))

    @F.pandas_udf(T.BinaryType())
    def gaps(rows: pd.Series) -> pd.Series:
        return pd.Series([np.packbits(np.frombuffer(r.encode("latin-1", "replace"), np.uint8) == ord("-")).tobytes() for r in rows])

    def gap_row(bits: bytes, n: int) -> str:
        return (np.unpackbits(np.frombuffer(bits, np.uint8), count=n) * ord("-")).tobytes().decode("latin-1")

    @F.pandas_udf(ins)
    def places(rows: pd.Series, sizes: pd.Series, begs: pd.Series) -> pd.Series:
        return pd.Series([[{"p": p, "n": n} for p, n in _inserted(gap_row(r, n), b).items()] for r, n, b in zip(rows, sizes, begs)])

    @F.pandas_udf(T.StringType())
    def lines(begs: pd.Series, q: pd.Series, t: pd.Series, sizes: pd.Series, widths: pd.Series) -> pd.Series:
        return pd.Series([layout_line(b, x, gap_row(y, n), {w["p"]: w["w"] for w in ws}) for b, x, y, n, ws in zip(begs, q, t, sizes, widths)])

    # of the target's row only the places of its gaps are kept, a bit for each column
    made = alignments.select("target", "row", F.col("t_beg").cast("int").alias("t_beg"), "q_aligned", "t_aligned").dropna()
    rows = stored(made.select("target", "row", "t_beg", "q_aligned", F.length("t_aligned").alias("size"), F.length(F.translate("t_aligned", "-", "")).alias("bases"), gaps("t_aligned").alias("gaps")), "zstd")
    bases = F.col("bases")
    block = F.floor(F.col("p") / _BLOCK)
    covered = rows.select("target", "row", F.explode(F.sequence(F.floor(F.col("t_beg") / _BLOCK), F.floor((F.col("t_beg") + bases) / _BLOCK))).alias("block"))
    width = rows.select("target", F.explode(places("gaps", "size", "t_beg")).alias("x")).select("target", "x.*").groupBy("target", "p").agg(F.max("n").alias("w"))
    of_block = width.groupBy("target", block.alias("block")).agg(F.collect_list(F.struct("p", "w")).alias("ws"), F.sum("w").alias("s"))
    order = Window.partitionBy("target").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = covered.select("target", "block").distinct().join(of_block, ["target", "block"], "left").withColumn("before", F.coalesce(F.sum("s").over(order), F.lit(0)))
    own = covered.join(blocks, ["target", "block"]).groupBy("target", "row").agg(F.flatten(F.collect_list("ws")).alias("ws"), F.min("before").alias("before"))
    ahead = F.expr("aggregate(filter(ws, x -> x.p < t_beg), 0L, (s, x) -> s + x.w)")
    return rows.join(own, ["target", "row"]).select("target", "row", (F.col("t_beg") + F.col("before") + ahead).alias("offset"), lines("t_beg", "q_aligned", "gaps", "size", "ws").alias("line"))


def pair_lines(target: str, others: Iterable[str]) -> list[str]:
    """The lines of layout() of sequences that are each aligned to the whole target."""
    rows, widths = [], np.zeros(len(target) - target.count("-") + 1, np.int64)
    for x in others:
        t, q = gapped_rows(target, x)
        bases = np.frombuffer(t.encode("latin-1", "replace"), np.uint8) != ord("-")
        own = np.diff(np.flatnonzero(bases), prepend=-1, append=len(bases)) - 1  # inserted columns before each base, and behind the last
        np.maximum(widths, own, out=widths)
        rows.append((q, np.packbits(bases)))
    out = []
    for q, bits in rows:
        bases = np.unpackbits(bits, count=len(q)).astype(bool)
        own = np.diff(np.flatnonzero(bases), prepend=-1, append=len(bases)) - 1
        moved = np.r_[0, np.cumsum((widths - own)[:-1])]
        columns = np.arange(len(q)) + moved[np.cumsum(bases)]
        line = np.full(columns[-1] + 1 if len(q) else 0, ord("-"), "<u4")
        line[columns] = np.frombuffer(q.encode("utf-32-le"), "<u4")
        out.append(line.tobytes().decode("utf-32-le"))
    return out


def pair_layout(pairs: DataFrame) -> DataFrame:
    """(target, row, offset, line): layout() of pairs(base, neighbour, s1, s2), s2 aligned to the whole of s1, with all rows of a target made in one task.

    Neither aligned rows nor widths are stored or moved. A target is held whole, so
    its rows must be bounded, as those of reads are by their kt-mers.
    """

    def made(x: pa.Table) -> pa.Table:
        lines = pair_lines(x["s1"][0].as_py(), (y.as_py() for y in x["s2"]))
        return pa.table({"target": x["base"], "row": x["neighbour"], "offset": pa.array(np.zeros(len(lines), np.int64)), "line": pa.array(lines, pa.string())})

    kinds = dict(pairs.dtypes)
    return pairs.select("base", "neighbour", "s1", "s2").dropna().groupBy("base").applyInArrow(made, f"target {kinds['base']}, row {kinds['neighbour']}, offset bigint, line string")


def merge_by_place(contigs: DataFrame, ktmers: DataFrame, k: int, most: int, width: int = 1000, most_rounds: int = 30) -> DataFrame:
    """contigs(id, beg, end, seq) merged where one's end overlaps another's begin by at most `most`, until none does; those inside others are dropped.

    In a round each contig is joined to the one it overlaps most, ties by the least id,
    if that one's choice is the same; chains of such joints are merged at once, under
    the id of their first. The overlap is taken from the contig whose own k-mer at the
    joint has the higher t in ktmers(kmer, t, degree; one row a k-mer), then the higher
    degree, then from the right one; a k-mer that isn't listed counts 0.
    """
    now = stored(contigs.select("id", "beg", "end", "seq").dropna())
    known = broadcast_if_small(stored(ktmers.select("kmer", F.struct(F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("degree", F.lit(0)).alias("d")).alias("w"))))
    none = F.struct(F.lit(0).alias("t"), F.lit(0).alias("d"))
    for _ in range(most_rounds):
        now = stored(not_contained(now, width))
        found = stored(range_overlaps(now, width).filter(F.col("overlap") <= most))
        right = found.groupBy("a").agg(F.max_by(F.struct("b", "overlap"), F.struct("overlap", -F.col("b"))).alias("x")).select("a", "x.*")
        left = found.groupBy("b").agg(F.max_by("a", F.struct("overlap", -F.col("a"))).alias("a"))
        joints = stored(right.join(left, ["a", "b"]))
        if joints.isEmpty():
            return now
        for x, kmer in (("a", F.right("seq", F.lit(k))), ("b", F.left("seq", F.lit(k)))):
            ends = now.select(F.col("id").alias(x), kmer.alias("kmer")).join(known, "kmer", "left").select(x, F.coalesce("w", none).alias(f"w_{x}"))
            joints = joints.join(ends, x)
        joints = stored(joints.select("a", "b", F.col("overlap").cast("int").alias("overlap"), (F.col("w_a") > F.col("w_b")).alias("of_a")))
        chain = graph.unitigs(joints.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        every = now.join(chain.withColumnRenamed("node", "id"), "id", "left")
        every = every.join(joints.select(F.col("b").alias("id"), F.when(F.col("of_a"), F.col("overlap")).otherwise(0).alias("cut")), "id", "left")
        every = every.join(joints.select(F.col("a").alias("id"), F.when(F.col("of_a"), 0).otherwise(F.col("overlap")).alias("back")), "id", "left")
        piece = F.expr("substring(seq, coalesce(cut, 0) + 1, greatest(length(seq) - coalesce(cut, 0) - coalesce(back, 0), 0))")
        rows = every.select(F.coalesce("unitig", "id").alias("id"), "beg", "end", F.struct(F.coalesce("ord", F.lit(0)).alias("ord"), piece.alias("piece")).alias("x"))
        merged = rows.groupBy("id").agg(F.min("beg").alias("beg"), F.max("end").alias("end"), F.array_sort(F.collect_list("x")).alias("l"))
        now = stored(merged.select("id", "beg", "end", F.array_join(F.col("l.piece"), "").alias("seq")))
    raise RuntimeError(f"overlaps are left after {most_rounds} rounds")
