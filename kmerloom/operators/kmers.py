"""Counting and choosing k-mers; re-encoding reads as ordered kt-mers (creads)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.dna import is_low_complexity, is_palindrome, kmer_rows, kmer_rows_of, read_id
from kmerloom.session import broadcast_if_small, one_row_per_key, stored


def reads_of(fasta: DataFrame, key: str = "read_idx") -> DataFrame:
    """(read_idx, read_id, seq, len): one row for each read, upper case; null and empty sequences left out."""
    rows = one_row_per_key(fasta.select(key, "header", "seq"), key).filter("length(seq) > 0")
    return rows.select(F.col(key).alias("read_idx"), read_id("header").alias("read_id"), F.upper("seq").alias("seq"), F.length("seq").alias("len"))


def kmer_counts(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, t): occurrences over all reads. Counted before the shuffle, so frequent k-mers don't skew it."""
    return kmer_rows(reads, seq, k).groupBy("kmer").agg(F.count("*").alias("t"))


def multi_k_counts(reads: DataFrame, ks: list[int]) -> DataFrame:
    """(k, kmer, t) for several k in one pass."""
    return kmer_rows_of(reads, "seq", ks).groupBy("k", "kmer").agg(F.count("*").alias("t"))


def choose_ktmers(counts: DataFrame, t_min: int, t_max: int | None = None, palindromes: bool = False, low_complexity: bool = False) -> DataFrame:
    """Counts from t_min to t_max; palindromes and k-mers of nearly one base are dropped unless allowed, each k-mer by itself."""
    bound = F.col("t") >= t_min
    if t_max is not None:
        bound = bound & (F.col("t") <= t_max)
    dropped = F.lit(False)
    if not palindromes:
        dropped = dropped | is_palindrome("kmer")
    if not low_complexity:
        dropped = dropped | is_low_complexity("kmer")
    # one condition that hangs on the count: by itself the test of the k-mer would be pushed below the count and run for every occurrence
    out = counts.filter(F.when(bound, ~dropped).otherwise(False))
    return out


def gapped_counts(reads: DataFrame, k: int, gap: int, t_min: int = 1) -> DataFrame:
    """(k1, k2, t): pairs of k-mers with `gap` bases between them, by one pass over words of 2k + gap."""
    words = kmer_rows(reads, "seq", 2 * k + gap)
    pair = words.select(F.substring("kmer", 1, k).alias("k1"), F.substring("kmer", k + gap + 1, k).alias("k2"))
    return pair.groupBy("k1", "k2").agg(F.count("*").alias("t")).filter(F.col("t") >= t_min)


def gapped_overlaps(gapped: DataFrame, ktmers: DataFrame, k: int) -> DataFrame:
    """(k1, k2, kmer): gapped pairs whose k1 begins a 2k-mer and whose k2 but its last base ends it, as an equi-join."""
    ends = ktmers.select("kmer", F.substring("kmer", 1, k).alias("k1"), F.right("kmer", F.lit(k - 1)).alias("k2_head"))
    return gapped.withColumn("k2_head", F.substring("k2", 1, k - 1)).join(ends, ["k1", "k2_head"]).select("k1", "k2", "kmer")


def read_libraries(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, read_idx, n): occurrences of each k-mer in each read."""
    return kmer_rows(reads, "seq", k, "read_idx").groupBy("kmer", "read_idx").agg(F.count("*").alias("n"))


def encode_reads(reads: DataFrame, ktmers: DataFrame, k: int) -> DataFrame:
    """Long creads (read_idx, ord, kmer, pos, gap): the kt-mers of each read in order.

    gap is the distance from the kt-mer before, from the read's begin for the first.
    """
    hits = kmer_rows(reads, "seq", k, "read_idx").join(broadcast_if_small(stored(ktmers.select("kmer"))), "kmer", "left_semi")
    order = Window.partitionBy("read_idx").orderBy("pos")
    return hits.select("read_idx", (F.row_number().over(order) - 1).alias("ord"), "kmer", "pos", (F.col("pos") - F.lag("pos", 1, 0).over(order)).alias("gap"))


def cread_lines(reads: DataFrame, creads: DataFrame, k: int) -> DataFrame:
    """(read_idx, ktmers, dists): dists has one member more and sums to the read's length (k - 1 for reads shorter than k)."""
    lists = creads.groupBy("read_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "kmer", "gap"))).alias("l"))
    length = F.when(F.col("len") >= k, F.col("len")).otherwise(k - 1)
    last = length - F.coalesce(F.element_at("l", -1)["pos"], F.lit(0))
    return reads.join(lists, "read_idx", "left").withColumn("l", F.coalesce("l", F.expr("cast(array() as array<struct<pos:int,kmer:string,gap:int>>)"))).select(
        "read_idx", F.col("l.kmer").alias("ktmers"), F.concat(F.col("l.gap"), F.array(F.when(F.size("l") > 0, last).otherwise(length))).alias("dists")
    )


def long_creads(creads: DataFrame) -> DataFrame:
    """(read_idx, read_id, ord, kmer, pos, len) from rows with lists; positions are sums of distances, null members are dropped."""
    rows = one_row_per_key(creads.select("read_idx", "read_id", "ktmers", "dists"), "read_idx").filter("ktmers is not null")
    placed = rows.select(
        "read_idx",
        F.regexp_replace("read_id", "^>", "").alias("read_id"),
        F.aggregate("dists", F.lit(0), lambda s, x: s + x).alias("len"),
        F.posexplode("ktmers").alias("ord", "kmer"),
        "dists",
    )
    upto = F.aggregate(F.slice("dists", 1, F.col("ord") + 1), F.lit(0), lambda s, x: s + x)
    return placed.filter("kmer is not null").select("read_idx", "read_id", "ord", "kmer", upto.alias("pos"), "len")


def headers_index(creads: DataFrame) -> DataFrame:
    """(kmer, read_ids): the distinct reads that hold each kt-mer, in order."""
    return creads.groupBy("kmer").agg(F.array_sort(F.collect_set("read_id")).alias("read_ids"))


def members_of(headers: DataFrame) -> DataFrame:
    """(kmer, read_id) from an index with lists: members cleaned of a leading '>', null ones dropped; they can repeat."""
    return headers.select("kmer", F.explode("headers").alias("h")).filter("h is not null and kmer is not null").select("kmer", F.regexp_replace("h", "^>", "").alias("read_id"))


def postings_of(headers: DataFrame) -> DataFrame:
    """The different rows of members_of()."""
    return members_of(headers).distinct()


def ktmers_per_read(reads: DataFrame, creads: DataFrame) -> DataFrame:
    """(read_idx, n_ktmers), 0 for reads without one."""
    return reads.select("read_idx").join(creads.groupBy("read_idx").agg(F.count("*").alias("n")), "read_idx", "left").select("read_idx", F.coalesce("n", F.lit(0)).alias("n_ktmers"))


def read_length_stats(reads: DataFrame) -> DataFrame:
    """(n_reads, total_bases, mean_len, std_len), the deviation of the population."""
    return reads.agg(F.count("*").alias("n_reads"), F.sum("len").alias("total_bases"), F.avg("len").alias("mean_len"), F.stddev_pop("len").alias("std_len"))


def homopolymer_windows(reads: DataFrame, least: int = 5) -> DataFrame:
    """(size, n_windows): stretches of `size` equal bases at every offset, size >= least; a run of length L has L - size + 1."""
    runs = reads.select(F.explode(F.regexp_extract_all("seq", F.lit("(A+|C+|G+|T+)"), 1)).alias("run")).filter(F.length("run") >= least)
    lengths = runs.groupBy(F.length("run").alias("l")).agg(F.count("*").alias("n"))
    return lengths.select(F.explode(F.sequence(F.lit(least), F.col("l"))).alias("size"), "l", "n").groupBy("size").agg(F.sum((F.col("l") - F.col("size") + 1) * F.col("n")).alias("n_windows"))


def genome_gaps(positions: DataFrame, contig: str = "contig", pos: str = "pos", length: str = "len") -> DataFrame:
    """(contig, pos, gap): distance from the kt-mer before (1-based for the first), and the rest behind the last as a row with null pos."""
    order = Window.partitionBy(contig).orderBy(pos)
    rows = positions.select(contig, pos, (F.col(pos) - F.coalesce(F.lag(pos).over(order), F.lit(-1))).alias("gap"))
    tail = positions.groupBy(contig).agg((F.max(length) - F.max(pos) - 1).alias("gap")).select(contig, F.lit(None).cast("int").alias(pos), "gap")
    return rows.unionByName(tail)


def blind_spots(positions: DataFrame, width: int, contig: str = "contig", pos: str = "pos") -> DataFrame:
    """(contig, beg, end): gaps of at least `width` without a kt-mer, shrunk by half of it at both ends; what follows the last one isn't looked at."""
    order = Window.partitionBy(contig).orderBy(pos)
    prev = F.lag(pos, 1, 0).over(order)
    half = width // 2
    return positions.select(contig, (prev + half).alias("beg"), (F.col(pos) - half).alias("end"), (F.col(pos) - prev).alias("gap")).filter(F.col("gap") >= width).select(contig, "beg", "end")
