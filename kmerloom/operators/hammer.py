"""Degrees of k-mers by their neighbours one indel away, and choices among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.dna import hamming, indel_neighbours, kmer_rows_of, proper_deletions, proper_insertions
from kmerloom.session import stored


def degrees(reads: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    """(kmer, degree): occurrences in the reads of the (k-1)- and (k+1)-mers one proper indel away."""
    counts = kmer_rows_of(reads, "seq", [k - 1, k + 1]).groupBy("kmer").agg(F.count("*").alias("t"))
    variants = kmers.select("kmer", F.explode(F.concat(proper_deletions("kmer"), proper_insertions("kmer"))).alias("variant"))
    hits = variants.join(counts.withColumnRenamed("kmer", "variant"), "variant").groupBy("kmer").agg(F.sum("t").alias("degree"))
    return kmers.select("kmer").join(hits, "kmer", "left").select("kmer", F.coalesce("degree", F.lit(0)).alias("degree"))


def top_by_degree(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of highest degree, ties by k-mer; n = -1 gives all."""
    ordered = rows.orderBy(F.desc("degree"), "kmer")
    return ordered if n == -1 else ordered.limit(n)


def top_with_ties(rows: DataFrame, n: int) -> DataFrame:
    """Rows whose degree is at least the n-th highest one."""
    least = rows.orderBy(F.desc("degree")).limit(n).agg(F.min("degree").alias("least"))
    return rows.join(F.broadcast(least), F.col("degree") >= F.col("least")).drop("least")  # one row


def neighbour_pairs(kmers: DataFrame) -> DataFrame:
    """(kmer, neighbour): pairs of given k-mers of one length that are a deletion and an insertion apart."""
    own = kmers.select("kmer").distinct()
    return own.select("kmer", F.explode(indel_neighbours("kmer")).alias("neighbour")).join(own.withColumnRenamed("kmer", "neighbour"), "neighbour", "left_semi").select("kmer", "neighbour")


def independent(rows: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Greedy choice: by degree (ties by k-mer) keep a k-mer and drop its neighbours.

    rows(kmer, degree), edges(kmer, neighbour) in both directions. A round keeps
    every k-mer that beats its undecided neighbours and drops theirs, which gives
    what the one-by-one order gives; rounds end when nothing is undecided.
    """
    ranked = rows.select("kmer", F.struct(F.col("degree"), F.col("kmer").alias("name")).alias("r"))
    left = stored(ranked)
    kept = None
    link = stored(edges.select("kmer", "neighbour").distinct())
    for _ in range(most_rounds):
        n = left.select("kmer", "r")
        rivals = link.join(n, "kmer").join(n.select(F.col("kmer").alias("neighbour"), F.col("r").alias("r2")), "neighbour")
        # a higher degree wins, then the smaller k-mer
        beaten = rivals.filter("r2.degree > r.degree or (r2.degree = r.degree and neighbour < kmer)").select("kmer").distinct()
        won = stored(n.join(beaten, "kmer", "left_anti"))
        kept = won if kept is None else kept.unionByName(won)
        lost = link.join(won.select("kmer"), "kmer", "left_semi").select(F.col("neighbour").alias("kmer"))
        left = stored(n.join(won.select("kmer").unionByName(lost), "kmer", "left_anti"))
        if left.isEmpty():
            return kept.select("kmer", "r.degree")
    raise RuntimeError(f"not settled after {most_rounds} rounds")


def split_scores(scores: DataFrame, group: str, score: str) -> DataFrame:
    """(group, n_top, n_rest): the cut of the descending scores into two parts with the least sum of deviations (of the population)."""
    down = Window.partitionBy(group).orderBy(F.desc(score), "id")
    up = down.rowsBetween(1, Window.unboundedFollowing)
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    s = F.col(score).cast("double")
    cuts = scores.select(group, F.row_number().over(down).alias("n_top"), F.count("*").over(Window.partitionBy(group)).alias("n"), (F.stddev_pop(s).over(upto) + F.stddev_pop(s).over(up)).alias("spread"))
    return cuts.filter("n_top < n").groupBy(group).agg(F.min(F.struct(F.round("spread", 9).alias("spread"), "n_top", "n")).alias("b")).select(group, "b.n_top", (F.col("b.n") - F.col("b.n_top")).alias("n_rest"))


def hamming_pairs(kmers: DataFrame, kmer: str, most: int) -> DataFrame:
    """(a, b, distance), a < b: distinct k-mers of equal length that differ in `most` places or fewer.

    Cut into most + 1 pieces, two such k-mers agree in one of them at the same place,
    so they are joined on each piece and then compared; null k-mers have no neighbour.
    """
    n = F.length("a")
    begin = lambda i: F.floor(n * i / (most + 1)).cast("int")
    pieces = F.array(*[F.struct(F.lit(i).alias("i"), F.substr(F.col("a"), begin(i) + 1, begin(i + 1) - begin(i)).alias("x")) for i in range(most + 1)])
    own = kmers.filter(F.col(kmer).isNotNull()).select(F.col(kmer).alias("a")).distinct().select("a", n.alias("n"), F.explode(pieces).alias("p")).select("a", "n", "p.i", "p.x")
    both = own.join(own.withColumnRenamed("a", "b"), ["n", "i", "x"]).filter("a < b").select("a", "b").distinct()
    return both.withColumn("distance", hamming("a", "b")).filter(F.col("distance") <= most)
