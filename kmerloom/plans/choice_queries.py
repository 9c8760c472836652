"""Queries that choose: edges within a window, extensions of k-mers, reads by length or header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.functions.dna import kmer_rows
from kmerloom.operators import nhood
from kmerloom.plans import common
from kmerloom.plans.nhood_queries import _EDGES
from kmerloom.plans.registry import Registry
from kmerloom.plans.sql import CREADS, READS, kmers
from kmerloom.session import table

REG = Registry()


@REG.query("long_reads", f"WITH {READS} SELECT read_idx, read_id, len FROM reads WHERE len > 1000")
def long_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.reads(spark, sf_dir).filter("len > 1000").select("read_idx", "read_id", "len")


@REG.query("longest_read", f"WITH {READS} SELECT read_idx, len FROM reads ORDER BY len DESC, read_idx LIMIT 1")
def longest_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.reads(spark, sf_dir).select("read_idx", "len").orderBy(F.desc("len"), "read_idx").limit(1)


_STEM = "regexp_extract({0}, '^>?([^/]*/[^/]*)', 1)"


@REG.query(
    "header_prefixes",
    f"""WITH a AS (SELECT DISTINCT {_STEM.format('header')} AS stem FROM fasta_reads WHERE header IS NOT NULL), b AS (SELECT DISTINCT {_STEM.format('header')} AS stem FROM alignments WHERE header IS NOT NULL)
SELECT coalesce(a.stem, b.stem) AS stem, CASE WHEN a.stem IS NULL THEN 'missing' WHEN b.stem IS NULL THEN 'not in' ELSE 'in' END AS state FROM a FULL JOIN b ON a.stem = b.stem""",
)
def header_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two fields of read headers: in the alignments, not in them, or missing among the reads."""
    stem = F.regexp_extract("header", "^>?([^/]*/[^/]*)", 1).alias("stem")
    a = table(spark, sf_dir, "fasta_reads").filter("header is not null").select(stem).distinct().withColumn("a", F.lit(1))
    b = table(spark, sf_dir, "alignments").filter("header is not null").select(stem).distinct().withColumn("b", F.lit(1))
    return a.join(b, "stem", "full").select("stem", F.when(F.isnull("a"), "missing").when(F.isnull("b"), "not in").otherwise("in").alias("state"))


_WINDOW = f"""{CREADS}, l AS (SELECT kmer, read_idx, max(pos) AS pos, max(len) AS len FROM cr GROUP BY ALL
), dt AS (SELECT kmer FROM l GROUP BY kmer HAVING count(*) FILTER (len - pos > 500) >= 3
), dg AS (SELECT upper(kmer) AS kmer, max(coalesce(degree, 0)) AS degree FROM ktmers WHERE kmer IS NOT NULL GROUP BY 1
), {_EDGES}, w AS (SELECT src, dst, dist, degree FROM ed JOIN dg ON dg.kmer = dst WHERE dist BETWEEN 20 AND 400 AND dst IN (SELECT kmer FROM dt))"""


def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges forward by 20 to 400 bases to a kt-mer that passes the direction test, with its degree."""
    forward = nhood.direction_test(common.creads(spark, sf_dir)).filter("forward").select(F.col("kmer").alias("dst"))
    degree = table(spark, sf_dir, "ktmers").filter("kmer is not null").groupBy(F.upper("kmer").alias("dst")).agg(F.max(F.coalesce("degree", F.lit(0))).alias("degree"))
    edges = nhood.long_edges(table(spark, sf_dir, "ktmer_edges")).filter("dist between 20 and 400")
    return edges.join(degree, "dst").join(forward, "dst", "left_semi").select("src", "dst", "dist", "degree")


@REG.query("best_edges", f"WITH {_WINDOW} SELECT src, dst, dist, degree FROM w QUALIFY row_number() OVER (PARTITION BY src ORDER BY degree DESC, dst, dist) = 1")
def best_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge of each kt-mer to the neighbour of highest degree; ties by name."""
    order = Window.partitionBy("src").orderBy(F.desc("degree"), "dst", "dist")
    return _window(spark, sf_dir).withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


@REG.query("random_edges")
def random_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge of each kt-mer within the window, drawn by a hash."""
    return _window(spark, sf_dir).groupBy("src").agg(F.min_by(F.struct("dst", "dist"), F.xxhash64("src", "dst", "dist", F.lit(1))).alias("e")).select("src", "e.dst", "e.dist")


@REG.query("extension_counts", f"WITH {READS}, {kmers(12)}, c AS (SELECT kmer, count(*) AS t FROM km GROUP BY kmer HAVING count(*) >= 3) SELECT left(kmer, 11) AS prefix, right(kmer, 1) AS base, t FROM c QUALIFY row_number() OVER (PARTITION BY left(kmer, 11) ORDER BY t DESC, right(kmer, 1)) = 1")
def extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent next base of each 11-mer, ties by base."""
    counts = kmer_rows(common.reads(spark, sf_dir), "seq", 12).groupBy("kmer").agg(F.count("*").alias("t")).filter("t >= 3")
    best = counts.groupBy(F.substring("kmer", 1, 11).alias("prefix")).agg(F.min(F.struct((-F.col("t")).alias("m"), F.right("kmer", F.lit(1)).alias("base"))).alias("b"))
    return best.select("prefix", "b.base", (-F.col("b.m")).alias("t"))


@REG.query(
    "last_inside",
    """WITH c AS (SELECT DISTINCT consensus, regexp_extract(consensus, '_([ACGTacgt]+)\\.', 1) AS kmer, any_value(ec_len) OVER (PARTITION BY consensus) AS x FROM alignments WHERE consensus IS NOT NULL
), r AS (SELECT read_idx, upper(any_value(seq)) AS seq FROM fasta_reads WHERE read_idx IS NOT NULL AND length(seq) > 0 GROUP BY read_idx
), k AS (SELECT read_idx, p AS pos, substr(seq, p + 1, 18) AS kmer FROM (SELECT read_idx, seq, unnest(range(CAST(length(seq) AS BIGINT) - 17)) AS p FROM r WHERE length(seq) >= 18)), d AS (SELECT DISTINCT kmer FROM c)
SELECT read_idx, max(pos) AS pos, arg_max(kmer, pos) AS kmer FROM k WHERE pos > 0 AND kmer IN (SELECT kmer FROM d) GROUP BY read_idx""",
)
def last_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The farthest kt-mer inside each read, beyond its begin, that a consensus is named after."""
    named = table(spark, sf_dir, "alignments").select(F.regexp_extract("consensus", r"_([ACGTacgt]+)\.", 1).alias("kmer")).distinct()
    rows = kmer_rows(common.reads(spark, sf_dir), "seq", 18, "read_idx").filter("pos > 0").join(named, "kmer", "left_semi")
    return rows.groupBy("read_idx").agg(F.max("pos").alias("pos"), F.max_by("kmer", "pos").alias("kmer"))
