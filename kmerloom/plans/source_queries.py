"""Queries that write the given tables in the domain's formats and read them again; simulation; streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators import graph, nhood, simulate
from kmerloom.operators.kmers import headers_index
from kmerloom.plans import common
from kmerloom.plans.registry import Registry
from kmerloom.plans.sql import CONTIGS, CREADS, READS, kmers
from kmerloom.session import one_row_per_key, shared_dir, table
from kmerloom.sources import readers, writers
from kmerloom.streaming import counts

REG = Registry()


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


@REG.query("fasta_round_trip", f"WITH {READS} SELECT read_id AS header, seq FROM reads")
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    writers.write_fasta(common.reads(spark, sf_dir), path, "read_id", "seq")
    return readers.read_fasta(spark, path)


@REG.query("fastq_round_trip", f"WITH {READS} SELECT read_id AS header, seq, repeat('I', len) AS qual FROM reads")
def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    writers.write_fastq(common.reads(spark, sf_dir).select(F.col("read_id").alias("header"), "seq", F.expr("repeat('I', len)").alias("qual")), path)
    return readers.read_fastq(spark, path)


@REG.query("creads_round_trip", "WITH one AS (SELECT read_idx, any_value(list_filter(ktmers, lambda x: x IS NOT NULL)) AS k, any_value(ktmers) AS o, any_value(dists) AS d FROM creads WHERE read_idx IS NOT NULL GROUP BY read_idx) SELECT k AS ktmers, d AS dists, count(*) AS n FROM one WHERE o IS NOT NULL AND len(k) = len(o) AND d IS NOT NULL GROUP BY ALL")
def creads_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creads without null members, written as lines and read again, with how often each occurs."""
    rows = one_row_per_key(table(spark, sf_dir, "creads").select("read_idx", "ktmers", "dists"), "read_idx").filter("ktmers is not null and dists is not null and not exists(ktmers, x -> x is null)")
    path = _place(spark)
    writers.write_creads(rows, path)
    return readers.read_creads(spark, path).groupBy("ktmers", "dists").agg(F.count("*").alias("n"))


@REG.query("index_round_trip", f"WITH {CREADS} SELECT DISTINCT kmer, read_id FROM cr")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    writers.write_headers_index(headers_index(common.creads(spark, sf_dir)), path)
    return readers.read_headers_index(spark, path)


@REG.query("edges_round_trip", "SELECT src, ktmers[i] AS dst, dists[i] AS dist FROM (SELECT *, unnest(range(1, len(ktmers) + 1)) AS i FROM (SELECT src, any_value(ktmers) AS ktmers, any_value(dists) AS dists FROM ktmer_edges WHERE src IS NOT NULL GROUP BY src)) WHERE ktmers[i] IS NOT NULL")
def edges_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    writers.write_edges(nhood.long_edges(table(spark, sf_dir, "ktmer_edges")), path)
    return readers.read_edges(spark, path)


@REG.query("m1_round_trip", "SELECT DISTINCT consensus AS q_name, regexp_replace(header, '^>', '') AS t_name, score, nh_beg AS t_beg, ec_end AS q_end FROM alignments WHERE score IS NOT NULL AND nh_beg IS NOT NULL AND header IS NOT NULL AND consensus IS NOT NULL AND ec_end IS NOT NULL")
def m1_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments as lines of 13 tokens and back."""
    path = _place(spark)
    rows = table(spark, sf_dir, "alignments").filter("score is not null and nh_beg is not null and header is not null and consensus is not null and ec_end is not null")
    cols = ["consensus", "header", "q_strand", "t_strand", "score", "accuracy", "nh_beg", "nh_end", "t_len", "ec_beg", "ec_end", "ec_len"]
    line = F.concat_ws(" ", *[F.coalesce((F.regexp_replace(c, "^>", "") if c == "header" else F.col(c)).cast("string"), F.lit("-")) for c in cols], F.lit("0"))
    rows.select(line).write.text(path)
    return readers.read_m1(spark, path).select("q_name", "t_name", "score", "t_beg", "q_end").distinct()


@REG.query("report_round_trip", "SELECT DISTINCT upper(kmer) AS kmer, degree, t, correct FROM ktmers WHERE kmer IS NOT NULL AND degree IS NOT NULL AND t IS NOT NULL AND correct IS NOT NULL")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    rows = table(spark, sf_dir, "ktmers").filter("kmer is not null and degree is not null and t is not null and correct is not null")
    rows.select(F.format_string("%s Deg = %d t = %d %s pos = %s", F.upper("kmer"), "degree", "t", F.when(F.col("correct"), "correct").otherwise("incorrect"), F.coalesce(F.col("pos_mean").cast("string"), F.lit("-")))).write.text(path)
    return readers.read_kmer_report(spark, path).select("kmer", "degree", "t", "correct").distinct()


@REG.query("nhood_index_round_trip", f"WITH {CREADS}, ud AS (SELECT DISTINCT kmer, read_idx FROM cr WHERE kmer IN (SELECT kmer FROM cr GROUP BY kmer HAVING count(DISTINCT read_idx) <= 55)) SELECT DISTINCT a.read_idx AS base, b.read_idx AS neighbour FROM ud a JOIN ud b ON a.kmer = b.kmer AND a.read_idx <> b.read_idx")
def nhood_index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    writers.write_nhood_index(nhood.neighbours(common.creads(spark, sf_dir), 55), path)
    return readers.read_truth(spark, path)


@REG.query("consensus_names", "SELECT DISTINCT consensus, CAST(regexp_extract(consensus, 'nh(\\d+)_', 1) AS BIGINT) AS pos, regexp_extract(consensus, 'nh\\d+_([ACGTacgt]+)', 1) AS kmer FROM alignments WHERE consensus IS NOT NULL")
def consensus_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "alignments").filter("consensus is not null").select("consensus", *readers.nhood_name(F.col("consensus"))).distinct()


@REG.query("dot_lines")
def dot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a drawing of the graph of successive kt-mers; kt-mers marked correct are black."""
    e = graph.a_bruijn(nhood.usable(common.creads(spark, sf_dir), 55)).filter("src <> 'head'").select("src", "dst").distinct()
    right = table(spark, sf_dir, "ktmers").filter("correct and kmer is not null").select(F.upper("kmer").alias("node"))
    return writers.dot_lines(e, right)


@REG.query("tiled_reads", f"""WITH {READS}, {CONTIGS}, p AS (SELECT contig, seq, len, CAST(i AS INT) AS i, CAST(i * len // 4 AS INT) AS b FROM contigs, (SELECT unnest(range(4)) AS i)), q AS (SELECT *, b + least(1000, len) AS e FROM p)
SELECT contig, i, CASE WHEN e <= len THEN '' ELSE 'a' END AS half, b AS beg, CAST(least(e, len) AS INT) AS "end", substr(seq, b + 1, least(e, len) - b) AS seq FROM q
UNION ALL SELECT contig, i, 'b', 0, CAST(e - len AS INT), substr(seq, 1, e - len) FROM q WHERE e > len""")
def tiled_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four reads of 1000 bases tiled over each contig, as over a circle."""
    return simulate.tiled_reads(common.contigs(spark, sf_dir), 1000, 4)


@REG.query("noisy_reads")
def noisy_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.with_errors(simulate.tiled_reads(common.contigs(spark, sf_dir), 1000, 4), ["contig", "i", "half"])


@REG.query("down_sampled")
def down_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbourhoods thinned in steps of five reads."""
    return simulate.down_sampled(nhood.neighbours(common.creads(spark, sf_dir), 55), "base", "neighbour").groupBy("base", "size").agg(F.count("*").alias("n"))


@REG.query("stream_kmer_counts", f"WITH {READS}, one AS (SELECT read_idx, any_value(upper(seq)) AS seq FROM fasta_reads WHERE seq IS NOT NULL AND read_idx IS NOT NULL GROUP BY read_idx), {kmers(9, 'one')} SELECT kmer, count(*) AS t FROM km GROUP BY kmer")
def stream_kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """9-mers counted over a stream of the reads' files; reads sent again are dropped on the way."""
    like = table(spark, sf_dir, "fasta_reads")
    stream = spark.readStream.schema(like.schema).parquet(f"{sf_dir}/fasta_reads.parquet*")
    once = counts.reads_once(stream, "3650 days")
    path = _place(spark)
    counts.last_counts(counts.kmer_counts(once, 9), path, f"{path}-state")
    written = spark.read.parquet(path)
    last = written.agg(F.max("batch").alias("batch"))
    return written.join(F.broadcast(last), "batch").select("kmer", "t")  # one row
