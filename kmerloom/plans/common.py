"""DataFrames that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators import kmers
from kmerloom.plans.sql import CONTIG_LEN
from kmerloom.session import table


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.reads_of(table(spark, sf_dir, "fasta_reads")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads long enough to stand for a genome: (contig, seq, len)."""
    return reads(spark, sf_dir).filter(F.col("len") > CONTIG_LEN).select(F.col("read_idx").alias("contig"), "seq", "len")


def creads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.long_creads(table(spark, sf_dir, "creads"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ktmers").filter("kmer is not null").select(F.upper("kmer").alias("kmer")).distinct()
