"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.words import word_counts
from kmerloom.plans.registry import Registry
from kmerloom.session import one_row_per_key, table

REG = Registry()
K = 18
RARE_BELOW = 3
COMMON_ABOVE_PERCENT = 8

_WORDS = f"""one AS (SELECT read_idx, upper(any_value(seq)) AS s FROM fasta_reads WHERE seq IS NOT NULL AND read_idx IS NOT NULL GROUP BY read_idx
), w AS (SELECT read_idx, substr(s, CAST(p AS BIGINT), {K}) AS word FROM (
  SELECT read_idx, s, unnest(range(1, CAST(length(s) AS BIGINT) - {K} + 2)) AS p FROM one)
), counts AS (
  SELECT word, count(*) AS n_occurrences, count(DISTINCT read_idx) AS n_records FROM w WHERE NOT regexp_matches(word, '[^ACGT]') GROUP BY word)"""


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_row_per_key(table(spark, sf_dir, "fasta_reads").select("read_idx", "seq"), "read_idx")


@REG.query("p6_words", f"WITH {_WORDS} SELECT * FROM counts")
def p6_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_counts(_reads(spark, sf_dir), "seq", K)


@REG.query(
    "p6_found",
    f"""WITH {_WORDS}, listed AS (SELECT DISTINCT upper(kmer) AS kmer FROM ktmers WHERE kmer IS NOT NULL
), n AS (SELECT count(DISTINCT read_idx) AS n FROM fasta_reads
), j AS (SELECT kmer, coalesce(n_occurrences, 0) AS o, coalesce(n_records, 0) AS r, n FROM listed LEFT JOIN counts ON word = kmer CROSS JOIN n)
SELECT kmer, CASE WHEN o < {RARE_BELOW} THEN 'rare' ELSE 'common' END AS mark FROM j WHERE o < {RARE_BELOW} OR r * 100 > {COMMON_ABOVE_PERCENT} * n""",
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listed entry that is no word of 18 called bases occurs nowhere and is rare."""
    listed = table(spark, sf_dir, "ktmers").filter("kmer is not null").select(F.upper("kmer").alias("kmer")).distinct()
    proper = F.col("kmer").rlike(f"^[ACGT]{{{K}}}$")
    total = table(spark, sf_dir, "fasta_reads").agg(F.count_distinct("read_idx").alias("n")).first()["n"]
    found = word_counts(_reads(spark, sf_dir), "seq", K, listed.filter(proper)).unionByName(
        listed.filter(~proper).select(F.col("kmer").alias("word"), F.lit(0).cast("bigint").alias("n_occurrences"), F.lit(0).cast("bigint").alias("n_records"))
    )
    mark = F.when(F.col("n_occurrences") < RARE_BELOW, "rare").when(F.col("n_records") * 100 > COMMON_ABOVE_PERCENT * total, "common")
    return found.select(F.col("word").alias("kmer"), mark.alias("mark")).filter("mark is not null")
