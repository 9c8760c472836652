"""Queries of the scalar functions over listed kt-mers, headers and alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions import dna
from kmerloom.operators import hammer
from kmerloom.plans import common
from kmerloom.plans.registry import Registry
from kmerloom.plans.sql import LISTED, READS, plain_complexity, rc
from kmerloom.session import one_row_per_key, table

REG = Registry()

_DEL = "list_distinct([substr(kmer, 1, CAST(i AS BIGINT) - 1) || substr(kmer, CAST(i AS BIGINT) + 1) for i in range(1, length(kmer) + 1)])"
_INS_FRONT = "list_distinct(flatten([[substr(kmer, 1, CAST(i AS BIGINT)) || b || substr(kmer, CAST(i AS BIGINT) + 1) for b in ['A','C','G','T']] for i in range(0, length(kmer))]))"
_INS_ALL = "list_distinct(flatten([[substr(kmer, 1, CAST(i AS BIGINT)) || b || substr(kmer, CAST(i AS BIGINT) + 1) for b in ['A','C','G','T']] for i in range(0, length(kmer) + 1)]))"
_INS_NONE = "list_distinct(flatten([[substr(kmer, 1, CAST(i AS BIGINT)) || b || substr(kmer, CAST(i AS BIGINT) + 1) for b in ['A','C','G','T']] for i in range(1, length(kmer))]))"


@REG.query(
    "kmer_predicates",
    f"""WITH {LISTED} SELECT kmer, {rc('kmer')} AS rc, kmer = {rc('kmer')} AS palindrome, NOT ({plain_complexity('kmer')}) AS low_complexity,
  left(kmer, 17) AS prefix, right(kmer, 17) AS suffix FROM listed""",
)
def kmer_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.listed(spark, sf_dir).select("kmer", dna.reverse_complement("kmer").alias("rc"), dna.is_palindrome("kmer").alias("palindrome"), dna.is_low_complexity("kmer").alias("low_complexity"), dna.prefix_of("kmer").alias("prefix"), dna.suffix_of("kmer").alias("suffix"))


@REG.query("deletion_neighbours", f"WITH {LISTED} SELECT kmer, list_sort({_DEL}) AS found FROM listed")
def deletion_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.listed(spark, sf_dir).select("kmer", F.array_sort(dna.deletions("kmer")).alias("found"))


@REG.query("insertion_neighbours", f"WITH {LISTED} SELECT kmer, list_sort({_INS_FRONT}) AS found FROM listed")
def insertion_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.listed(spark, sf_dir).select("kmer", F.array_sort(dna.insertions("kmer")).alias("found"))


@REG.query("insertion_neighbours_ends", f"WITH {LISTED} SELECT kmer, list_sort({_INS_ALL}) AS with_ends, list_sort({_INS_NONE}) AS inside FROM listed")
def insertion_neighbours_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.listed(spark, sf_dir).select("kmer", F.array_sort(dna.insertions("kmer", ends="both")).alias("with_ends"), F.array_sort(dna.insertions("kmer", ends="none")).alias("inside"))


@REG.query(
    "proper_indels",
    f"""WITH {LISTED} SELECT kmer, list_sort(list_filter({_DEL}, lambda d: d <> left(kmer, 17) AND d <> right(kmer, 17))) AS less,
  list_sort(list_filter({_INS_ALL}, lambda x: left(x, 18) <> kmer AND right(x, 18) <> kmer)) AS more FROM listed""",
)
def proper_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.listed(spark, sf_dir).select("kmer", F.array_sort(dna.proper_deletions("kmer")).alias("less"), F.array_sort(dna.proper_insertions("kmer")).alias("more"))


@REG.query("lmers_of_ktmers", f"WITH {LISTED} SELECT DISTINCT substr(kmer, CAST(i AS BIGINT), 12) AS lmer FROM (SELECT kmer, unnest(range(1, 8)) AS i FROM listed)")
def lmers_of_ktmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.listed(spark, sf_dir).select(F.explode(dna.kmer_array("kmer", 12)).alias("lmer")).distinct()


@REG.query(
    "hamming_neighbours",
    f"""WITH {LISTED} SELECT a.kmer AS a, b.kmer AS b, CAST(hamming(a.kmer, b.kmer) AS INT) AS distance FROM listed a JOIN listed b ON a.kmer < b.kmer AND length(a.kmer) = length(b.kmer) AND hamming(a.kmer, b.kmer) <= 2""",
)
def hamming_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed kt-mers that differ in two places at most."""
    return hammer.hamming_pairs(common.listed(spark, sf_dir), "kmer", 2)


@REG.query(
    "header_fields",
    """WITH one AS (SELECT read_idx, any_value(header) AS h FROM fasta_reads WHERE read_idx IS NOT NULL AND header IS NOT NULL GROUP BY read_idx), r AS (SELECT read_idx, regexp_extract(h, '^>?(\\S*)', 1) AS read_id FROM one)
SELECT read_idx, read_id, regexp_replace(read_id, '/[^/]*$', '') AS stem, TRY_CAST(nullif(regexp_extract(read_id, 'read_(\\d+)', 1), '') AS BIGINT) AS number,
  TRY_CAST(nullif(regexp_extract(read_id, 'genome_(\\d+)_', 1), '') AS BIGINT) AS genome_beg, TRY_CAST(nullif(regexp_extract(read_id, 'genome_\\d+_(\\d+)', 1), '') AS BIGINT) AS genome_end,
  TRY_CAST(nullif(regexp_extract(read_id, '/mat(\\d+)_', 1), '') AS BIGINT) AS mat, TRY_CAST(nullif(regexp_extract(read_id, '/0_(\\d+)', 1), '') AS BIGINT) AS read_len FROM r""",
)
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = one_row_per_key(table(spark, sf_dir, "fasta_reads").select("read_idx", "header"), "read_idx").filter("header is not null").select("read_idx", dna.read_id("header").alias("read_id"))
    f = dna.simulated_fields("read_id")
    return own.select("read_idx", "read_id", dna.without_last_field("read_id").alias("stem"), f["number"].alias("number"), f["beg"].alias("genome_beg"), f["end"].alias("genome_end"), f["mat"].alias("mat"), f["len"].alias("read_len"))


@REG.query(
    "error_rates",
    """WITH one AS (SELECT read_idx, any_value(header) AS h FROM fasta_reads WHERE read_idx IS NOT NULL GROUP BY read_idx), x AS (
  SELECT CAST(regexp_extract(h, '/mat(\\d+)_', 1) AS BIGINT) AS m, CAST(regexp_extract(h, '_mis(\\d+)_', 1) AS BIGINT) AS s, CAST(regexp_extract(h, '_ins(\\d+)_', 1) AS BIGINT) AS i, CAST(regexp_extract(h, '_del(\\d+)', 1) AS BIGINT) AS d
  FROM one WHERE regexp_matches(h, '/mat\\d+_mis\\d+_ins\\d+_del\\d+'))
SELECT CAST(sum(m) AS BIGINT) AS mat, CAST(sum(s) AS BIGINT) AS mis, CAST(sum(i) AS BIGINT) AS ins, CAST(sum(d) AS BIGINT) AS del, round(sum(s + i + d) / sum(m + s + i + d), 9) AS error_rate FROM x""",
)
def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error totals of the simulated headers and their rate."""
    own = one_row_per_key(table(spark, sf_dir, "fasta_reads").select("read_idx", "header"), "read_idx").select(dna.simulated_fields("header").alias("f")).filter("f.mat is not null and f.mis is not null and f.ins is not null and f.del is not null")
    sums = own.agg(*[F.sum(f"f.{x}").alias(x) for x in ("mat", "mis", "ins", "del")])
    return sums.withColumn("error_rate", F.round(F.expr("(mis + ins + del) / (mat + mis + ins + del)"), 9))


@REG.query(
    "alignment_projections",
    """SELECT DISTINCT aln_id, ((ec_end - ec_beg) + (nh_end - nh_beg)) // 2 AS avg_len, least(nh_beg, ec_beg) AS hull_beg, greatest(nh_end, ec_end) AS hull_end,
  (nh_beg < ec_beg AND ec_beg < nh_end) OR (nh_beg < ec_end AND ec_end < nh_end) AS strictly, nh_beg <= ec_end AND ec_beg <= nh_end AS closed,
  CASE WHEN nh_beg > ec_beg THEN CAST(nh_beg - ec_beg AS BIGINT) * (nh_beg - ec_beg) ELSE 0 END AS score2
FROM alignments WHERE nh_beg IS NOT NULL AND nh_end IS NOT NULL AND ec_beg IS NOT NULL AND ec_end IS NOT NULL""",
)
def alignment_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = dna.hull("nh_beg", "nh_end", "ec_beg", "ec_end")
    rows = table(spark, sf_dir, "alignments").dropna(subset=["nh_beg", "nh_end", "ec_beg", "ec_end"])
    return rows.select(
        "aln_id", dna.average_length("ec_beg", "ec_end", "nh_beg", "nh_end").cast("int").alias("avg_len"), h["beg"].alias("hull_beg"), h["end"].alias("hull_end"),
        dna.within_strict("nh_beg", "nh_end", "ec_beg", "ec_end").alias("strictly"), dna.within_closed("nh_beg", "nh_end", "ec_beg", "ec_end").alias("closed"), dna.position_score("nh_beg", "ec_beg").alias("score2"),
    ).distinct()


@REG.query("extension_windows", f"WITH {READS} SELECT read_idx, substr(seq, 501, 500) AS ahead, substr(seq, 101, 100) AS piece FROM reads WHERE len > 500")
def extension_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = common.reads(spark, sf_dir).filter("len > 500")
    return own.select("read_idx", dna.extension_window("seq", F.lit(500), F.lit(500)).alias("ahead"), dna.region("seq", F.lit(100), F.lit(200)).alias("piece"))


@REG.query(
    "every_kmer",
    f"""WITH {READS}, b AS (SELECT unnest(['A','C','G','T']) AS x), w AS (SELECT a.x || b.x || c.x || d.x AS kmer FROM b a, b b, b c, b d), k AS (
  SELECT substr(seq, p + 1, 4) AS kmer FROM (SELECT seq, unnest(range(CAST(len AS BIGINT) - 3)) AS p FROM reads WHERE len >= 4)), c AS (SELECT kmer, count(*) AS t FROM k GROUP BY kmer)
SELECT kmer, coalesce(t, 0) AS t FROM w LEFT JOIN c USING (kmer)""",
)
def every_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 4-mers with their counts in the reads, 0 included."""
    counts = dna.kmer_rows(common.reads(spark, sf_dir), "seq", 4).groupBy("kmer").agg(F.count("*").alias("t"))
    return dna.every_kmer(spark, 4).join(counts, "kmer", "left").select("kmer", F.coalesce("t", F.lit(0)).alias("t"))
