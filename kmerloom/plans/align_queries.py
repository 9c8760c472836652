"""Queries on pairwise alignments, consensus and replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions import align
from kmerloom.operators import consensus, kmers, nhood
from kmerloom.plans import common
from kmerloom.plans.registry import Registry
from kmerloom.plans.sql import READS
from kmerloom.session import stored, table

REG = Registry()
T_MAX, SHARED = 55, 4
#: Lengths between which a read is used for the consensus.
SHORTEST, LONGEST = 450, 550
CELLS = 3_000_000_000
#: Length that a local alignment must exceed to join two reads, and rounds in which a spanning forest is aligned.
LONG, FORESTS = 400, 3


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nhood.neighbours(common.creads(spark, sf_dir), T_MAX)


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.reads_of(table(spark, sf_dir, "fasta_reads")).select("read_idx", "seq")  # the joins spread them


def _sized(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with the lengths n1 and n2 of their reads."""
    sizes = own.select("read_idx", F.length("seq").cast("double").alias("n"))
    return pairs.join(sizes.select(F.col("read_idx").alias("base"), F.col("n").alias("n1")), "base").join(sizes.select(F.col("read_idx").alias("neighbour"), F.col("n").alias("n2")), "neighbour")


def _with_sequences(own: DataFrame, pairs: DataFrame, cells: float) -> DataFrame:
    """(base, neighbour, s1, s2), spread over tasks of CELLS or fewer of the `cells` steps of alignment each on average."""
    tasks = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(cells // CELLS) + 1)
    # the sequences of the neighbours are the only ones that are moved once a pair
    right = pairs.select("base", "neighbour").join(own.select(F.col("read_idx").alias("neighbour"), F.col("seq").alias("s2")), "neighbour").repartition(tasks, "base")
    return right.join(own.select(F.col("read_idx").alias("base"), F.col("seq").alias("s1")).repartition(tasks, "base"), "base").select("base", "neighbour", "s1", "s2")


def _near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).filter((F.col("n_shared") >= SHARED) & (F.col("base") < F.col("neighbour")))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of any length that share kt-mers, with their sequences."""
    own, pairs = _reads(spark, sf_dir), stored(_near_pairs(spark, sf_dir).select("base", "neighbour"))
    return _with_sequences(own, pairs, _sized(own, pairs).agg(F.sum(F.col("n1") * F.col("n2"))).first()[0] or 0)


def _aligned(spark: SparkSession, sf_dir: str, fitting: bool) -> DataFrame:
    return _pairs(spark, sf_dir).select("base", "neighbour", align.alignment(fitting)("s1", "s2").alias("a")).select("base", "neighbour", "a.*")


@REG.query("local_align")
def local_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, False)


@REG.query("fitting_align")
def fitting_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, True)


@REG.query("subsequences")
def subsequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the longest common subsequence, shortest common supersequence and longest common substring, and the anchored score."""
    own = _pairs(spark, sf_dir).withColumn("lcs", align.lcs_length("s1", "s2"))
    return own.select("base", "neighbour", "lcs", (F.length("s1") + F.length("s2") - F.col("lcs")).alias("scs"), F.length(align.longest_substring("s1", "s2")).alias("substring"), align.linear_score("s1", "s2").alias("score"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.nhood_reads(_near(spark, sf_dir).filter(F.col("n_shared") >= SHARED), common.reads(spark, sf_dir), SHORTEST, LONGEST)


@REG.query("consensus_tree")
def consensus_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of each neighbourhood from 64 quartets of its reads, 16 groups of 4."""
    return consensus.tree_consensus(_groups(spark, sf_dir))


@REG.query("multi_align_consensus")
def multi_align_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.multi_alignment_consensus(_groups(spark, sf_dir))


@REG.query("cluster_by_alignment")
def cluster_by_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads in groups joined by local alignments longer than LONG.

    A pair within one group tells nothing, so only a spanning forest of the pairs is
    aligned, the cheapest first; then one of those that still lie between groups. After
    FORESTS rounds all pairs between groups that are left are aligned at once.
    """
    from kmerloom.operators.graph import components

    own = _reads(spark, sf_dir)
    short = F.when(F.least("n1", "n2") <= LONG, 1e18).otherwise(0.0)  # an alignment of these is seldom long
    left = stored(_sized(own, _near_pairs(spark, sf_dir)).select("base", "neighbour", (F.col("n1") * F.col("n2")).alias("cells"), (short + F.col("n1") * F.col("n2") / F.col("n_shared")).alias("cost")))
    joined = left.select("base", "neighbour").limit(0)
    for i in range(FORESTS + 1):
        chosen = stored(consensus.undecided(left, joined, forest=i < FORESTS))
        n, cells = chosen.agg(F.count("*"), F.sum("cells")).first()
        if not n:
            break
        rows = _with_sequences(own, chosen, cells).select("base", "neighbour", align.alignment()("s1", "s2")["align_len"].alias("n"))
        joined = joined.unionByName(stored(rows.filter(F.col("n") > LONG).select("base", "neighbour")))
        left = left.join(chosen.select("base", "neighbour"), ["base", "neighbour"], "left_anti")
    return components(joined.select(F.col("base").alias("src"), F.col("neighbour").alias("dst"))).groupBy("component").agg(F.count("*").alias("n_reads"))


_OK = "CASE WHEN accuracy <= 1 THEN accuracy > 0.8 ELSE accuracy > 80 END AND NOT isnan(accuracy)"
_PLAN = f"""ok AS (SELECT DISTINCT regexp_replace(header, '^>', '') AS read_id, nh_beg AS beg, nh_end AS fin, consensus, ec_beg, ec_end, aln_id FROM alignments
  WHERE accuracy IS NOT NULL AND {_OK} AND nh_beg < nh_end AND ec_beg < ec_end AND header IS NOT NULL
), pl AS (SELECT * FROM (SELECT *, max(fin) OVER (PARTITION BY read_id ORDER BY beg, fin DESC, aln_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ok) WHERE reach IS NULL OR beg >= reach)"""


@REG.query("replacement_plan", f'WITH {_PLAN} SELECT read_id, beg, fin AS "end", consensus, ec_beg, ec_end, aln_id FROM pl')
def replacement_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.replacement_plan(table(spark, sf_dir, "alignments"))


@REG.query(
    "spliced_reads",
    f"""WITH RECURSIVE {READS}, {_PLAN}, q AS (SELECT read_id, beg, fin, regexp_extract(consensus, '_([ACGTacgt]+)\\.', 1) AS piece, row_number() OVER (PARTITION BY read_id ORDER BY beg DESC) AS i
  FROM pl JOIN reads USING (read_id) WHERE fin <= len AND beg >= 0
), s(read_id, i, seq) AS (SELECT read_id, CAST(0 AS BIGINT), seq FROM reads UNION ALL SELECT s.read_id, q.i, substr(seq, 1, beg) || piece || substr(seq, fin + 1) FROM s JOIN q ON q.read_id = s.read_id AND q.i = s.i + 1)
SELECT read_id, arg_max(seq, i) AS seq FROM s GROUP BY read_id""",
)
def spliced_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with the planned parts replaced by the kt-mer that the consensus is named after."""
    plan = consensus.replacement_plan(table(spark, sf_dir, "alignments")).select("read_id", "beg", "end", F.regexp_extract("consensus", r"_([ACGTacgt]+)\.", 1).alias("piece"))
    return consensus.spliced(common.reads(spark, sf_dir).select("read_id", "seq", "len"), plan)


@REG.query(
    "overlap_test",
    """SELECT DISTINCT aln_id, coalesce(q_strand = t_strand AND (NOT isnan(accuracy) AND CASE WHEN accuracy <= 1 THEN accuracy > 0.75 ELSE accuracy > 75 END)
  AND ((nh_end - nh_beg) + (ec_end - ec_beg)) // 2 > 100 AND t_len - nh_end < 200 AND (ec_len - ec_end) - (t_len - nh_end) >= 1, false) AS extends FROM alignments""",
)
def overlap_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.overlap_kind(table(spark, sf_dir, "alignments"), 75.0, 100, 200).select("aln_id", "extends").distinct()


@REG.query(
    "contig_extension",
    f"""WITH {READS}, c AS (SELECT DISTINCT aln_id, regexp_replace(header, '^>', '') AS read_id, nh_end, regexp_extract(consensus, '_([ACGTacgt]+)\\.', 1) AS piece FROM alignments
  WHERE q_strand = t_strand AND NOT isnan(accuracy) AND CASE WHEN accuracy <= 1 THEN accuracy > 0.75 ELSE accuracy > 75 END AND ((nh_end - nh_beg) + (ec_end - ec_beg)) // 2 > 100 AND t_len - nh_end < 200 AND (ec_len - ec_end) - (t_len - nh_end) >= 1)
SELECT aln_id, read_id, substr(seq, 1, nh_end) || piece AS seq FROM c JOIN reads USING (read_id) WHERE nh_end > 0""",
)
def contig_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets cut at the end of an extending alignment and continued by its piece."""
    rows = consensus.overlap_kind(table(spark, sf_dir, "alignments"), 75.0, 100, 200).filter("extends and nh_end > 0")
    cut = rows.select("aln_id", F.regexp_replace("header", "^>", "").alias("read_id"), "nh_end", F.regexp_extract("consensus", r"_([ACGTacgt]+)\.", 1).alias("piece")).distinct()
    return cut.join(common.reads(spark, sf_dir).select("read_id", "seq"), "read_id").select("aln_id", "read_id", F.concat(F.expr("substring(seq, 1, nh_end)"), "piece").alias("seq"))


@REG.query("accepted_consensus", "SELECT DISTINCT aln_id FROM alignments WHERE ec_len > 0 AND (ec_end - ec_beg) * 1.0 / ec_len <= 0.05")
def accepted_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments whose aligned part is at most 5 per cent of the consensus."""
    rows = table(spark, sf_dir, "alignments").filter("ec_len > 0").select("aln_id", F.col("ec_len").cast("double").alias("n1"), F.expr("ec_end - ec_beg").cast("double").alias("n2"))
    return consensus.accepted_consensus(rows, "n1", "n2").select("aln_id").distinct()
