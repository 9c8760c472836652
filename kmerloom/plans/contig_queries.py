"""Queries about contigs and about the choice of reads that go on with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators import evaluate as ev
from kmerloom.operators import nhood
from kmerloom.operators.intervals import interval_clusters
from kmerloom.plans import common
from kmerloom.plans.eval_queries import _ONE, alignments
from kmerloom.plans.nhood_queries import _US, T_MAX
from kmerloom.plans.registry import Registry
from kmerloom.plans.sql import CREADS, READS

REG = Registry()

_BREAKS = f"""{_ONE}, bp AS (
  SELECT consensus, ec_beg AS place FROM al WHERE nh_beg > 100 AND ec_beg > 100 AND ec_beg IS NOT NULL
  UNION ALL SELECT consensus, ec_end FROM al WHERE t_len - nh_end > 100 AND ec_len - ec_end > 100
), bins AS (SELECT consensus, CAST(floor(place / 100.0) * 100 AS BIGINT) AS bin, count(*) AS n FROM bp GROUP BY ALL)"""


@REG.query("breakpoints", f"WITH {_BREAKS} SELECT * FROM bins")
def breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where alignments break off inside consensus and target."""
    return ev.breakpoints(alignments(spark, sf_dir), "consensus")


@REG.query(
    "jump_pieces",
    f"""WITH {_BREAKS}, c AS (SELECT consensus, arg_max(bin, (n, -bin)) AS cut FROM bins GROUP BY 1
), j AS (SELECT consensus, CAST(max(ec_len) AS BIGINT) AS len, count(*) AS n, count(*) FILTER ((nh_beg > 100 AND ec_beg > 100) OR (t_len - nh_end > 100 AND ec_len - ec_end > 100)) AS b FROM al GROUP BY 1
), k AS (SELECT j.consensus, len, CASE WHEN b / n >= 0.6 AND b >= 3 AND cut > 0 AND cut < len THEN cut END AS cut FROM j LEFT JOIN c ON c.consensus IS NOT DISTINCT FROM j.consensus)
SELECT consensus, CAST(0 AS BIGINT) AS beg, coalesce(cut, len) AS "end" FROM k WHERE consensus IS NOT NULL UNION ALL SELECT consensus, cut, len FROM k WHERE cut IS NOT NULL AND consensus IS NOT NULL""",
)
def jump_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus sequences cut at a likely wrong joint, the others whole."""
    return ev.jump_pieces(alignments(spark, sf_dir).filter("consensus is not null"), "consensus", "ec_len")


@REG.query(
    "cluster_stats",
    f"""WITH {_ONE}, r AS (SELECT *, max(e) OVER (PARTITION BY header ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv
), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR b >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY header ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS isle FROM r
), c AS (SELECT header, isle, max(e) - min(b) AS len, count(*) AS n FROM i GROUP BY ALL)
SELECT header AS entity, count(*) AS n_clusters, count(*) FILTER (n = 1) AS n_single, CAST(sum(len) AS BIGINT) AS covered, max(len) AS best FROM c GROUP BY 1""",
)
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of each target: how many, how many of one alignment only, bases covered, the longest."""
    return ev.cluster_stats(interval_clusters(alignments(spark, sf_dir), "header", "nh_beg", "nh_end"))


@REG.query(
    "paired_names",
    f"""WITH {READS}, a AS (SELECT left(x, 10) AS prefix, x, row_number() OVER (PARTITION BY left(x, 10) ORDER BY x) AS r FROM (SELECT DISTINCT read_id AS x FROM reads)
), b AS (SELECT left(x, 10) AS prefix, x, row_number() OVER (PARTITION BY left(x, 10) ORDER BY x) AS r FROM (SELECT DISTINCT regexp_replace(header, '^>', '') AS x FROM alignments WHERE header IS NOT NULL))
SELECT a.prefix, a.x AS "left", b.x AS "right" FROM a JOIN b USING (prefix, r)""",
)
def paired_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and alignment targets whose names begin alike, one to one."""
    return ev.paired_by_prefix(common.reads(spark, sf_dir).select(F.col("read_id").alias("name")), alignments(spark, sf_dir).select(F.col("header").alias("name")), "name", 10)


@REG.query("ktmers_of_middle", f"WITH {CREADS} SELECT read_idx, min(ord) AS first, max(ord) AS last FROM cr WHERE pos >= len // 4 AND pos <= 3 * len // 4 GROUP BY 1")
def ktmers_of_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the kt-mers in the middle half of each read."""
    return nhood.places_within(common.creads(spark, sf_dir), F.expr("len div 4"), F.expr("3 * len div 4"))


@REG.query(
    "placed_share",
    f"WITH {_ONE} SELECT consensus, count(*) AS n, count(*) FILTER (nh_beg > 200 AND nh_beg < 800) AS n_inside, round(100.0 * count(*) FILTER (nh_beg > 200 AND nh_beg < 800) / count(*), 6) AS percent FROM al WHERE nh_beg IS NOT NULL GROUP BY 1",
)
def placed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each consensus' alignments that begins strictly between two places."""
    rows = alignments(spark, sf_dir).filter("nh_beg is not null").groupBy("consensus").agg(F.count("*").alias("n"), F.count_if(F.expr("nh_beg > 200 and nh_beg < 800")).alias("n_inside"))
    return rows.withColumn("percent", F.round(F.expr("100D * n_inside / n"), 6))


_USED = "used AS (SELECT DISTINCT read_idx FROM reads WHERE read_id IN (SELECT regexp_replace(header, '^>', '') FROM alignments WHERE header IS NOT NULL))"


def _used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that alignments are made to."""
    return common.reads(spark, sf_dir).join(alignments(spark, sf_dir).select(F.col("header").alias("read_id")).distinct(), "read_id", "left_semi").select("read_idx")


@REG.query(
    "start_reads",
    f"""WITH {READS}, {CREADS}, {_USED}, s AS (SELECT read_idx, count(DISTINCT kmer) AS n FROM cr WHERE read_idx NOT IN (SELECT read_idx FROM used) GROUP BY 1)
SELECT kmer, arg_max(read_idx, (n, -read_idx)) AS read_idx, max(n) AS n FROM (SELECT DISTINCT kmer, read_idx FROM cr) JOIN s USING (read_idx) GROUP BY kmer""",
)
def start_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an extension may begin: the richest read of each kt-mer among those without an alignment."""
    return nhood.start_reads(common.creads(spark, sf_dir), _used(spark, sf_dir))


@REG.query(
    "extension_candidates",
    f"""WITH {READS}, {_US}, {_USED}, s AS (SELECT read_idx AS neighbour, count(*) AS n_ktmers FROM cr GROUP BY 1)
SELECT base, neighbour, n_shared, n_ktmers, row_number() OVER (PARTITION BY base ORDER BY n_ktmers DESC, neighbour) AS rank FROM near JOIN s USING (neighbour) WHERE neighbour NOT IN (SELECT read_idx FROM used)""",
)
def extension_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours that weren't used, the richest in kt-mers first."""
    creads = common.creads(spark, sf_dir)
    return nhood.ranked(creads, nhood.candidates(nhood.neighbours(creads, T_MAX), _used(spark, sf_dir)))
