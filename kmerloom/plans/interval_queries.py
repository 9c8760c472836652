"""Problem 4: covered periods and gaps of alignment targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators.intervals import accurate_enough, coverage_segments, periods_and_gaps
from kmerloom.plans.registry import Registry
from kmerloom.session import table

REG = Registry()
PERCENT = 80.0

_ROWS_SQL = """
good AS (
  SELECT regexp_replace(header, '^>', '') AS header,
         CAST(least(nh_beg, nh_end) AS BIGINT) AS b, CAST(greatest(nh_beg, nh_end) AS BIGINT) AS e
  FROM alignments
  WHERE header IS NOT NULL AND nh_beg IS NOT NULL AND nh_end IS NOT NULL AND nh_beg <> nh_end
    AND accuracy IS NOT NULL AND NOT isnan(accuracy)
    AND CASE WHEN accuracy <= 1 THEN accuracy > 0.8 ELSE accuracy > 80 END
), reach AS (
  SELECT *, max(e) OVER (PARTITION BY header ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM good
), isle AS (
  SELECT *, sum(CASE WHEN r IS NULL OR b > r THEN 1 ELSE 0 END) OVER (PARTITION BY header ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS i FROM reach
), period AS (
  SELECT header, min(b) AS period_beg, max(e) AS period_end FROM isle GROUP BY header, i
)"""


def good_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "alignments").filter(accurate_enough("accuracy", PERCENT)).select(
        F.regexp_replace("header", "^>", "").alias("target"), "nh_beg", "nh_end", "aln_id"
    )


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(good_alignments(spark, sf_dir), "target", "nh_beg", "nh_end")


@REG.query("p4_found", f"WITH {_ROWS_SQL} SELECT header, period_beg, period_end FROM period")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periods(spark, sf_dir).filter("kind = 'period'").select(
        F.col("entity").alias("header"), F.col("beg").alias("period_beg"), F.col("end").alias("period_end")
    )


@REG.query(
    "p4_gaps",
    f"""WITH {_ROWS_SQL}, follow AS (
  SELECT header, period_end AS gap_beg, lead(period_beg) OVER (PARTITION BY header ORDER BY period_beg) AS gap_end FROM period)
SELECT header, gap_beg, gap_end, gap_end - gap_beg AS gap_len FROM follow WHERE gap_end IS NOT NULL""",
)
def p4_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periods(spark, sf_dir).filter("kind = 'gap'").select(
        F.col("entity").alias("header"), F.col("beg").alias("gap_beg"), F.col("end").alias("gap_end"), (F.col("end") - F.col("beg")).alias("gap_len")
    )


@REG.query(
    "p4_depth",
    """WITH one AS (
  SELECT DISTINCT aln_id, regexp_replace(header, '^>', '') AS header,
         CAST(least(nh_beg, nh_end) AS BIGINT) AS b, CAST(greatest(nh_beg, nh_end) AS BIGINT) AS e
  FROM alignments WHERE header IS NOT NULL AND aln_id IS NOT NULL AND nh_beg IS NOT NULL AND nh_end IS NOT NULL AND nh_beg <> nh_end
    AND accuracy IS NOT NULL AND NOT isnan(accuracy)
    AND CASE WHEN accuracy <= 1 THEN accuracy > 0.8 ELSE accuracy > 80 END
), ev AS (
  SELECT header, pos, sum(d) AS d FROM (SELECT header, b AS pos, 1 AS d FROM one UNION ALL SELECT header, e, -1 FROM one) GROUP BY header, pos HAVING sum(d) <> 0
), run AS (
  SELECT header, pos AS beg, lead(pos) OVER (PARTITION BY header ORDER BY pos) AS fin, sum(d) OVER (PARTITION BY header ORDER BY pos) AS depth FROM ev
)
SELECT header, CAST(max(depth) AS BIGINT) AS max_depth, CAST(sum(depth * (fin - beg)) AS BIGINT) AS aligned_bases,
       CAST(sum(CASE WHEN depth > 0 THEN fin - beg ELSE 0 END) AS BIGINT) AS covered_bases
FROM run WHERE fin IS NOT NULL GROUP BY header""",
)
def p4_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth figures of each target; rows sent again (one aln_id) count once."""
    once = good_alignments(spark, sf_dir).filter("aln_id is not null").dropDuplicates(["aln_id", "target", "nh_beg", "nh_end"])
    length = F.col("end") - F.col("beg")
    return (
        coverage_segments(once, "target", "nh_beg", "nh_end")
        .groupBy(F.col("entity").alias("header"))
        .agg(
            F.max("depth").alias("max_depth"),
            F.sum(F.col("depth") * length).alias("aligned_bases"),
            F.sum(F.when(F.col("depth") > 0, length).otherwise(0)).alias("covered_bases"),
        )
    )
