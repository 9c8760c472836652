"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.spans import SharedSpans, shared_spans
from kmerloom.plans.registry import Registry
from kmerloom.session import table

REG = Registry()
SPAN = 100

_SPANS = f"""one AS (SELECT read_idx, upper(any_value(seq)) AS s FROM fasta_reads WHERE seq IS NOT NULL AND read_idx IS NOT NULL GROUP BY read_idx
), w AS (SELECT read_idx, p, substr(s, p + 1, {SPAN}) AS x FROM (
  SELECT read_idx, s, unnest(range(CAST(length(s) AS BIGINT) - {SPAN - 1})) AS p FROM one WHERE length(s) >= {SPAN})
), shared AS (SELECT x FROM w WHERE NOT regexp_matches(x, '[^ACGT]') GROUP BY x HAVING count(DISTINCT read_idx) > 1
), hit AS (SELECT read_idx, p FROM w JOIN shared USING (x)
), isle AS (SELECT *, sum(fresh) OVER (PARTITION BY read_idx ORDER BY p ROWS UNBOUNDED PRECEDING) AS i FROM (
  SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY read_idx ORDER BY p) <= {SPAN} THEN 0 ELSE 1 END AS fresh FROM hit)
), span AS (SELECT read_idx, min(p) AS span_beg, max(p) + {SPAN} AS span_end FROM isle GROUP BY read_idx, i)"""


def _shared(spark: SparkSession, sf_dir: str) -> SharedSpans:
    return shared_spans(table(spark, sf_dir, "fasta_reads"), "read_idx", "seq", SPAN)


@REG.query("p2_found", f"WITH {_SPANS} SELECT read_idx, span_beg, span_end FROM span")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir).spans().withColumnRenamed("read", "read_idx")


@REG.query(
    "p2_share",
    f"""WITH {_SPANS}, n AS (SELECT read_idx, sum(span_end - span_beg) AS n FROM span GROUP BY read_idx)
SELECT read_idx, CAST(length(s) AS BIGINT) AS n_bases, CAST(coalesce(n, 0) AS BIGINT) AS n_shared, round(coalesce(n, 0) / length(s), 6) AS share
FROM one LEFT JOIN n USING (read_idx) WHERE s <> ''""",
)
def p2_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of every non-empty read that is shared with other reads."""
    shared = _shared(spark, sf_dir)
    spans = shared.spans().groupBy("read").agg(F.sum(F.col("span_end") - F.col("span_beg")).alias("n_shared"))
    reads = table(spark, sf_dir, "fasta_reads").filter("length(seq) > 0 and read_idx is not null").select(F.col("read_idx").alias("read"), F.length("seq").cast("bigint").alias("n_bases")).distinct()
    n = F.coalesce("n_shared", F.lit(0))
    return reads.join(spans, "read", "left").select(F.col("read").alias("read_idx"), "n_bases", n.alias("n_shared"), F.round(n / F.col("n_bases"), 6).alias("share"))


@REG.query(
    "p2_matches",
    f"""WITH one AS (SELECT read_idx, upper(any_value(seq)) AS s FROM fasta_reads WHERE read_idx IS NOT NULL GROUP BY read_idx
), class AS (SELECT min(read_idx) AS r, s FROM one WHERE length(s) >= {SPAN} GROUP BY s
), w AS (SELECT r, p, substr(s, p + 1, {SPAN}) AS x FROM (SELECT r, s, unnest(range(CAST(length(s) AS BIGINT) - {SPAN - 1})) AS p FROM class)
), pair AS (SELECT a.r AS read_a, b.r AS read_b, a.p AS p, b.p - a.p AS d FROM w a JOIN w b USING (x) WHERE a.r < b.r AND NOT regexp_matches(x, '[^ACGT]')
), isle AS (SELECT *, p - row_number() OVER (PARTITION BY read_a, read_b, d ORDER BY p) AS i FROM pair)
SELECT read_a, read_b, min(p) AS a_beg, min(p) + d AS b_beg, max(p) - min(p) + {SPAN} AS size FROM isle GROUP BY read_a, read_b, d, i""",
)
def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact matches of a span or more between any two different sequences; the passages are chains of these and shorter ones."""
    return _shared(spark, sf_dir).matches().filter(F.col("size") >= SPAN).select("read_a", "read_b", "a_beg", "b_beg", "size")


@REG.query("p2_passages")
def p2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir).passages()


@REG.query(
    "p2_copies",
    f"""WITH one AS (SELECT read_idx AS read, upper(any_value(seq)) AS s FROM fasta_reads WHERE read_idx IS NOT NULL GROUP BY read_idx)
SELECT read, class_id FROM (SELECT read, min(read) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS n FROM one WHERE length(s) >= {SPAN}) WHERE n > 1""",
)
def p2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every read whose sequence others have too; p2_passages names the class by its least read."""
    return _shared(spark, sf_dir).copies
