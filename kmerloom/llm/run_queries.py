"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.runs import base_runs, event_runs
from kmerloom.plans.registry import Registry
from kmerloom.session import one_row_per_key, table

REG = Registry()

_MATCHES = " UNION ALL ".join(
    f"SELECT read_idx, unnest(regexp_extract_all(s, '{b}(?:[^ACGT]{{0,2}}{b}){{7,}}')) AS m FROM one" for b in "ACGT"
)
_ONE = "one AS (SELECT read_idx, upper(any_value(seq)) AS s FROM fasta_reads WHERE seq IS NOT NULL GROUP BY read_idx)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_runs(one_row_per_key(table(spark, sf_dir, "fasta_reads").select("read_idx", "seq"), "read_idx"), "read_idx", "seq")


@REG.query(
    "p1_found",
    f"""WITH {_ONE}, called AS (
  SELECT read_idx, p, substr(s, p + 1, 1) AS b FROM (SELECT read_idx, s, unnest(range(CAST(length(s) AS BIGINT))) AS p FROM one)
  WHERE substr(s, p + 1, 1) IN ('A', 'C', 'G', 'T')
), before AS (SELECT *, lag(b) OVER w AS pb, lag(p) OVER w AS pp FROM called WINDOW w AS (PARTITION BY read_idx ORDER BY p)
), isle AS (
  SELECT *, sum(CASE WHEN pb = b AND p - pp <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY read_idx ORDER BY p ROWS UNBOUNDED PRECEDING) AS i FROM before)
SELECT read_idx, min(p) AS run_beg, max(p) + 1 AS run_end FROM isle GROUP BY read_idx, i HAVING count(*) >= 8""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select(F.col("key").alias("read_idx"), "run_beg", "run_end")


@REG.query(
    "p1_run_sizes",
    f"""WITH {_ONE}, m AS ({_MATCHES})
SELECT read_idx, left(m, 1) AS base, CAST(length(regexp_replace(m, '[^ACGT]', '', 'g')) AS BIGINT) AS n_calls,
       CAST(length(m) AS BIGINT) AS n_positions, count(*) AS n_runs FROM m GROUP BY ALL""",
)
def p1_run_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _runs(spark, sf_dir)
        .groupBy(F.col("key").alias("read_idx"), "base", F.col("n_events").alias("n_calls"), "n_positions")
        .agg(F.count("*").alias("n_runs"))
    )


@REG.query(
    "p1_event_runs",
    """WITH n AS (
  SELECT user_id, event_type, ts,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, event_type)
       - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
SELECT user_id, event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM n GROUP BY user_id, event_type, g""",
)
def p1_event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select(
        F.col("entity").alias("user_id"), F.col("value").alias("event_type"), F.col("first").alias("first_ts"), F.col("last").alias("last_ts"), "n_events"
    )
