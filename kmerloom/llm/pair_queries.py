"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.together import pairs_together
from kmerloom.plans.registry import Registry
from kmerloom.session import one_row_per_key, table

REG = Registry()
MIN_COUNT, MIN_LIFT = 8, 4
#: Chance beyond one in a hundred (chi square, one degree of freedom). 8 times together at a lift of 4 always lies beyond it: llr >= 2 * (8 * ln 4 - 6) > 10.
MIN_LLR = 6.63
SIDES = (("creads", "read_idx"), ("ktmer_edges", "src"))


def _side_sql(name: str, key: str) -> str:
    return f"""{name}_m AS (SELECT DISTINCT {key} AS basket, m FROM (SELECT {key}, unnest(ktmers) AS m FROM {name}) WHERE m IS NOT NULL AND {key} IS NOT NULL
), {name}_n AS (SELECT count(DISTINCT basket) AS n FROM {name}_m
), {name}_c AS (SELECT m, count(*) AS n FROM {name}_m GROUP BY m
), {name}_p AS (
  SELECT a.m AS kmer_a, b.m AS kmer_b, count(*) AS n_ab FROM {name}_m a JOIN {name}_m b ON a.basket = b.basket AND a.m < b.m GROUP BY 1, 2 HAVING count(*) >= {MIN_COUNT}
), {name}_r AS (
  SELECT '{name}' AS side, kmer_a, kmer_b, x.n AS n_a, y.n AS n_b, n_ab, t.n AS n_baskets, n_ab * 1.0e0 * t.n / (x.n * y.n) AS lift
  FROM {name}_p JOIN {name}_c x ON x.m = kmer_a JOIN {name}_c y ON y.m = kmer_b CROSS JOIN {name}_n t WHERE n_ab * t.n >= {MIN_LIFT} * x.n * y.n)"""


_SQL = "WITH " + ", ".join(_side_sql(*s) for s in SIDES)
_BOTH = " UNION ALL ".join(f"SELECT * FROM {n}_r" for n, _ in SIDES)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key in SIDES:
        rows = one_row_per_key(table(spark, sf_dir, name).select(key, "ktmers"), key)
        side = pairs_together(rows, key, "ktmers", MIN_COUNT, MIN_LIFT, MIN_LLR).withColumn("side", F.lit(name))
        out = side if out is None else out.unionByName(side)
    return out.withColumnsRenamed({"item_a": "kmer_a", "item_b": "kmer_b"})


@REG.query("p3_found", f"{_SQL} SELECT side, kmer_a, kmer_b FROM ({_BOTH})")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("side", "kmer_a", "kmer_b")


@REG.query(
    "p3_pairs",
    f"""{_SQL}, r AS ({_BOTH}), o AS (
  SELECT *, CAST(n_ab AS DOUBLE) AS k11, CAST(n_a - n_ab AS DOUBLE) AS k12, CAST(n_b - n_ab AS DOUBLE) AS k21, CAST(n_baskets - n_a - n_b + n_ab AS DOUBLE) AS k22 FROM r)
SELECT side, kmer_a, kmer_b, n_a, n_b, n_ab, n_baskets, round(lift, 6) AS lift, round(2 * (
  CASE WHEN k11 > 0 THEN k11 * ln(k11 * n_baskets / (CAST(n_a AS DOUBLE) * n_b)) ELSE 0 END +
  CASE WHEN k12 > 0 THEN k12 * ln(k12 * n_baskets / (CAST(n_a AS DOUBLE) * (n_baskets - n_b))) ELSE 0 END +
  CASE WHEN k21 > 0 THEN k21 * ln(k21 * n_baskets / (CAST(n_b AS DOUBLE) * (n_baskets - n_a))) ELSE 0 END +
  CASE WHEN k22 > 0 THEN k22 * ln(k22 * n_baskets / (CAST(n_baskets - n_a AS DOUBLE) * (n_baskets - n_b))) ELSE 0 END), 4) AS llr FROM o""",
)
def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumns({"lift": F.round("lift", 6), "llr": F.round("llr", 4)})
