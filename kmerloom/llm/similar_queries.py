"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.similar import all_pairs, similar_sets
from kmerloom.plans.registry import Registry
from kmerloom.session import one_row_per_key, table

REG = Registry()
THRESHOLD, MIN_SIZE = 0.6, 6
SIDES = ("creads", "ktmer_headers")

_SQL = f"""WITH m AS (
  SELECT DISTINCT 'creads' AS side, read_idx AS k, m FROM (SELECT read_idx, unnest(ktmers) AS m FROM creads) WHERE m IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'ktmer_headers', line_no, regexp_replace(m, '^>', '') FROM (SELECT line_no, unnest(headers) AS m FROM ktmer_headers) WHERE m IS NOT NULL
), n AS (SELECT side, k, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= {MIN_SIZE}
), c AS (SELECT a.side, a.k AS key_a, b.k AS key_b, count(*) AS c FROM m a JOIN m b ON a.side = b.side AND a.m = b.m AND a.k < b.k GROUP BY ALL
), r AS (SELECT c.side, key_a, key_b, c, x.n AS n_a, y.n AS n_b FROM c JOIN n x ON x.side = c.side AND x.k = key_a JOIN n y ON y.side = c.side AND y.k = key_b WHERE c * 8 >= (x.n + y.n) * 3)"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides in one table: the side is the lowest bit of the key and part of each member."""
    reads = one_row_per_key(table(spark, sf_dir, "creads").select("read_idx", "ktmers"), "read_idx")
    lines = table(spark, sf_dir, "ktmer_headers").select("line_no", "headers")
    one = reads.select((F.col("read_idx") * 2).alias("key"), F.transform("ktmers", lambda x: F.concat(F.lit("k"), x)).alias("members"))
    two = lines.select((F.col("line_no") * 2 + 1).alias("key"), F.transform("headers", lambda x: F.concat(F.lit("h"), F.regexp_replace(x, "^>", ""))).alias("members"))
    return one.unionByName(two)


def _side(key: str):
    return F.when(F.col(key) % 2 == 0, SIDES[0]).otherwise(SIDES[1]).alias("side")


@REG.query("p5_found", f"{_SQL} SELECT side, key_a, key_b FROM r")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = all_pairs(*similar_sets(_sets(spark, sf_dir), "key", "members", THRESHOLD, MIN_SIZE))
    return found.select(_side("key_a"), F.shiftright("key_a", 1).alias("key_a"), F.shiftright("key_b", 1).alias("key_b"))


@REG.query(
    "p5_links",
    f"""{_SQL}, e AS (
  SELECT side, k, list_sort(list(m)) AS s FROM m JOIN n USING (side, k) GROUP BY side, k
), cl AS (SELECT side, k, min(k) OVER (PARTITION BY side, s) AS class_id FROM e
), d AS (SELECT DISTINCT r.side, x.class_id AS a, y.class_id AS b FROM r JOIN cl x ON x.side = r.side AND x.k = key_a JOIN cl y ON y.side = r.side AND y.k = key_b WHERE x.class_id <> y.class_id
), u AS (SELECT side, class_id, count(*) AS n FROM (SELECT DISTINCT side, a AS class_id, b AS o FROM d UNION SELECT side, b, a FROM d) GROUP BY ALL)
SELECT cl.side, k AS key, cl.class_id, CAST(coalesce(u.n, 0) AS BIGINT) AS n_links FROM cl LEFT JOIN u ON u.side = cl.side AND u.class_id = cl.class_id""",
)
def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each set: its class of equal sets and the number of other classes it is linked to."""
    sets = _sets(spark, sf_dir)
    pairs, copies = similar_sets(sets, "key", "members", THRESHOLD, MIN_SIZE)
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    own = F.size(F.array_distinct(F.filter(F.coalesce("members", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    keys = sets.filter(own >= MIN_SIZE).select("key")
    classed = keys.join(copies, "key", "left").select("key", F.coalesce("id", "key").alias("id")).join(ends, "id", "left")
    return classed.select(_side("key"), F.shiftright("key", 1).alias("key"), F.shiftright("id", 1).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
