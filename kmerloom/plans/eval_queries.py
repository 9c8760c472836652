"""Queries on alignment tables: filters, coverage, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators import evaluate as ev
from kmerloom.operators.intervals import coverage_segments, interval_clusters, periods_and_gaps
from kmerloom.plans import common
from kmerloom.plans.registry import Registry
from kmerloom.plans.sql import CREADS, READS
from kmerloom.session import table

REG = Registry()

_ONE = """al AS (SELECT DISTINCT aln_id, regexp_replace(header, '^>', '') AS header, consensus, q_strand, t_strand, score, accuracy, nh_beg, nh_end, t_len, ec_beg, ec_end, ec_len FROM alignments
), iv AS (SELECT aln_id, header, CAST(least(nh_beg, nh_end) AS BIGINT) AS b, CAST(greatest(nh_beg, nh_end) AS BIGINT) AS e FROM al WHERE header IS NOT NULL AND nh_beg IS NOT NULL AND nh_end IS NOT NULL AND nh_beg <> nh_end
), evt AS (SELECT header, pos, sum(d) AS d FROM (SELECT header, b AS pos, 1 AS d FROM iv UNION ALL SELECT header, e, -1 FROM iv) GROUP BY header, pos HAVING sum(d) <> 0
), seg AS (SELECT * FROM (SELECT header, pos AS b, lead(pos) OVER w AS e, CAST(sum(d) OVER w AS BIGINT) AS depth FROM evt WINDOW w AS (PARTITION BY header ORDER BY pos)) WHERE e IS NOT NULL)"""
_PCT = "CASE WHEN accuracy <= 1 THEN accuracy * 100 ELSE accuracy END"


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments, those sent again once, headers without '>'."""
    return table(spark, sf_dir, "alignments").drop("aligned_at").withColumn("header", F.regexp_replace("header", "^>", "")).distinct()


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_segments(alignments(spark, sf_dir), "header", "nh_beg", "nh_end")


@REG.query("coverage_segments", f'WITH {_ONE} SELECT header AS entity, b AS beg, e AS "end", depth FROM seg')
def coverage_segments_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


@REG.query("zero_regions", f'WITH {_ONE} SELECT header AS entity, b AS beg, e AS "end" FROM seg WHERE depth = 0')
def zero_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(alignments(spark, sf_dir), "header", "nh_beg", "nh_end").filter("kind = 'gap'").drop("kind")


@REG.query(
    "low_coverage_runs",
    f"""WITH {_ONE}, m AS (SELECT *, CASE WHEN lag(depth < 4) OVER w IS DISTINCT FROM (depth < 4) THEN 1 ELSE 0 END AS f FROM seg WINDOW w AS (PARTITION BY header ORDER BY b)
), r AS (SELECT *, sum(f) OVER (PARTITION BY header ORDER BY b ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT header AS entity, min(b) AS beg, max(e) AS "end" FROM r WHERE depth < 4 GROUP BY header, run HAVING max(e) - min(b) > 1""",
)
def low_coverage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.low_coverage_runs(_segments(spark, sf_dir))


@REG.query("coverage_hist", f"WITH {_ONE} SELECT CAST(j AS INT) AS depth, CAST(sum(e - b) AS BIGINT) AS n_positions FROM (SELECT b, e, unnest(range(0, least(depth, 29) + 1)) AS j FROM seg) GROUP BY j")
def coverage_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.coverage_histogram(_segments(spark, sf_dir))


@REG.query("coverage_extremes", f"WITH {_ONE} SELECT header AS entity, min(depth) AS least, max(depth) AS most, arg_min(b, (depth, b)) AS least_at, CAST(sum(depth * (e - b)) AS BIGINT) AS total FROM seg GROUP BY header")
def coverage_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).groupBy("entity").agg(F.min("depth").alias("least"), F.max("depth").alias("most"), F.min_by("beg", F.struct("depth", "beg")).alias("least_at"), F.sum(F.expr("depth * (end - beg)")).alias("total"))


@REG.query(
    "interval_clusters",
    f"""WITH {_ONE}, r AS (SELECT *, max(e) OVER (PARTITION BY header ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv
), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR b >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY header ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS isle FROM r)
SELECT header AS entity, min(b) AS beg, max(e) AS "end", count(*) AS n FROM i GROUP BY header, isle""",
)
def interval_clusters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_clusters(alignments(spark, sf_dir), "header", "nh_beg", "nh_end")


@REG.query("best_clusters", f"""WITH {_ONE}, r AS (SELECT *, max(e) OVER (PARTITION BY header ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv
), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR b >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY header ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS isle FROM r
), c AS (SELECT header, isle, max(e) - min(b) AS len FROM i GROUP BY ALL), m AS (SELECT header, max(len) AS best, count(*) AS n FROM c GROUP BY header)
SELECT count(*) AS n_targets, count(*) FILTER (n > 1) AS n_with_jumps, round(avg(best), 6) AS mean_best, round(stddev_pop(best), 6) AS std_best FROM m""")
def best_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest cluster of each target: mean and deviation, and targets in more than one piece."""
    c = interval_clusters(alignments(spark, sf_dir), "header", "nh_beg", "nh_end").groupBy("entity").agg(F.max(F.expr("end - beg")).alias("best"), F.count("*").alias("n"))
    return c.agg(F.count("*").alias("n_targets"), F.count_if(F.expr("n > 1")).alias("n_with_jumps"), F.round(F.avg("best"), 6).alias("mean_best"), F.round(F.stddev_pop("best"), 6).alias("std_best"))


@REG.query("accuracy_stats", f"WITH {_ONE} SELECT header, count(accuracy) AS n, round(avg({_PCT}), 9) AS mean, round(stddev_pop({_PCT}), 9) AS std FROM (SELECT header, CASE WHEN isnan(accuracy) THEN NULL ELSE accuracy END AS accuracy FROM al) GROUP BY header")
def accuracy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.accuracy_stats(alignments(spark, sf_dir), "header").withColumns({c: F.round(c, 9) for c in ("mean", "std")})


_SIDE = """{n} AS (SELECT header AS key, max({p}) AS a, arg_max(nh_beg, ({p}, nh_beg)) AS x FROM (SELECT * FROM al WHERE accuracy IS NOT NULL AND NOT isnan(accuracy) AND nh_beg IS NOT NULL AND header IS NOT NULL AND {w}) GROUP BY header)"""


@REG.query(
    "ec_quality",
    f"""WITH {_ONE}, {_SIDE.format(n='bf', p=_PCT, w='q_strand = t_strand')}, {_SIDE.format(n='af', p=_PCT, w='q_strand <> t_strand')}
SELECT count(af.a) AS n_both, count(*) FILTER (af.a > bf.a) AS n_better, count(*) FILTER (af.a = bf.a) AS n_same, count(*) FILTER (af.a < bf.a) AS n_worse, round(avg(af.a - bf.a), 6) AS mean_gain,
  count(*) FILTER (abs(af.x - bf.x) > 10000) AS n_shifted, count(*) FILTER (af.a IS NULL) AS n_lost FROM bf LEFT JOIN af USING (key)""",
)
def ec_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best alignments of each target on one strand against those on the other."""
    rows = alignments(spark, sf_dir).filter("accuracy is not null and not isnan(accuracy) and nh_beg is not null and header is not null").withColumn("a", ev.percent())

    def best(where: str) -> DataFrame:
        return rows.filter(where).groupBy(F.col("header").alias("key")).agg(F.max(F.struct("a", "nh_beg")).alias("m")).select("key", F.col("m.a").alias("accuracy"), F.col("m.nh_beg").alias("beg"))

    return ev.before_after(best("q_strand = t_strand"), best("q_strand <> t_strand")).withColumn("mean_gain", F.round("mean_gain", 6))


@REG.query("jump_split", f"WITH {_ONE}, j AS (SELECT consensus, count(*) AS n, count(*) FILTER ((nh_beg > 100 AND ec_beg > 100) OR (t_len - nh_end > 100 AND ec_len - ec_end > 100)) AS n_broken FROM al GROUP BY 1) SELECT *, n_broken / n AS score, n_broken / n >= 0.6 AND n_broken >= 3 AS jump FROM j")
def jump_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.jump_scores(alignments(spark, sf_dir), "consensus")


@REG.query("support_percentile", f"WITH {_ONE}, r AS (SELECT header, t_len - nh_end AS v, row_number() OVER (PARTITION BY header ORDER BY t_len - nh_end) AS i, count(*) OVER (PARTITION BY header) AS n FROM al WHERE t_len - nh_end IS NOT NULL) SELECT header, v FROM r WHERE i = least(3, n)")
def support_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.support_percentile(alignments(spark, sf_dir).withColumn("v", F.expr("t_len - nh_end")), "header", "v")


@REG.query("accuracy_histogram", f"WITH {_ONE} SELECT floor({_PCT} / 0.5) * 0.5 AS bin, count(*) AS n FROM al WHERE accuracy IS NOT NULL AND NOT isnan(accuracy) GROUP BY 1")
def accuracy_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.histogram(alignments(spark, sf_dir).withColumn("pct", ev.percent()), "pct", 0.5)


_PLACES = """g AS (SELECT DISTINCT read_idx AS id, CAST(regexp_extract(read_id, 'genome_(\\d+)_', 1) AS BIGINT) AS b, CAST(regexp_extract(read_id, 'genome_\\d+_(\\d+)', 1) AS BIGINT) AS e FROM creads WHERE regexp_matches(read_id, 'genome_\\d+_\\d+'))"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = r"genome_(\d+)_(\d+)"
    return table(spark, sf_dir, "creads").filter(F.col("read_id").rlike(at)).select(F.col("read_idx").alias("id"), F.regexp_extract("read_id", at, 1).cast("bigint").alias("beg"), F.regexp_extract("read_id", at, 2).cast("bigint").alias("end")).distinct()


@REG.query("contig_overlaps", f"WITH {_PLACES} SELECT x.id AS a, y.id AS b, x.e - y.b AS overlap FROM g x JOIN g y ON x.b < y.b AND y.b < x.e AND x.e < y.e")
def contig_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.range_overlaps(_places(spark, sf_dir), 1000)


@REG.query("containment_anti", f'WITH {_PLACES} SELECT id, b AS beg, e AS "end" FROM g WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.b < g.b AND g.e < o.e)')
def containment_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.not_contained(_places(spark, sf_dir), 1000)


@REG.query("region_reads", f'WITH {_PLACES} SELECT id, b AS beg, e AS "end" FROM g WHERE b >= 5000 AND e <= 15000')
def region_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that lie in a region of the genome."""
    return _places(spark, sf_dir).filter("beg >= 5000 and end <= 15000")


@REG.query("region_covering", f"WITH {_PLACES}, {READS} SELECT id, substr(seq, CAST(10000 - b AS BIGINT) + 1, 200) AS piece FROM g JOIN reads ON id = read_idx WHERE b < 10000 AND 10200 < e")
def region_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that span a stretch of the genome, with their bases about there."""
    hit = _places(spark, sf_dir).filter("beg < 10000 and 10200 < end").join(common.reads(spark, sf_dir).withColumnRenamed("read_idx", "id"), "id")
    return hit.select("id", F.expr("substring(seq, cast(10000 - beg as int) + 1, 200)").alias("piece"))


@REG.query("aligned_share", f"WITH {_ONE}, {READS}, h AS (SELECT DISTINCT header FROM al WHERE ec_len > 0 AND 20 < nh_beg AND nh_beg < nh_end AND (ec_end - ec_beg) * 1.0 / ec_len > 0.05) SELECT * FROM reads WHERE read_id IN (SELECT header FROM h)")
def aligned_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with an alignment inside them that takes more than a twentieth of its consensus."""
    ok = alignments(spark, sf_dir).filter("ec_len > 0 and 20 < nh_beg and nh_beg < nh_end and (ec_end - ec_beg) / ec_len > 0.05").select(F.col("header").alias("read_id")).distinct()
    return common.reads(spark, sf_dir).join(ok, "read_id", "left_semi")


@REG.query("ordered_reads", f"WITH {_ONE}, {READS}, f AS (SELECT header AS read_id, min(nh_beg) AS pos FROM al WHERE nh_beg IS NOT NULL GROUP BY 1) SELECT read_id, pos, CAST(row_number() OVER (ORDER BY pos, read_id) AS INT) AS place FROM f JOIN reads USING (read_id)")
def ordered_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by the place of their first alignment, numbered: a global sort, then numbers by sorted range."""
    first = alignments(spark, sf_dir).filter("nh_beg is not null").groupBy(F.col("header").alias("read_id")).agg(F.min("nh_beg").alias("pos"))
    from pyspark.sql import Window

    from kmerloom.session import stored

    ranged = stored(first.join(common.reads(spark, sf_dir).select("read_id"), "read_id").repartitionByRange("pos", "read_id").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").count()
    before = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("pos", "read_id"))
    return ranged.withColumn("r", inside).join(F.broadcast(before), "part").select("read_id", "pos", (F.col("r") + F.col("before")).cast("int").alias("place"))  # before: a row a partition


@REG.query("seed_clusters")
def seed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begins of alignments clustered around seeds, 1000 bases wide."""
    return ev.seed_clusters(alignments(spark, sf_dir), "header", "nh_beg", 1000)


@REG.query("ktmer_report_stats", "SELECT correct, count(*) AS n, round(avg(degree), 6) AS mean_degree, round(stddev_pop(degree), 6) AS std_degree, max(degree) AS max_degree, min(degree) AS min_degree FROM (SELECT DISTINCT * FROM ktmers WHERE kmer IS NOT NULL) GROUP BY correct")
def ktmer_report_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of listed kt-mers by whether they are correct."""
    rows = table(spark, sf_dir, "ktmers").filter("kmer is not null").distinct()
    return rows.groupBy("correct").agg(F.count("*").alias("n"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.round(F.stddev_pop("degree"), 6).alias("std_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"))


@REG.query("nhood_occurrence", f"WITH {CREADS} SELECT kmer, count(*) / count(DISTINCT read_idx) AS mean_per_read, list_sort(list(CAST(pos AS VARCHAR))) AS places FROM cr GROUP BY kmer")
def nhood_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a kt-mer stands in the reads that hold it, and its places as text."""
    return common.creads(spark, sf_dir).groupBy("kmer").agg((F.count("*") / F.count_distinct("read_idx")).alias("mean_per_read"), F.array_sort(F.collect_list(F.col("pos").cast("string"))).alias("places"))


@REG.query("running_rates", f"WITH {CREADS}, n AS (SELECT read_idx, count(*) AS n, any_value(len) AS len FROM cr GROUP BY 1) SELECT read_idx, round(avg(n) OVER (PARTITION BY len // 100 ORDER BY read_idx ROWS UNBOUNDED PRECEDING), 6) AS running_mean FROM n")
def running_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running mean of the kt-mers of a read, in classes of read length."""
    from pyspark.sql import Window

    n = common.creads(spark, sf_dir).groupBy("read_idx").agg(F.count("*").alias("n"), F.first("len").alias("len"))
    order = Window.partitionBy(F.expr("len div 100")).orderBy("read_idx").rowsBetween(Window.unboundedPreceding, 0)
    return n.select("read_idx", F.round(F.avg("n").over(order), 6).alias("running_mean"))


@REG.query("split_at_points", f"""WITH {READS}, {_ONE}, p AS (SELECT header AS read_id, list_sort(list(DISTINCT CAST(nh_end AS INT))) AS pts FROM al WHERE nh_end > 0 GROUP BY 1
), c AS (SELECT read_id, seq, list_concat([0], list_filter(pts, lambda x: x < len), [len]) AS q FROM reads JOIN p USING (read_id))
SELECT read_id, CAST(i AS INT) AS n, substr(seq, q[i] + 1, q[i + 1] - q[i]) AS piece FROM (SELECT *, unnest(range(1, len(q))) AS i FROM c)""".replace("AS piece FROM (SELECT *", "AS piece FROM (SELECT read_id, seq, q"))
def split_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads cut at the ends of their alignments."""
    points = alignments(spark, sf_dir).filter("nh_end > 0").groupBy(F.col("header").alias("read_id")).agg(F.array_sort(F.collect_set("nh_end")).alias("pts"))
    cut = common.reads(spark, sf_dir).join(points, "read_id").select("read_id", "seq", F.expr("concat(array(0), filter(pts, x -> x < len), array(len))").alias("q"))
    return cut.select("read_id", "seq", "q", F.explode(F.expr("sequence(1, size(q) - 1)")).alias("n")).select("read_id", "n", F.expr("substring(seq, q[n - 1] + 1, q[n] - q[n - 1])").alias("piece"))
