"""Queries on graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators import graph, nhood
from kmerloom.operators.kmers import choose_ktmers, kmer_counts
from kmerloom.plans import common
from kmerloom.plans.registry import Registry
from kmerloom.plans.sql import CREADS, READS, kmers
from kmerloom.session import stored, table

REG = Registry()
K, T_MIN = 15, 5

_DB = f"{READS}, {kmers(K)}, kt AS (SELECT kmer, count(*) AS t FROM km GROUP BY kmer HAVING count(*) >= {T_MIN}), e AS (SELECT left(kmer, {K - 1}) AS src, right(kmer, {K - 1}) AS dst, CAST(sum(t) AS BIGINT) AS t FROM kt GROUP BY ALL)"


def _degree_sql(edges: str, name: str) -> str:
    return f"{name} AS (SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM {edges} UNION ALL SELECT dst, 1, 0 FROM {edges}) GROUP BY node)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = kmer_counts(common.reads(spark, sf_dir), K)
    return stored(graph.de_bruijn(choose_ktmers(counts, T_MIN, palindromes=True, low_complexity=True)))


@REG.query("debruijn_edges", f"WITH {_DB} SELECT * FROM e")
def debruijn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@REG.query("debruijn_degrees", f"WITH {_DB}, {_degree_sql('e', 'd')} SELECT * FROM d")
def debruijn_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir))


def _trim_sql(a: str, b: str) -> str:
    leaf = f"SELECT node FROM d{a} WHERE n_in = 0 OR n_out = 0"
    return f"{_degree_sql(a, 'd' + a)}, {b} AS (SELECT * FROM {a} WHERE src NOT IN ({leaf}) AND dst NOT IN ({leaf}))"


@REG.query("trim_leaves_2", f"WITH {_DB}, {_trim_sql('e', 'e1')}, {_trim_sql('e1', 'e2')} SELECT * FROM e2")
def trim_leaves_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trim_leaves(_edges(spark, sf_dir), 2)


@REG.query("start_nodes", f"WITH {_DB}, {_degree_sql('e', 'd')} SELECT node FROM d WHERE n_in = 0 AND n_out = 1")
def start_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.start_nodes(_edges(spark, sf_dir))


@REG.query("end_nodes", f"WITH {_DB}, {_degree_sql('e', 'd')} SELECT node, n_in = 0 AS source FROM d WHERE n_in = 0 OR n_out = 0")
def end_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    return graph.no_edge_in(e).withColumn("source", F.lit(True)).unionByName(graph.no_edge_out(e).withColumn("source", F.lit(False)))


@REG.query("abruijn_edges", f"WITH {CREADS}, s AS (SELECT lag(kmer) OVER w AS src, kmer AS dst, pos - coalesce(lag(pos) OVER w, 0) AS dist FROM cr WINDOW w AS (PARTITION BY read_idx ORDER BY ord)) SELECT coalesce(src, 'head') AS src, dst, dist, count(*) AS n_reads FROM s GROUP BY ALL")
def abruijn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.a_bruijn(common.creads(spark, sf_dir))


@REG.query(
    "components",
    f"""WITH RECURSIVE {CREADS}, s AS (SELECT lag(kmer) OVER (PARTITION BY read_idx ORDER BY ord) AS src, kmer AS dst FROM cr WHERE kmer IN (SELECT kmer FROM cr GROUP BY kmer HAVING count(DISTINCT read_idx) <= 6)
), l AS (SELECT DISTINCT src, dst FROM s WHERE src IS NOT NULL UNION SELECT DISTINCT dst, src FROM s WHERE src IS NOT NULL), r(node, seen) AS (SELECT src, src FROM l UNION SELECT l.dst, r.seen FROM r JOIN l ON l.src = r.node WHERE r.seen < l.dst OR true)
SELECT node, min(seen) AS component FROM r GROUP BY node""",
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph of successive kt-mers, those of more than 6 reads left out."""
    e = graph.a_bruijn(nhood.usable(common.creads(spark, sf_dir), 6)).filter("src <> 'head'")
    return graph.components(stored(e.select("src", "dst").distinct()))


@REG.query("connection_rate")
def connection_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of listed kt-mers the graph of successive kt-mers connects."""
    e = stored(graph.a_bruijn(nhood.usable(common.creads(spark, sf_dir), 55)).filter("src <> 'head'").select("src", "dst").distinct())
    return graph.connection_rate(common.listed(spark, sf_dir).withColumnRenamed("kmer", "node"), graph.components(e))


@REG.query("unitigs")
def unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of the maximal paths without branching of the de Bruijn graph."""
    return graph.unitig_strings(graph.unitigs(_edges(spark, sf_dir)))


@REG.query("unitig_lengths")
def unitig_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unitigs(_edges(spark, sf_dir)).groupBy("unitig").agg(F.count("*").alias("n_nodes"), F.max("ord").alias("diameter"))


def _placed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, shift, at, to): reads that go on to the right of another by their places, the shift in bases and the begins of both; an acyclic graph."""
    own = table(spark, sf_dir, "creads").filter(F.col("read_id").rlike(r"genome_\d+_\d+")).select("read_idx", F.regexp_extract("read_id", r"genome_(\d+)_", 1).cast("bigint").alias("b"), F.regexp_extract("read_id", r"genome_\d+_(\d+)", 1).cast("bigint").alias("e")).distinct().filter("b < e")
    cut = own.withColumn("cell", F.explode(F.sequence(F.floor(F.col("b") / 1000), F.floor((F.col("e") - 1) / 1000))))
    x = cut.select("cell", F.col("read_idx").alias("src"), F.col("b").alias("b1"), F.col("e").alias("e1"))
    y = cut.select("cell", F.col("read_idx").alias("dst"), F.col("b").alias("b2"), F.col("e").alias("e2"))
    return x.join(y, "cell").filter("b1 < b2 and b2 < e1 and e1 < e2").select("src", "dst", (F.col("e2") - F.col("e1")).alias("shift"), F.col("b1").alias("at"), F.col("b2").alias("to")).distinct()


def overlap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, shift) of the overlaps."""
    return _placed_overlaps(spark, sf_dir).select("src", "dst", "shift").distinct()


_OV = """g AS (SELECT DISTINCT read_idx, CAST(regexp_extract(read_id, 'genome_(\\d+)_', 1) AS BIGINT) AS b, CAST(regexp_extract(read_id, 'genome_\\d+_(\\d+)', 1) AS BIGINT) AS e FROM creads WHERE regexp_matches(read_id, 'genome_\\d+_\\d+')
), ov AS (SELECT x.read_idx AS src, y.read_idx AS dst, y.e - x.e AS shift FROM g x JOIN g y ON x.b < y.b AND y.b < x.e AND x.e < y.e)"""


@REG.query("overlap_edges", f"WITH {_OV} SELECT * FROM ov")
def overlap_edges_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_edges(spark, sf_dir)


@REG.query("longest_paths", f"WITH RECURSIVE {_OV}, n AS (SELECT src AS node FROM ov UNION SELECT dst FROM ov), r(node, best) AS (SELECT node, CAST(0 AS BIGINT) FROM n UNION SELECT dst, best + shift FROM r JOIN ov ON src = node) SELECT node, max(best) AS best FROM r GROUP BY node")
def longest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the reads' overlaps reach to the right of the first read of their path."""
    return graph.placed_longest_paths(_placed_overlaps(spark, sf_dir).withColumnRenamed("shift", "w"))


@REG.query("overlap_report")
def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the overlap graph with their reads and the longest reach; single reads are components of their own."""
    e = stored(overlap_edges(spark, sf_dir))
    alone = table(spark, sf_dir, "creads").select(F.col("read_idx").alias("node")).filter("node is not null").distinct().join(graph.components(e), "node", "left")
    return alone.groupBy(F.coalesce("component", "node").alias("component")).agg(F.count("*").alias("n_reads"))


@REG.query("bounded_neighbourhood")
def bounded_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kt-mers within 200 bases of each listed kt-mer of degree 20 and more, along the edges of successive kt-mers."""
    seeds = table(spark, sf_dir, "ktmers").filter("degree >= 20 and kmer is not null").select(F.upper("kmer").alias("node")).distinct()
    e = graph.a_bruijn(nhood.usable(common.creads(spark, sf_dir), 55)).filter("src <> 'head'").groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    return graph.bounded_neighbourhood(stored(e), seeds, 200)


@REG.query("path_exists", f"WITH {READS}, {kmers(K)}, kt AS (SELECT kmer FROM km GROUP BY kmer HAVING count(*) >= {T_MIN}), {kmers(K, name='rk')} SELECT read_idx AS id, bool_and(kmer IN (SELECT kmer FROM kt)) AS complete FROM rk GROUP BY read_idx")
def path_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all k-mers of a read are edges of the de Bruijn graph."""
    from kmerloom.functions.dna import kmer_array

    paths = common.reads(spark, sf_dir).filter(F.col("len") >= K).select(F.col("read_idx").alias("id"), kmer_array("seq", K - 1).alias("nodes"))
    return graph.path_exists(paths, _edges(spark, sf_dir))


@REG.query("ktmer_walks")
def ktmer_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks along the best-supported successor from every kt-mer that begins a read and follows none."""
    e = stored(graph.a_bruijn(nhood.usable(common.creads(spark, sf_dir), 55)).groupBy("src", "dst").agg(F.sum("n_reads").alias("n_reads")))
    heads = e.filter("src = 'head'").select(F.col("dst").alias("node")).join(e.filter("src <> 'head'").select(F.col("dst").alias("node")), "node", "left_anti")
    return graph.walk(e.filter("src <> 'head'"), heads)
