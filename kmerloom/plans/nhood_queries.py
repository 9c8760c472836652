"""Queries on neighbourhoods and k-mer degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions.dna import kmer_rows
from kmerloom.operators import hammer, nhood
from kmerloom.operators.kmers import kmer_counts, members_of, postings_of, reads_of
from kmerloom.plans import common
from kmerloom.plans.registry import Registry
from kmerloom.plans.sql import CONTIG_LEN, CONTIGS, CREADS, LISTED, READS, kmers
from kmerloom.session import table

REG = Registry()
T_MAX = 55

_US = f"""{CREADS}, us AS (SELECT * FROM cr WHERE kmer IN (SELECT kmer FROM cr GROUP BY kmer HAVING count(DISTINCT read_idx) <= {T_MAX})
), ud AS (SELECT DISTINCT kmer, read_idx FROM us), near AS (
  SELECT a.read_idx AS base, b.read_idx AS neighbour, count(*) AS n_shared FROM ud a JOIN ud b ON a.kmer = b.kmer AND a.read_idx <> b.read_idx GROUP BY ALL
), ff AS (SELECT read_idx, kmer, min(pos) AS pos FROM us GROUP BY ALL)"""


@REG.query("nhood_1deg", f"WITH {_US} SELECT * FROM near")
def nhood_1deg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nhood.neighbours(common.creads(spark, sf_dir), T_MAX)


@REG.query("nhood_size_gate", f"WITH {_US}, s AS (SELECT base, count(*) AS n FROM near GROUP BY base) SELECT base, n, n > 2 AND n < 50 AS usable FROM s")
def nhood_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = nhood.neighbours(common.creads(spark, sf_dir), T_MAX).groupBy("base").agg(F.count("*").alias("n"))
    return sizes.withColumn("usable", F.expr("n > 2 and n < 50"))


@REG.query("ktmer_neighbours", f"WITH {_US} SELECT a.kmer, b.kmer AS neighbour, count(*) AS n FROM ud a JOIN us b ON a.read_idx = b.read_idx AND a.kmer <> b.kmer GROUP BY ALL")
def ktmer_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nhood.ktmer_neighbours(common.creads(spark, sf_dir), T_MAX)


@REG.query(
    "nhood_special",
    f"""WITH {_US}, st AS (SELECT a.read_idx AS base, b.read_idx AS neighbour, a.pos AS x, b.pos AS y,
    a.pos - lag(a.pos) OVER w AS dx, b.pos - lag(b.pos) OVER w AS dy FROM ff a JOIN ff b ON a.kmer = b.kmer AND a.read_idx <> b.read_idx
  WINDOW w AS (PARTITION BY a.read_idx, b.read_idx ORDER BY a.pos, b.pos))
SELECT base, neighbour, count(*) AS n_shared, min(x) AS base_beg, max(x) AS base_end, min(y) AS read_beg, max(y) AS read_end FROM st GROUP BY base, neighbour
HAVING min(dy) >= 0 AND max(greatest(dx, dy)) <= 100000 AND sum(dx) >= 350 AND sum(dy) >= 350""",
)
def nhood_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nhood.ordered_neighbours(common.creads(spark, sf_dir), T_MAX, 100_000, 350)


@REG.query("nhood_2deg", f"WITH {_US} SELECT base, neighbour FROM near UNION SELECT a.base, b.neighbour FROM near a JOIN near b ON a.neighbour = b.base WHERE a.base <> b.neighbour")
def nhood_2deg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nhood.second_degree(nhood.neighbours(common.creads(spark, sf_dir), T_MAX))


_SCORE = f"""{READS}, {CONTIGS}, {{base}}, {kmers(15)}, sc AS (SELECT c.contig AS base, km.read_idx, count(*) AS score FROM km JOIN (SELECT DISTINCT contig, kmer FROM ck) c USING (kmer) WHERE c.contig <> km.read_idx GROUP BY ALL)"""


@REG.query(
    "kmer_matching_top51",
    f"WITH {_SCORE.format(base=kmers(15, 'contigs', 'contig', 'ck'))} SELECT * FROM (SELECT base, read_idx, score, CAST(row_number() OVER (PARTITION BY base ORDER BY score DESC, read_idx) AS INT) AS rank FROM sc WHERE score >= 100) WHERE rank <= 51",
)
def kmer_matching_top51(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that match each contig best by 15-mers, 100 at least."""
    own = reads_of(table(spark, sf_dir, "fasta_reads"))
    return nhood.best_matches(nhood.high_scores(own, own.filter(F.col("len") > CONTIG_LEN), 15, 100), 100)


@REG.query(
    "kmer_matching_centre",
    f"WITH {_SCORE.format(base='ck0 AS (' + kmers(15, 'contigs', 'contig, len', 'ck')[7:-1] + '), ck AS (SELECT contig, kmer FROM ck0 WHERE pos >= (len - 500) // 2 AND pos < (len + 500) // 2)')} SELECT base, read_idx, score FROM sc WHERE score >= 30",
)
def kmer_matching_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the k-mers of the contigs' central 500 bases."""
    base = common.contigs(spark, sf_dir).withColumnRenamed("contig", "read_idx")
    return nhood.matching_scores(common.reads(spark, sf_dir), base, 15, 500).filter("score >= 30")


_EDGES = "ed AS (SELECT src, ktmers[i] AS dst, dists[i] AS dist FROM (SELECT *, unnest(range(1, len(ktmers) + 1)) AS i FROM (SELECT src, any_value(ktmers) AS ktmers, any_value(dists) AS dists FROM ktmer_edges WHERE src IS NOT NULL GROUP BY src)) WHERE ktmers[i] IS NOT NULL)"
_POST = "po AS (SELECT DISTINCT kmer, regexp_replace(h, '^>', '') AS read_id FROM (SELECT kmer, unnest(headers) AS h FROM ktmer_headers) WHERE h IS NOT NULL AND kmer IS NOT NULL)"


@REG.query("ktmer_edges_long", f"WITH {_EDGES} SELECT * FROM ed")
def ktmer_edges_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nhood.long_edges(table(spark, sf_dir, "ktmer_edges"))


@REG.query("reads_by_edges", f"WITH {_EDGES}, {_POST} SELECT DISTINCT src, read_id FROM ed JOIN po ON dst = kmer")
def reads_by_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nhood.reads_by_edges(nhood.long_edges(table(spark, sf_dir, "ktmer_edges")), members_of(table(spark, sf_dir, "ktmer_headers")))


@REG.query("ktmer_reads", f"WITH {_POST}, {READS} SELECT kmer, read_id, seq FROM po JOIN reads USING (read_id)")
def ktmer_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kt-mers with the sequences of the reads that hold them."""
    return postings_of(table(spark, sf_dir, "ktmer_headers")).join(common.reads(spark, sf_dir).select("read_id", "seq"), "read_id").select("kmer", "read_id", "seq")


@REG.query("reads_by_headers", f"WITH {READS} SELECT * FROM reads WHERE read_id IN (SELECT regexp_replace(header, '^>', '') FROM alignments WHERE header IS NOT NULL)")
def reads_by_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that are the target of an alignment."""
    wanted = table(spark, sf_dir, "alignments").select(F.regexp_replace("header", "^>", "").alias("read_id")).distinct()
    return common.reads(spark, sf_dir).join(wanted, "read_id", "left_semi")


@REG.query("signed_distances", f"WITH {_US} SELECT a.kmer AS a, b.kmer AS b, a.read_idx, b.pos - a.pos AS dist FROM ff a JOIN ff b ON a.read_idx = b.read_idx AND a.kmer < b.kmer")
def signed_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nhood.signed_distances(common.creads(spark, sf_dir), T_MAX)


@REG.query("direction_test", f"WITH {CREADS}, l AS (SELECT kmer, read_idx, max(pos) AS pos, max(len) AS len FROM cr GROUP BY ALL) SELECT kmer, count(*) FILTER (len - pos > 500) >= 3 AS forward, count(*) FILTER (pos > 500) >= 3 AS backward FROM l GROUP BY kmer")
def direction_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nhood.direction_test(common.creads(spark, sf_dir))


@REG.query("richest_read", f"WITH {CREADS}, n AS (SELECT read_idx, count(*) AS n FROM cr GROUP BY 1), h AS (SELECT DISTINCT kmer, read_idx, n FROM cr JOIN n USING (read_idx)) SELECT kmer, read_idx, n FROM h QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY n DESC, read_idx) = 1")
def richest_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nhood.richest_read(common.creads(spark, sf_dir))


@REG.query("duplicates_only", f"WITH {CREADS} SELECT read_idx, kmer, count(*) AS n FROM cr GROUP BY ALL HAVING count(*) > 1")
def duplicates_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nhood.repeated_only(common.creads(spark, sf_dir), "read_idx", "kmer")


@REG.query("rc_pair_dedupe", "WITH h AS (SELECT regexp_replace(regexp_replace(header, '^>', ''), '^R_', '') AS stem FROM fasta_reads WHERE header IS NOT NULL) SELECT stem FROM h GROUP BY stem HAVING count(*) % 2 = 1")
def rc_pair_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nhood.drop_strand_pairs(table(spark, sf_dir, "fasta_reads").filter("header is not null"), "header")


@REG.query("successor_ktmers", f"WITH {CREADS} SELECT read_idx, ord, kmer, lead(kmer) OVER w AS next_kmer, lead(pos) OVER w - pos AS step FROM cr WINDOW w AS (PARTITION BY read_idx ORDER BY ord)")
def successor_ktmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nhood.successor_ktmers(common.creads(spark, sf_dir))


@REG.query("after_last_repeat", f"WITH {CREADS}, r AS (SELECT read_idx, kmer, max(ord) AS last FROM cr GROUP BY ALL HAVING count(*) > 1), l AS (SELECT read_idx, max(last) AS last FROM r GROUP BY 1) SELECT cr.read_idx, arg_min(kmer, ord) AS kmer, min(ord) AS ord FROM cr JOIN l USING (read_idx) WHERE ord > last GROUP BY 1")
def after_last_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nhood.after_last_repeat(common.creads(spark, sf_dir))


@REG.query("distance_to_ends", f'WITH {CREADS} SELECT read_idx, kmer, max(pos) AS "left", max(len) - max(pos) AS "right" FROM cr GROUP BY ALL')
def distance_to_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nhood.distance_to_ends(common.creads(spark, sf_dir))


_TRUTH = """g AS (SELECT read_idx, CAST(regexp_extract(read_id, 'genome_(\\d+)_', 1) AS BIGINT) AS b, CAST(regexp_extract(read_id, 'genome_\\d+_(\\d+)', 1) AS BIGINT) AS e FROM one_cread WHERE regexp_matches(read_id, 'genome_\\d+_\\d+')
), truth AS (SELECT x.read_idx AS base, y.read_idx AS neighbour FROM g x JOIN g y ON x.read_idx <> y.read_idx AND x.b < y.e AND y.b < x.e)"""


@REG.query(
    "nhood_sens_spec",
    f"""WITH {_US}, {_TRUTH}, p AS (SELECT base, count(*) FILTER (f) AS nf, count(*) FILTER (t) AS nt, count(*) FILTER (f AND t) AS nb FROM (
  SELECT coalesce(a.base, b.base) AS base, a.base IS NOT NULL AS f, b.base IS NOT NULL AS t FROM near a FULL JOIN truth b ON a.base = b.base AND a.neighbour = b.neighbour) GROUP BY base)
SELECT count(*) AS n_bases, round(avg(nb / nullif(nt, 0)), 6) AS sensitivity, round(avg(nb / nullif(nf, 0)), 6) AS "precision" FROM p""",
)
def nhood_sens_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbourhoods against the overlaps of the places that the headers name."""
    own = common.creads(spark, sf_dir)
    at = r"genome_(\d+)_(\d+)"
    places = table(spark, sf_dir, "creads").filter(F.col("read_id").rlike(at)).select("read_idx", *[F.regexp_extract("read_id", at, i).cast("bigint").alias(n) for i, n in ((1, "b"), (2, "e"))]).distinct()
    # an equi-join on pieces of the genome in place of a range join over all pairs
    cut = places.filter("b < e").withColumn("cell", F.explode(F.sequence(F.floor(F.col("b") / 1000), F.floor((F.col("e") - 1) / 1000))))
    x = cut.select("cell", F.col("read_idx").alias("base"), F.col("b").alias("b1"), F.col("e").alias("e1"))
    y = cut.select("cell", F.col("read_idx").alias("neighbour"), F.col("b").alias("b2"), F.col("e").alias("e2"))
    truth = x.join(y, "cell").filter("base <> neighbour and b1 < e2 and b2 < e1").select("base", "neighbour").distinct()
    return nhood.sensitivity_precision(nhood.neighbours(own, T_MAX), truth).withColumns({c: F.round(c, 6) for c in ("sensitivity", "precision")})


_VAR = """va AS (SELECT kmer, unnest(list_concat(
    list_distinct(list_filter([substr(kmer, 1, CAST(i AS BIGINT) - 1) || substr(kmer, CAST(i AS BIGINT) + 1) for i in range(1, length(kmer) + 1)], lambda d: d <> left(kmer, length(kmer) - 1) AND d <> right(kmer, length(kmer) - 1))),
    list_distinct(list_filter(flatten([[substr(kmer, 1, CAST(i AS BIGINT)) || b || substr(kmer, CAST(i AS BIGINT) + 1) for b in ['A','C','G','T']] for i in range(0, length(kmer) + 1)]), lambda x: left(x, length(kmer)) <> kmer AND right(x, length(kmer)) <> kmer)))) AS v FROM k8)"""
_DEG = f"{READS}, {kmers(8)}, {kmers(7, name='k7')}, {kmers(9, name='k9')}, k8 AS (SELECT kmer, count(*) AS t FROM km WHERE NOT regexp_matches(kmer, '[^ACGT]') GROUP BY kmer HAVING count(*) >= 40), cn AS (SELECT kmer, count(*) AS t FROM (SELECT kmer FROM k7 UNION ALL SELECT kmer FROM k9) GROUP BY kmer), {_VAR}, dg AS (SELECT k8.kmer, CAST(coalesce(sum(cn.t), 0) AS BIGINT) AS degree FROM k8 LEFT JOIN va ON va.kmer = k8.kmer LEFT JOIN cn ON cn.kmer = va.v GROUP BY k8.kmer)"


def _degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = common.reads(spark, sf_dir)
    chosen = kmer_counts(own, 8).filter(F.col("kmer").rlike("^[ACGT]+$") & (F.col("t") >= 40))
    return hammer.degrees(own, chosen, 8)


@REG.query("hammer_degree_k8", f"WITH {_DEG} SELECT * FROM dg")
def hammer_degree_k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _degrees(spark, sf_dir)


@REG.query("top_degree", f"WITH {_DEG} SELECT * FROM dg ORDER BY degree DESC, kmer LIMIT 100")
def top_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hammer.top_by_degree(_degrees(spark, sf_dir), 100)


@REG.query("top_degree_with_ties", f"WITH {_DEG} SELECT kmer, degree FROM dg QUALIFY rank() OVER (ORDER BY degree DESC) <= 100")
def top_degree_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hammer.top_with_ties(_degrees(spark, sf_dir), 100)


@REG.query("independent_kmers")
def independent_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-mers chosen by degree so that none is an indel away from another."""
    rows = _degrees(spark, sf_dir)
    return hammer.independent(rows, hammer.neighbour_pairs(rows))


@REG.query("thinned_ktmers")
def thinned_ktmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed kt-mers thinned so that no two stand in one read, by degree."""
    degree = table(spark, sf_dir, "ktmers").filter("kmer is not null").groupBy(F.upper("kmer").alias("kmer")).agg(F.max(F.coalesce("degree", F.lit(0))).alias("degree"))
    pairs = nhood.ktmer_neighbours(common.creads(spark, sf_dir), T_MAX).select("kmer", "neighbour")
    own = degree.select("kmer")
    inside = pairs.join(own, "kmer", "left_semi").join(own.withColumnRenamed("kmer", "neighbour"), "neighbour", "left_semi")
    return hammer.independent(degree, inside)


@REG.query(
    "split_scores",
    f"""WITH {_US}, s AS (SELECT base, neighbour AS id, n_shared AS score FROM near), c AS (
  SELECT base, row_number() OVER w AS n_top, count(*) OVER (PARTITION BY base) AS n, stddev_pop(CAST(score AS DOUBLE)) OVER (w ROWS UNBOUNDED PRECEDING) + stddev_pop(CAST(score AS DOUBLE)) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS spread
  FROM s WINDOW w AS (PARTITION BY base ORDER BY score DESC, id))
SELECT base, CAST(n_top AS INT) AS n_top, n - n_top AS n_rest FROM c WHERE n_top < n QUALIFY row_number() OVER (PARTITION BY base ORDER BY round(spread, 9), n_top) = 1""",
)
def split_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read's neighbours cut in two by the number of shared kt-mers."""
    near = nhood.neighbours(common.creads(spark, sf_dir), T_MAX).select("base", F.col("neighbour").alias("id"), F.col("n_shared").alias("score"))
    return hammer.split_scores(near, "base", "score")
