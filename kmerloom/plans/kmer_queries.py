"""Queries on reads and k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions import dna
from kmerloom.operators import kmers as km
from kmerloom.plans import common
from kmerloom.plans.registry import Registry
from kmerloom.plans.sql import CONTIGS, CREADS, LISTED, READS, kmers, plain_complexity, rc
from kmerloom.session import table

REG = Registry()
K, T_MIN, T_MAX = 15, 4, 55


@REG.query("reads", f"WITH {READS} SELECT * FROM reads")
def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.reads(spark, sf_dir)


@REG.query("revcomp_union", f"WITH {READS} SELECT read_idx, '>R_' || read_id AS header, {rc('seq')} AS seq, 0 AS strand FROM reads UNION ALL SELECT read_idx, '>' || read_id, seq, 1 FROM reads")
def revcomp_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads beside their reverse complements, those first in the order (read_idx, strand)."""
    own = common.reads(spark, sf_dir)
    back = own.select("read_idx", F.concat(F.lit(">R_"), "read_id").alias("header"), dna.reverse_complement("seq").alias("seq"), F.lit(0).alias("strand"))
    return back.unionByName(own.select("read_idx", F.concat(F.lit(">"), "read_id").alias("header"), "seq", F.lit(1).alias("strand")))


@REG.query("kmer_counts_k15", f"WITH {READS}, {kmers(K)} SELECT kmer, count(*) AS t FROM km GROUP BY kmer")
def kmer_counts_k15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.kmer_counts(common.reads(spark, sf_dir), K)


_KT = f"kt AS (SELECT kmer, count(*) AS t FROM km GROUP BY kmer HAVING count(*) BETWEEN {T_MIN} AND {T_MAX} AND kmer <> {rc('kmer')} AND {plain_complexity('kmer')})"


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.choose_ktmers(km.kmer_counts(common.reads(spark, sf_dir), K), T_MIN, T_MAX)


@REG.query("ktmers_t4_55", f"WITH {READS}, {kmers(K)}, {_KT} SELECT * FROM kt")
def ktmers_t4_55(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir)


@REG.query("top_kmers", f"WITH {READS}, {kmers(K)}, c AS (SELECT kmer, count(*) AS t FROM km GROUP BY kmer) SELECT * FROM c ORDER BY t DESC, kmer LIMIT 51")
def top_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.kmer_counts(common.reads(spark, sf_dir), K).orderBy(F.desc("t"), "kmer").limit(51)


@REG.query(
    "multi_k_counts",
    "WITH " + READS + ", " + ", ".join(kmers(k, name=f"k{k}") for k in (7, 8, 9)) + " " + " UNION ALL ".join(f"SELECT {k} AS k, kmer, count(*) AS t FROM k{k} GROUP BY kmer" for k in (7, 8, 9)),
)
def multi_k_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.multi_k_counts(common.reads(spark, sf_dir), [7, 8, 9])


@REG.query("gapped_kmers", f"WITH {READS}, {kmers(13)} SELECT substr(kmer, 1, 5) AS k1, substr(kmer, 9, 5) AS k2, count(*) AS t FROM km GROUP BY 1, 2 HAVING count(*) >= 5")
def gapped_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.gapped_counts(common.reads(spark, sf_dir), 5, 3, 5)


@REG.query(
    "gapped_overlaps",
    f"""WITH {READS}, {kmers(13)}, {kmers(10, name="k10")}, g AS (SELECT substr(kmer, 1, 5) AS k1, substr(kmer, 9, 5) AS k2, count(*) AS t FROM km GROUP BY 1, 2 HAVING count(*) >= 5
), kt AS (SELECT kmer FROM k10 GROUP BY kmer HAVING count(*) >= 15)
SELECT k1, k2, kmer FROM g JOIN kt ON k1 = left(kmer, 5) AND left(k2, 4) = right(kmer, 4)""",
)
def gapped_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = common.reads(spark, sf_dir)
    return km.gapped_overlaps(km.gapped_counts(own, 5, 3, 5), km.kmer_counts(own, 10).filter("t >= 15"), 5)


@REG.query("read_libraries", f"WITH {READS}, {kmers(K)}, l AS (SELECT kmer, read_idx, count(*) AS n FROM km GROUP BY ALL) SELECT kmer, count(*) AS n_reads, max(n) AS most FROM l GROUP BY kmer HAVING count(*) > 1")
def read_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.read_libraries(common.reads(spark, sf_dir), K).groupBy("kmer").agg(F.count("*").alias("n_reads"), F.max("n").alias("most")).filter("n_reads > 1")


_ENC = f"""enc AS (SELECT read_idx, CAST(row_number() OVER w - 1 AS INT) AS ord, kmer, CAST(pos AS INT) AS pos, CAST(pos - coalesce(lag(pos) OVER w, 0) AS INT) AS gap
  FROM km WHERE kmer IN (SELECT kmer FROM kt) WINDOW w AS (PARTITION BY read_idx ORDER BY pos))"""


@REG.query("creads_of_reads", f"WITH {READS}, {kmers(K)}, {_KT}, {_ENC} SELECT * FROM enc")
def creads_of_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.encode_reads(common.reads(spark, sf_dir), _chosen(spark, sf_dir), K)


@REG.query(
    "cread_lines",
    f"""WITH {READS}, {kmers(18)}, kt AS (SELECT kmer FROM {"(SELECT DISTINCT upper(kmer) AS kmer FROM ktmers WHERE kmer IS NOT NULL)"}), {_ENC}, l AS (
  SELECT read_idx, list(kmer ORDER BY pos) AS ks, list(gap ORDER BY pos) AS gs, max(pos) AS last FROM enc GROUP BY read_idx)
SELECT r.read_idx, coalesce(ks, []) AS ktmers, list_append(coalesce(gs, []), CASE WHEN len >= 18 THEN len - coalesce(last, 0) ELSE 17 END) AS dists FROM reads r LEFT JOIN l USING (read_idx)""",
)
def cread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads re-encoded by the listed kt-mers; the distances of a read sum to its length."""
    own = common.reads(spark, sf_dir)
    return km.cread_lines(own, km.encode_reads(own, common.listed(spark, sf_dir), 18), 18)


@REG.query("ktmers_per_read", f"WITH {READS}, {kmers(K)}, {_KT}, c AS (SELECT read_idx, count(*) AS n FROM km WHERE kmer IN (SELECT kmer FROM kt) GROUP BY 1) SELECT read_idx, coalesce(n, 0) AS n_ktmers FROM reads LEFT JOIN c USING (read_idx)")
def ktmers_per_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = common.reads(spark, sf_dir)
    return km.ktmers_per_read(own, km.encode_reads(own, _chosen(spark, sf_dir), K))


@REG.query("cread_positions", f"WITH {CREADS} SELECT * FROM cr")
def cread_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.creads(spark, sf_dir)


@REG.query("headers_index", f"WITH {CREADS} SELECT kmer, list_sort(list(DISTINCT read_id)) AS read_ids FROM cr GROUP BY kmer")
def headers_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.headers_index(common.creads(spark, sf_dir))


@REG.query("postings", "SELECT DISTINCT kmer, regexp_replace(h, '^>', '') AS read_id FROM (SELECT kmer, unnest(headers) AS h FROM ktmer_headers) WHERE h IS NOT NULL AND kmer IS NOT NULL")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.postings_of(table(spark, sf_dir, "ktmer_headers"))


@REG.query("read_length_stats", f"WITH {READS} SELECT count(*) AS n_reads, CAST(sum(len) AS BIGINT) AS total_bases, round(avg(len), 6) AS mean_len, round(stddev_pop(len), 6) AS std_len FROM reads")
def read_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.read_length_stats(common.reads(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_len", "std_len")})


@REG.query(
    "homopolymer_windows",
    f"""WITH {READS}, r AS (SELECT length(unnest(regexp_extract_all(seq, 'A+|C+|G+|T+'))) AS l FROM reads)
SELECT CAST(s AS INT) AS size, CAST(sum(l - s + 1) AS BIGINT) AS n_windows FROM (SELECT l, unnest(range(5, l + 1)) AS s FROM r WHERE l >= 5) GROUP BY s""",
)
def homopolymer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.homopolymer_windows(common.reads(spark, sf_dir))


_GENOME = f"{READS}, {CONTIGS}, {kmers(18, 'contigs', 'contig, len', 'gk')}, {LISTED}, hit AS (SELECT contig, len, CAST(pos AS INT) AS pos, kmer FROM gk WHERE kmer IN (SELECT kmer FROM listed))"


def _genome_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna.kmer_rows(common.contigs(spark, sf_dir), "seq", 18, "contig", "len").join(common.listed(spark, sf_dir), "kmer", "left_semi")


@REG.query("genome_ktmer_positions", f"WITH {_GENOME} SELECT contig, pos, kmer FROM hit")
def genome_ktmer_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _genome_hits(spark, sf_dir).select("contig", "pos", "kmer")


@REG.query(
    "genome_ktmer_gaps",
    f"""WITH {_GENOME} SELECT contig, pos, CAST(pos - coalesce(lag(pos) OVER (PARTITION BY contig ORDER BY pos), -1) AS INT) AS gap FROM hit
UNION ALL SELECT contig, NULL, CAST(max(len) - max(pos) - 1 AS INT) FROM hit GROUP BY contig""",
)
def genome_ktmer_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.genome_gaps(_genome_hits(spark, sf_dir))


@REG.query(
    "blind_spots",
    f"""WITH {_GENOME}, g AS (SELECT contig, coalesce(lag(pos) OVER (PARTITION BY contig ORDER BY pos), 0) AS prev, pos FROM hit)
SELECT contig, prev + 75 AS beg, pos - 75 AS "end" FROM g WHERE pos - prev >= 150""",
)
def blind_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.blind_spots(_genome_hits(spark, sf_dir), 150)


@REG.query(
    "pct_genomic",
    f"""WITH {READS}, {CONTIGS}, {kmers(18, 'contigs', 'contig', 'gk')}, {LISTED}, g AS (SELECT DISTINCT kmer FROM gk)
SELECT count(*) AS n_ktmers, CAST(sum(CASE WHEN kmer IN (SELECT kmer FROM g) OR {rc('kmer')} IN (SELECT kmer FROM g) THEN 1 ELSE 0 END) AS BIGINT) AS n_genomic FROM listed""",
)
def pct_genomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kt-mers that stand on either strand of the contigs."""
    genome = dna.kmer_rows(common.contigs(spark, sf_dir), "seq", 18).select("kmer")
    either = genome.unionByName(genome.select(dna.reverse_complement("kmer").alias("kmer"))).distinct().withColumn("genomic", F.lit(1))
    return common.listed(spark, sf_dir).join(either, "kmer", "left").agg(F.count("*").alias("n_ktmers"), F.coalesce(F.sum("genomic"), F.lit(0)).alias("n_genomic"))


@REG.query(
    "set_compare",
    f"""WITH {CREADS}, {LISTED}, c AS (SELECT DISTINCT kmer FROM cr)
SELECT CAST(count(*) FILTER (a.kmer IS NOT NULL AND c.kmer IS NOT NULL) AS BIGINT) AS n_both, count(*) FILTER (c.kmer IS NULL) AS n_first, count(*) FILTER (a.kmer IS NULL) AS n_second FROM listed a FULL JOIN c ON a.kmer = c.kmer""",
)
def set_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the common part of listed kt-mers and those in creads, and of what only one has."""
    a = common.listed(spark, sf_dir).withColumn("a", F.lit(1))
    b = common.creads(spark, sf_dir).select("kmer").distinct().withColumn("b", F.lit(1))
    both = a.join(b, "kmer", "full")
    return both.agg(F.count_if(F.expr("a = 1 and b = 1")).alias("n_both"), F.count_if(F.isnull("b")).alias("n_first"), F.count_if(F.isnull("a")).alias("n_second"))


@REG.query("kmers_intersect", f"WITH {CREADS}, {LISTED} SELECT kmer FROM listed INTERSECT SELECT kmer FROM cr")
def kmers_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.listed(spark, sf_dir).intersect(common.creads(spark, sf_dir).select("kmer"))


@REG.query("kmers_except", f"WITH {CREADS}, {LISTED} SELECT kmer FROM listed EXCEPT SELECT kmer FROM cr")
def kmers_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.listed(spark, sf_dir).subtract(common.creads(spark, sf_dir).select("kmer"))
