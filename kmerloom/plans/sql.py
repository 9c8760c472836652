"""Pieces of SQL that several queries share."""

READS = """reads AS (
  SELECT read_idx, regexp_extract(any_value(header), '^>?(\\S*)', 1) AS read_id, upper(any_value(seq)) AS seq, length(any_value(seq)) AS len
  FROM fasta_reads WHERE read_idx IS NOT NULL AND length(seq) > 0 GROUP BY read_idx)"""


def kmers(k: int, source: str = "reads", keep: str = "read_idx", name: str = "km") -> str:
    """CTE (keep, pos, kmer) of all k-mers."""
    return f"""{name} AS (SELECT {keep}, p AS pos, substr(seq, p + 1, {k}) AS kmer
  FROM (SELECT {keep}, seq, unnest(range(CAST(length(seq) AS BIGINT) - {k - 1})) AS p FROM {source} WHERE length(seq) >= {k}))"""


RC = "reverse(translate(upper({0}), 'ACGT', 'TGCA'))"


def rc(x: str) -> str:
    return RC.format(x)


def plain_complexity(x: str) -> str:
    return f"greatest({', '.join(f'''length({x}) - length(replace({x}, '{b}', ''))''' for b in 'ACGT')}) <= 0.75 * length({x})"


#: creads as rows, with positions.
CREADS = """one_cread AS (SELECT read_idx, regexp_replace(any_value(read_id), '^>', '') AS read_id, any_value(ktmers) AS ktmers, any_value(dists) AS dists
  FROM creads WHERE read_idx IS NOT NULL GROUP BY read_idx
), cr AS (
  SELECT read_idx, read_id, CAST(i - 1 AS INT) AS ord, ktmers[i] AS kmer, CAST(list_sum(dists[1:i]) AS INT) AS pos, CAST(list_sum(dists) AS INT) AS len
  FROM (SELECT *, unnest(range(1, len(ktmers) + 1)) AS i FROM one_cread WHERE ktmers IS NOT NULL) WHERE ktmers[i] IS NOT NULL)"""

LISTED = "listed AS (SELECT DISTINCT upper(kmer) AS kmer FROM ktmers WHERE kmer IS NOT NULL)"

#: Contigs: reads long enough to stand for a genome.
CONTIG_LEN = 1500
CONTIGS = f"contigs AS (SELECT read_idx AS contig, seq, len FROM reads WHERE len > {CONTIG_LEN})"
