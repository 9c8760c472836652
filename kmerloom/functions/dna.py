"""Column functions on DNA strings, headers and intervals. Positions are 0-based, intervals half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq: str | Column) -> Column:
    """Reverse complement of the upper-cased sequence; other letters and '-' stay as they are, null stays null."""
    return F.reverse(F.translate(F.upper(_col(seq)), "ACGT", "TGCA"))


def is_palindrome(kmer: str | Column) -> Column:
    """Whether a k-mer is its own reverse complement."""
    return F.upper(_col(kmer)) == reverse_complement(kmer)


def is_low_complexity(kmer: str | Column, share: float = 0.75) -> Column:
    """Whether one base makes up more than `share`; false for the empty string."""
    k = F.upper(_col(kmer))
    most = F.greatest(*[F.length(k) - F.length(F.replace(k, F.lit(b), F.lit(""))) for b in BASES])
    return (F.length(k) > 0) & (most > share * F.length(k))


def hamming(a: str | Column, b: str | Column) -> Column:
    """Places where two strings differ; -1 if their lengths do."""
    a, b = _col(a), _col(b)
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) != F.length(b), -1).when(F.length(a) == 0, 0).otherwise(F.aggregate(differ, F.lit(0), lambda s, x: s + x))


def kmer_array(seq: str | Column, k: int) -> Column:
    """All k-mers of a string in order; empty if it is shorter than k or null."""
    raw = F.encode(_col(seq), "UTF-8")  # bytes: taking a piece of a string walks it from its start
    places = F.sequence(F.lit(1), F.length(raw) - (k - 1))
    return F.when(F.length(raw) >= k, F.transform(places, lambda p: F.decode(F.substring(raw, p, F.lit(k)), "UTF-8"))).otherwise(F.array().cast("array<string>"))


def kmer_rows(df: DataFrame, seq: str, k: int, *keep: str) -> DataFrame:
    """(*keep, pos, kmer): a row for each k-mer of each row's upper-cased sequence."""
    raw = F.encode(F.upper(seq), "UTF-8")
    cut = df.filter(F.length(seq) >= k).select(*keep, raw.alias("_raw"))
    return cut.select(*keep, "_raw", F.explode(F.sequence(F.lit(0), F.length("_raw") - k)).alias("pos")).select(
        *keep, "pos", F.expr(f"decode(substring(_raw, pos + 1, {k}), 'UTF-8')").alias("kmer")
    )


def kmer_rows_of(df: DataFrame, seq: str, ks: list[int], *keep: str) -> DataFrame:
    """(*keep, k, pos, kmer): the rows of kmer_rows for several lengths, cut at one pass over the places."""
    raw = F.encode(F.upper(seq), "UTF-8")
    cut = df.filter(F.length(seq) >= min(ks)).select(*keep, raw.alias("_raw"))
    places = cut.select(*keep, "_raw", F.explode(F.sequence(F.lit(0), F.length("_raw") - min(ks))).alias("pos"))
    each = places.select(*keep, "_raw", "pos", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).filter("pos + k <= length(_raw)")
    return each.select(*keep, "k", "pos", F.expr("decode(substring(_raw, pos + 1, k), 'UTF-8')").alias("kmer"))


def deletions(kmer: str | Column, times: int = 1) -> Column:
    """Distinct strings after `times` deletions of one base."""
    out = F.array(_col(kmer))
    for _ in range(times):
        out = F.array_distinct(F.flatten(F.transform(out, _one_less)))
    return out


def _one_less(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))


def insertions(kmer: str | Column, times: int = 1, ends: str = "front") -> Column:
    """Distinct strings after `times` insertions of one base.

    ends='front': round j (from 0) inserts at places 0 to k-j-1, so at the front but
    never at the end, and the range shrinks. ends='both' or 'none': at the places
    0 to k+j, or 1 to k+j-1, of the string so far.
    """
    k = F.length(_col(kmer))
    out = F.array(_col(kmer))
    for j in range(times):
        lo = 1 if ends == "none" else 0
        hi = {"front": k - j - 1, "both": k + j, "none": k + j - 1}[ends]
        out = F.array_distinct(F.flatten(_each_inserted(out, lo, hi)))
    return out


def _inserted(x: Column, lo: int, hi: Column) -> Column:
    """x with one base inserted at the places lo to hi."""
    bases = F.array(*map(F.lit, BASES))
    some = F.flatten(F.transform(F.sequence(F.lit(lo), hi), lambda i: F.transform(bases, lambda b: F.concat(F.substring(x, F.lit(1), i), b, F.substring(x, i + 1, F.length(x))))))
    return F.when(hi >= lo, some).otherwise(F.array().cast("array<string>"))


def _each_inserted(strings: Column, lo: int, hi: Column) -> Column:
    return F.transform(strings, lambda x: _inserted(x, lo, hi))


def indel_neighbours(kmer: str | Column) -> Column:
    """Other k-mers one deletion and one insertion away, without those that only drop or add a base at an end."""
    k = _col(kmer)
    n = F.length(k)
    less = F.filter(deletions(k), lambda d: (d != F.substring(k, F.lit(1), n - 1)) & (d != F.substring(k, F.lit(2), n)))
    more = proper_insertions(k)
    back = F.flatten(F.transform(less, lambda d: insertions_of(d)))
    forth = F.flatten(F.transform(more, _one_less))
    return F.array_sort(F.filter(F.array_distinct(F.concat(back, forth)), lambda x: x != k))


def insertions_of(x: Column) -> Column:
    """Strings with one base inserted anywhere, both ends included."""
    return _inserted(x, 0, F.length(x))


def proper_deletions(kmer: str | Column) -> Column:
    """One-base deletions that aren't just the k-mer without its first or last base."""
    k = _col(kmer)
    return F.filter(deletions(k), lambda d: (d != F.substring(k, F.lit(1), F.length(k) - 1)) & (d != F.substring(k, F.lit(2), F.length(k))))


def proper_insertions(kmer: str | Column) -> Column:
    """One-base insertions from which the k-mer isn't got back by dropping the first or last base."""
    k = _col(kmer)
    n = F.length(k)
    return F.filter(F.array_distinct(insertions_of(k)), lambda x: (F.substring(x, F.lit(1), n) != k) & (F.substring(x, F.lit(2), n) != k))


def every_kmer(spark: SparkSession, k: int) -> DataFrame:
    """(kmer): all 4^k words."""
    digits = [F.substring(F.lit(BASES), (F.shiftright("id", 2 * (k - 1 - i)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(k)]
    return spark.range(4**k).select(F.concat(*digits).alias("kmer"))


def random_kmer(k: int, seed: int, *by: str | Column) -> Column:
    """A k-mer drawn by a hash of the seed and the given columns."""
    digits = [F.substring(F.lit(BASES), (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *map(_col, by)), F.lit(4)) + 1).cast("int"), F.lit(1)) for i in range(k)]
    return F.concat(*digits)


def prefix_of(kmer: str | Column) -> Column:
    return F.substring(_col(kmer), F.lit(1), F.length(_col(kmer)) - 1)


def suffix_of(kmer: str | Column) -> Column:
    return F.substring(_col(kmer), F.lit(2), F.length(_col(kmer)))


def overlaps_next(a: str | Column, b: str | Column) -> Column:
    """Whether a without its first base is b without its last."""
    return suffix_of(a) == prefix_of(b)


def path_string(path: str | Column) -> Column:
    """The string of a path of k-mers: the first and the last base of each next; '' for an empty path."""
    p = _col(path)
    tail = F.array_join(F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.right(x, F.lit(1))), "")
    return F.when(F.size(p) > 0, F.concat(F.element_at(p, 1), tail)).otherwise("")


def region(seq: str | Column, beg: str | Column, end: str | Column) -> Column:
    """seq[beg:end]."""
    return F.substring(_col(seq), (_col(beg) + 1).cast("int"), F.greatest(_col(end) - _col(beg), F.lit(0)).cast("int"))


def read_id(header: str | Column) -> Column:
    """The header up to the first white space, without a leading '>'."""
    return F.regexp_extract(_col(header), r"^>?(\S*)", 1)


def without_last_field(header: str | Column) -> Column:
    """A header without its last '/' field."""
    return F.regexp_replace(_col(header), "/[^/]*$", "")


def simulated_fields(header: str | Column) -> Column:
    """Struct of a simulated header read_<i>[ab]/genome_<s>_<e>/mat<m>_mis<x>_ins<n>_del<d>/0_<len>."""
    h = _col(header)

    def number(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(h, pattern, 1), F.lit("")).cast("bigint")

    return F.struct(
        number(r"read_(\d+)").alias("number"),
        F.regexp_extract(h, r"read_\d+([ab]?)", 1).alias("half"),
        number(r"genome_(\d+)_").alias("beg"),
        number(r"genome_\d+_(\d+)").alias("end"),
        number(r"/mat(\d+)_").alias("mat"),
        number(r"_mis(\d+)_").alias("mis"),
        number(r"_ins(\d+)_").alias("ins"),
        number(r"_del(\d+)").alias("del"),
        number(r"/0_(\d+)").alias("len"),
    )


def within_strict(beg1: str, end1: str, beg2: str, end2: str) -> Column:
    """An end of the second interval lies strictly inside the first."""
    b1, e1, b2, e2 = map(_col, (beg1, end1, beg2, end2))
    return ((b1 < b2) & (b2 < e1)) | ((b1 < e2) & (e2 < e1))


def within_closed(beg1: str, end1: str, beg2: str, end2: str) -> Column:
    """The closed intervals have a point in common."""
    b1, e1, b2, e2 = map(_col, (beg1, end1, beg2, end2))
    return (b1 <= e2) & (b2 <= e1)


def hull(beg1: str, end1: str, beg2: str, end2: str) -> Column:
    return F.struct(F.least(beg1, beg2).alias("beg"), F.greatest(end1, end2).alias("end"))


def average_length(q_beg: str, q_end: str, t_beg: str, t_end: str) -> Column:
    """Half of the two aligned lengths together, cut to a whole number."""
    return F.expr(f"(({q_end} - {q_beg}) + ({t_end} - {t_beg})) div 2")


def alignment_accuracy(matches: str | Column, length: str | Column) -> Column:
    """matches / length, 0 for an empty alignment."""
    return F.coalesce(F.try_divide(_col(matches).cast("double"), _col(length).cast("double")), F.lit(0.0))


def position_score(pos: str | Column, first: str | Column) -> Column:
    """(pos - first)^2 where pos is greater, else 0."""
    d = (_col(pos) - _col(first)).cast("bigint")
    return F.when(d > 0, d * d).otherwise(F.lit(0).cast("bigint"))


def estimated_location(pos: str | Column, factor: float = 0.916) -> Column:
    """Place on the genome estimated from a place on the reads by a fixed shrinking factor."""
    return _col(pos) * factor


def extension_window(seq: str | Column, end: str | Column, span: str | Column, size: int = 500, least: int = 450) -> Column:
    """The `size` bases after `end` if the consensus before spans more than `least`, else null."""
    e = _col(end)
    return F.when(_col(span) > least, F.substring(_col(seq), (e + 1).cast("int"), F.lit(size)))
