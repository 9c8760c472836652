"""Figures about alignments, coverage and contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.operators.intervals import periods_and_gaps, seed_islands

#: Parts of a group that are ranked apart.
PARTS = 64


def percent(col: str = "accuracy") -> Column:
    """Accuracy in per cent: values up to 1 are fractions; null for NaN."""
    a = F.nanvl(F.col(col), F.lit(None))
    return F.when(a <= 1, a * 100).otherwise(a)


def accuracy_stats(rows: DataFrame, *by: str) -> DataFrame:
    """(n, mean, std) of `accuracy` by group, nulls left out; the deviation of the population."""
    a = percent()
    return rows.groupBy(*by).agg(F.count(a).alias("n"), F.avg(a).alias("mean"), F.stddev_pop(a).alias("std"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(n_both, n_better, n_same, n_worse, mean_gain, n_shifted, n_lost): best accuracies by `key` before and after; both have (key, accuracy, beg)."""
    a = before.select("key", F.col("accuracy").alias("a"), F.col("beg").alias("x"))
    b = after.select("key", F.col("accuracy").alias("b"), F.col("beg").alias("y"))
    both = a.join(b, "key", "left")
    return both.agg(
        F.count("b").alias("n_both"), F.count_if(F.expr("b > a")).alias("n_better"), F.count_if(F.expr("b = a")).alias("n_same"), F.count_if(F.expr("b < a")).alias("n_worse"),
        F.avg(F.expr("b - a")).alias("mean_gain"), F.count_if(F.expr("abs(y - x) > 10000")).alias("n_shifted"), F.count_if(F.expr("b is null")).alias("n_lost"),
    )


def coverage_histogram(segments: DataFrame, most: int = 30) -> DataFrame:
    """(depth, n_positions): positions covered at least `depth` times, depth < most; from segments(beg, end, depth)."""
    cut = segments.withColumn("at_least", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("depth"), F.lit(most - 1)))))
    return cut.groupBy(F.col("at_least").cast("int").alias("depth")).agg(F.sum(F.col("end") - F.col("beg")).alias("n_positions"))


def low_coverage_runs(segments: DataFrame, below: int = 4, longer_than: int = 1) -> DataFrame:
    """(entity, beg, end): maximal runs of positions covered fewer than `below` times and longer than `longer_than`."""
    low = segments.filter(F.col("depth") < below)  # low segments of one run touch
    runs = periods_and_gaps(low, "entity", "beg", "end").filter("kind = 'period'")
    return runs.filter(F.col("end") - F.col("beg") > longer_than).select("entity", "beg", "end")


def support_percentile(rows: DataFrame, by: str, value: str, nth: int = 3) -> DataFrame:
    """(by, value): the nth smallest value of a group, its greatest if it has fewer."""
    # the least ones of every part of a group first, so that a group with a third of the rows isn't one task
    held = rows.filter(F.col(value).isNotNull()).select(by, value, F.pmod(F.xxhash64(value), F.lit(PARTS)).alias("_part"))
    for keys in ([by, "_part"], [by]):
        held = held.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).filter(F.col("_r") <= nth).drop("_r")
    return held.groupBy(by).agg(F.max(value).alias(value))


def jump_scores(rows: DataFrame, by: str, margin: int = 100, share: float = 0.6, support: int = 3) -> DataFrame:
    """(by, n, n_broken, score, jump): alignments that break off inside both sequences, and whether that is likely a wrong joint."""
    broken = F.expr(f"(nh_beg > {margin} and ec_beg > {margin}) or (t_len - nh_end > {margin} and ec_len - ec_end > {margin})")
    return (
        rows.groupBy(by)
        .agg(F.count("*").alias("n"), F.count_if(broken).alias("n_broken"))
        .withColumn("score", F.col("n_broken") / F.col("n"))
        .withColumn("jump", (F.col("score") >= share) & (F.col("n_broken") >= support))
    )


def histogram(rows: DataFrame, value: str, step: float) -> DataFrame:
    """(bin, n): rows by floor(value / step) * step; nulls left out."""
    return rows.filter(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / step) * step).alias("bin")).agg(F.count("*").alias("n"))


def range_overlaps(contigs: DataFrame, width: int) -> DataFrame:
    """(a, b, overlap): contigs(id, beg, end) that overlap end to begin, s1 < s2 < e1 < e2, by an equi-join on pieces of `width`."""
    cut = contigs.filter("beg < end").withColumn("cell", F.explode(F.sequence(F.floor(F.col("beg") / width), F.floor((F.col("end") - 1) / width))))
    a = cut.select("cell", F.col("id").alias("a"), F.col("beg").alias("b1"), F.col("end").alias("e1"))
    b = cut.select("cell", F.col("id").alias("b"), F.col("beg").alias("b2"), F.col("end").alias("e2"))
    found = a.join(b, "cell").filter("b1 < b2 and b2 < e1 and e1 < e2").filter(F.col("cell") == F.floor(F.col("b2") / width))
    return found.select("a", "b", (F.col("e1") - F.col("b2")).alias("overlap"))


def not_contained(contigs: DataFrame, width: int) -> DataFrame:
    """contigs(id, beg, end) that lie strictly inside no other one."""
    cut = contigs.filter("beg < end").withColumn("cell", F.explode(F.sequence(F.floor(F.col("beg") / width), F.floor((F.col("end") - 1) / width))))
    outer = cut.select("cell", F.col("beg").alias("b1"), F.col("end").alias("e1"))
    inner = contigs.withColumn("cell", F.floor(F.col("beg") / width))
    inside = inner.join(outer, "cell").filter("b1 < beg and end < e1").select("id").distinct()
    return contigs.join(inside, "id", "left_anti")


def seed_clusters(rows: DataFrame, entity: str, pos: str, radius: int) -> DataFrame:
    """(entity, seed, n): positions clustered greedily in order: the first one left is a seed and takes all within the radius of it.

    In sorted order a cluster is what lies before seed + radius, so one pass over the
    distinct positions decides; they are summed before. A position that is the radius
    or more away from the one before is a seed whatever came before, so the passes run
    over the islands between such places, not over entities.
    """
    import pandas as pd

    counts = rows.filter(F.col(pos).isNotNull() & F.col(entity).isNotNull()).groupBy(F.col(entity).alias("entity"), F.col(pos).cast("bigint").alias("pos")).agg(F.count("*").alias("n"))

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for p, n in part.sort_values("pos")[["pos", "n"]].itertuples(index=False):
            if out and p - out[-1][1] < radius:
                out[-1][2] += n
            else:
                out.append([key[0], p, n])
        return pd.DataFrame(out, columns=["entity", "seed", "n"])

    return seed_islands(counts, radius).groupBy("entity", "island").applyInPandas(work, "entity string, seed bigint, n bigint")


def breakpoints(rows: DataFrame, by: str, margin: int = 100, bin_size: int = 100) -> DataFrame:
    """(by, bin, n): where alignments break off inside both sequences, by stretches of `bin_size` bases of the contig.

    A break in the first or last `margin` bases of the contig is none; nulls are none.
    """
    left = F.expr(f"if(nh_beg > {margin} and ec_beg > {margin}, ec_beg, null)")
    right = F.expr(f"if(t_len - nh_end > {margin} and ec_len - ec_end > {margin}, ec_end, null)")
    at = rows.select(by, F.explode(F.array(left, right)).alias("at")).filter("at is not null")
    return at.groupBy(by, (F.floor(F.col("at") / bin_size) * bin_size).alias("bin")).agg(F.count("*").alias("n"))


def jump_pieces(rows: DataFrame, by: str, length: str, margin: int = 100, bin_size: int = 100, share: float = 0.6, support: int = 3) -> DataFrame:
    """(by, beg, end): the pieces of contigs, those with a likely wrong joint cut at the stretch with the most breaks (the first of these)."""
    cut = breakpoints(rows, by, margin, bin_size).groupBy(by).agg(F.max(F.struct("n", (-F.col("bin")).alias("first"))).alias("m")).select(by, (-F.col("m.first")).alias("cut"))
    jumps = jump_scores(rows, by, margin, share, support).select(by, "jump")
    whole = rows.groupBy(by).agg(F.max(length).cast("bigint").alias("len")).join(jumps, by).join(cut, by, "left")
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("beg"), F.col("len").alias("end")))
    two = F.array(F.struct(F.lit(0).cast("bigint").alias("beg"), F.col("cut").alias("end")), F.struct(F.col("cut").alias("beg"), F.col("len").alias("end")))
    return whole.select(by, F.explode(F.when(F.col("jump") & (F.col("cut") > 0) & (F.col("cut") < F.col("len")), two).otherwise(one)).alias("p")).select(by, "p.beg", "p.end")


def cluster_stats(clusters: DataFrame) -> DataFrame:
    """(entity, n_clusters, n_single, covered, best) from clusters(entity, beg, end, n): those of one interval, the bases of all, the longest."""
    size = F.col("end") - F.col("beg")
    return clusters.groupBy("entity").agg(F.count("*").alias("n_clusters"), F.count_if(F.col("n") == 1).alias("n_single"), F.sum(size).alias("covered"), F.max(size).alias("best"))


def paired_by_prefix(left: DataFrame, right: DataFrame, name: str, length: int = 20) -> DataFrame:
    """(prefix, left, right): names that begin alike, each in one pair at most: the first with the first, and so on. Null names are in no pair."""
    order = Window.partitionBy("prefix").orderBy(name)
    one, two = (x.filter(F.col(name).isNotNull()).select(F.substring(name, 1, length).alias("prefix"), name).distinct().withColumn("r", F.row_number().over(order)) for x in (left, right))
    return one.withColumnRenamed(name, "left").join(two.withColumnRenamed(name, "right"), ["prefix", "r"]).drop("r")
