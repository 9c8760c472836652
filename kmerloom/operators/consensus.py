"""Correction of reads from their neighbourhoods, replacement plans and splicing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.align import consensus_tree, progressive_consensus

#: Neighbours that a consensus looks at; those with most shared kt-mers come first.
MOST_READS = 99


def nhood_reads(near: DataFrame, reads: DataFrame, shortest: int, longest: int, most: int = MOST_READS) -> DataFrame:
    """(base, rank, seq): the sequences of each base and its neighbours of fitting length, the base first, at most `most`.

    The ranks are cut before the sequences are joined, so a group holds `most` rows at most.
    """
    fitting = reads.filter((F.col("len") > shortest) & (F.col("len") < longest)).select("read_idx", "seq")
    ids = fitting.select("read_idx")
    both = near.select("base", "neighbour", "n_shared").unionByName(near.select("base", F.col("base").alias("neighbour"), F.lit(1 << 40).alias("n_shared")).distinct())
    order = Window.partitionBy("base").orderBy(F.desc("n_shared"), "neighbour")
    kept = both.join(ids.withColumnRenamed("read_idx", "neighbour"), "neighbour", "left_semi").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return kept.join(fitting.withColumnRenamed("read_idx", "neighbour"), "neighbour").select("base", "rank", "seq")


def undecided(pairs: DataFrame, joined: DataFrame, forest: bool) -> DataFrame:
    """The rows of pairs(base, neighbour, cells, cost) between groups of joined(base, neighbour); with forest, the cheapest of them that join all that can be joined.

    One task takes the numbers of all pairs (32 bytes each), which is little beside an
    alignment of each.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(batches)
        if not kept:
            return
        rows = pa.Table.from_batches(kept)
        ends, at = np.unique(np.concatenate([rows[c].to_numpy() for c in ("base", "neighbour")]), return_inverse=True)
        a, b = at[: len(rows)].tolist(), at[len(rows) :].tolist()
        group = list(range(len(ends)))

        def root(x: int) -> int:
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        out, cost = [], rows["cost"].to_numpy()
        for i in np.lexsort((rows["neighbour"].to_numpy(), rows["base"].to_numpy(), cost)).tolist():  # what is joined comes first
            x, y = root(a[i]), root(b[i])
            if x != y:
                if forest or cost[i] < 0:
                    group[y] = x
                if cost[i] >= 0:
                    out.append(i)
        yield from rows.take(pa.array(out, pa.int64())).to_batches()

    known = joined.select("base", "neighbour", F.lit(0.0).alias("cells"), F.lit(-1.0).alias("cost"))
    every = pairs.select("base", "neighbour", "cells", "cost").unionByName(known)
    return every.repartition(1).mapInArrow(work, every.schema)


def tree_consensus(groups: DataFrame, seed: int = 1129, groups_of: int = 4) -> DataFrame:
    """(base, consensus, n_support, accepted) of each group of nhood_reads."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, n, ok = consensus_tree(rows.sort_values("rank")["seq"].tolist(), seed, groups=groups_of)
        return pd.DataFrame([(key[0], out, n, ok)], columns=["base", "consensus", "n_support", "accepted"])

    spread = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups.sparkSession.sparkContext.defaultParallelism) * 4  # a group is much work and few bytes
    return groups.repartition(spread, "base").groupBy("base").applyInPandas(work, "base bigint, consensus string, n_support int, accepted boolean")


def multi_alignment_consensus(groups: DataFrame) -> DataFrame:
    """(base, n_reads, consensus) by progressive alignment in the order of the ranks."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seqs = rows.sort_values("rank")["seq"].tolist()
        return pd.DataFrame([(key[0], len(seqs), progressive_consensus(seqs))], columns=["base", "n_reads", "consensus"])

    return groups.groupBy("base").applyInPandas(work, "base bigint, n_reads int, consensus string")


def accepted_consensus(rows: DataFrame, n1: str, n2: str, ratio: float = 0.05) -> DataFrame:
    """Rows with n2 / n1 of at most `ratio`; n1 of 0 isn't accepted."""
    return rows.filter(F.coalesce(F.try_divide(F.col(n2), F.col(n1)) <= ratio, F.lit(False)))


def replacement_plan(alignments: DataFrame, percent: float = 80.0) -> DataFrame:
    """(read_id, beg, end, consensus, ec_beg, ec_end, aln_id): where consensuses replace parts of reads.

    Of replacements of a read that overlap one with a smaller begin (ties: longer,
    then smaller aln_id) is kept; those that begin before its end are dropped.
    """
    from kmerloom.operators.intervals import accurate_enough

    ok = alignments.filter(accurate_enough("accuracy", percent)).filter("nh_beg < nh_end and ec_beg < ec_end and header is not null")
    rows = ok.select(F.regexp_replace("header", "^>", "").alias("read_id"), F.col("nh_beg").alias("beg"), F.col("nh_end").alias("end"), "consensus", "ec_beg", "ec_end", "aln_id").distinct()
    order = Window.partitionBy("read_id").orderBy("beg", F.desc("end"), "aln_id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("reach", reach).filter("reach is null or beg >= reach").drop("reach")


def spliced(reads: DataFrame, plan: DataFrame) -> DataFrame:
    """(read_id, seq): reads with plan(read_id, beg, end, piece) put in, right to left, so that places stay valid.

    Replacements that end beyond the read are left out.
    """
    inside = plan.join(reads.select("read_id", "len"), "read_id").filter("end <= len and beg >= 0")
    lists = inside.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("beg", "end", "piece")), asc=False).alias("l"))
    put = F.expr("aggregate(l, seq, (s, x) -> concat(substring(s, 1, x.beg), x.piece, substring(s, x.end + 1)))")
    return reads.join(lists, "read_id", "left").select("read_id", F.when(F.col("l").isNull(), F.col("seq")).otherwise(put).alias("seq"))


def overlap_kind(alignments: DataFrame, percent: float = 75.0, least_len: int = 7000, near_end: int = 5000, extension: int = 1) -> DataFrame:
    """alignments with extends: both on one strand, accurate and long enough, the target's end near, the consensus going on beyond it."""
    from kmerloom.operators.intervals import accurate_enough

    length = F.expr("((nh_end - nh_beg) + (ec_end - ec_beg)) div 2")
    ok = (
        (F.col("q_strand") == F.col("t_strand"))
        & accurate_enough("accuracy", percent)
        & (length > least_len)
        & (F.col("t_len") - F.col("nh_end") < near_end)
        & ((F.col("ec_len") - F.col("ec_end")) - (F.col("t_len") - F.col("nh_end")) >= extension)
    )
    return alignments.withColumn("extends", F.coalesce(ok, F.lit(False)))
