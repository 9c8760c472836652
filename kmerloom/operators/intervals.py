"""Intervals per entity: coverage depth, continuous periods, gaps, clusters, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.session import stored

#: Positions of one sweep block. A window never holds more boundaries than this,
#: however many intervals an entity has, as boundaries at one position are summed first.
BLOCK = 1 << 16


def boundary_events(df: DataFrame, entity: str, beg: str, end: str) -> DataFrame:
    """(entity, pos, delta): +1 where an interval begins, -1 where it ends, summed by position.

    Null ends, null entities and empty intervals give no event; ends the wrong way
    round are exchanged.
    """
    lo, hi = F.least(beg, end).cast("bigint"), F.greatest(beg, end).cast("bigint")
    whole = df.filter(F.col(beg).isNotNull() & F.col(end).isNotNull() & F.col(entity).isNotNull() & (F.col(beg) != F.col(end)))
    both = F.array(
        F.struct(lo.alias("pos"), F.lit(1).cast("bigint").alias("delta")),
        F.struct(hi.alias("pos"), F.lit(-1).cast("bigint").alias("delta")),
    )
    return (
        whole.select(F.col(entity).alias("entity"), F.explode(both).alias("e"))
        .groupBy("entity", F.col("e.pos").alias("pos"))
        .agg(F.sum("e.delta").alias("delta"))
        .filter("delta <> 0")
    )


def depth_changes(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """events with the block they lie in and `depth`, the active intervals from pos on.

    The prefix sum runs inside blocks of positions; the sums of whole blocks are
    added from a table of one row per entity and block, so that an entity with a
    third of all rows is spread over as many tasks as it has blocks.
    """
    at = events.withColumn("blk", F.floor(F.col("pos") / block))
    sums = at.groupBy("entity", "blk").agg(F.sum("delta").alias("block_delta"))
    ahead = Window.partitionBy("entity").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("entity", "blk", F.coalesce(F.sum("block_delta").over(ahead), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("entity", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("local", F.sum("delta").over(inside)).join(carried, ["entity", "blk"]).select(
        "entity", "blk", "pos", "delta", (F.col("carried") + F.col("local")).alias("depth")
    )


def _with_previous(rows: DataFrame, *cols: str) -> DataFrame:
    """rows with prev_<col> of the row before in the entity, across blocks."""
    last = [F.max_by(c, "pos").alias(f"in_{c}") for c in cols]
    over = Window.partitionBy("entity").orderBy("blk")
    ends = rows.groupBy("entity", "blk").agg(*last)
    carried = ends.select("entity", "blk", *[F.lag(f"in_{c}").over(over).alias(f"from_{c}") for c in cols])
    inside = Window.partitionBy("entity", "blk").orderBy("pos")
    return (
        rows.select("*", *[F.lag(c).over(inside).alias(f"lag_{c}") for c in cols])
        .join(carried, ["entity", "blk"])
        .select(*rows.columns, *[F.coalesce(f"lag_{c}", f"from_{c}").alias(f"prev_{c}") for c in cols])
    )


def periods_and_gaps(df: DataFrame, entity: str, beg: str, end: str, min_depth: int = 1, block: int = BLOCK) -> DataFrame:
    """Sweep line: (entity, kind, beg, end) with kind 'period' (depth >= min_depth) or 'gap'.

    Boundaries become +1 and -1 events, a prefix sum counts the active intervals,
    and a change from or to fewer than `min_depth` ends a gap or a period.
    Intervals that overlap or touch form one period; a gap lies between two
    successive periods of an entity. Repeated rows change nothing for min_depth 1;
    for higher depths pass distinct rows. Null or equal ends and null entities are
    left out; an empty table gives an empty result.
    """
    swept = depth_changes(boundary_events(df, entity, beg, end), block)
    covered, before = F.col("depth") >= min_depth, F.col("depth") - F.col("delta") >= min_depth
    edges = stored(swept.filter(covered != before).select("entity", "blk", "pos", covered.alias("opens")))  # read twice below
    return (
        _with_previous(edges, "pos")
        .filter("prev_pos is not null")
        .select("entity", F.when(F.col("opens"), "gap").otherwise("period").alias("kind"), F.col("prev_pos").alias("beg"), F.col("pos").alias("end"))
    )


def coverage_segments(df: DataFrame, entity: str, beg: str, end: str, block: int = BLOCK) -> DataFrame:
    """(entity, beg, end, depth) of maximal stretches of equal depth between the first and last boundary."""
    swept = stored(depth_changes(boundary_events(df, entity, beg, end), block))
    return _with_previous(swept, "pos", "depth").filter("prev_pos is not null").select(
        "entity", F.col("prev_pos").alias("beg"), F.col("pos").alias("end"), F.col("prev_depth").alias("depth")
    )


def _running(rows: DataFrame, *cols: str) -> DataFrame:
    """rows with sum_<col>, the sum of `col` up to `pos` in the entity: inside blocks, and over the sums of the blocks."""
    sums = rows.groupBy("entity", "blk").agg(*[F.sum(c).alias(c) for c in cols])
    ahead = Window.partitionBy("entity").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("entity", "blk", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"from_{c}") for c in cols])
    inside = Window.partitionBy("entity", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(c).over(inside).alias(f"in_{c}") for c in cols]).join(carried, ["entity", "blk"])
    return local.select(*rows.columns, *[(F.col(f"from_{c}") + F.col(f"in_{c}")).alias(f"sum_{c}") for c in cols])


def interval_clusters(df: DataFrame, entity: str, beg: str, end: str, block: int = BLOCK) -> DataFrame:
    """(entity, beg, end, n): periods of intervals that strictly overlap, with the number of intervals in each.

    Touching intervals stay apart here: a cluster begins where an interval begins and
    none that began before goes on. The sweep runs in blocks, so no entity is one
    window. Null ends, null entities and empty intervals are left out.
    """
    lo, hi = F.least(beg, end).cast("bigint"), F.greatest(beg, end).cast("bigint")
    whole = df.filter(F.col(beg).isNotNull() & F.col(end).isNotNull() & F.col(entity).isNotNull() & (F.col(beg) != F.col(end)))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = F.array(F.struct(lo.alias("pos"), one.alias("opens"), none.alias("shuts")), F.struct(hi.alias("pos"), none.alias("opens"), one.alias("shuts")))
    events = whole.select(F.col(entity).alias("entity"), F.explode(both).alias("e")).groupBy("entity", F.col("e.pos").alias("pos")).agg(F.sum("e.opens").alias("opens"), F.sum("e.shuts").alias("shuts"))
    swept = stored(_with_previous(_running(events.withColumn("blk", F.floor(F.col("pos") / block)), "opens", "shuts"), "pos"))
    before = F.col("sum_opens") - F.col("opens")  # intervals that began before pos
    starts = swept.filter((F.col("opens") > 0) & (before == F.col("sum_shuts"))).select(
        "entity", "blk", "pos", before.alias("before"), F.when(F.col("shuts") > 0, F.col("pos")).otherwise(F.col("prev_pos")).alias("last")
    )
    ends = swept.groupBy("entity").agg(F.max("blk").alias("blk"), F.max("pos").alias("pos"), F.max("sum_opens").alias("before")).withColumn("last", F.col("pos"))
    closed = _with_previous(stored(starts.unionByName(ends)), "pos", "before").filter("prev_pos is not null")
    return closed.select("entity", F.col("prev_pos").alias("beg"), F.col("last").alias("end"), (F.col("before") - F.col("prev_before")).alias("n"))


def seed_islands(rows: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """rows(entity, pos, n), distinct positions, with `island`: a number that changes where the next position lies `radius` or more away."""
    at = _with_previous(stored(rows.withColumn("blk", F.floor(F.col("pos") / block))), "pos")
    fresh = F.when(F.col("prev_pos").isNull() | (F.col("pos") - F.col("prev_pos") >= radius), 1).otherwise(0)
    return _running(at.withColumn("fresh", fresh), "fresh").select("entity", "pos", "n", F.col("sum_fresh").alias("island"))


def accurate_enough(accuracy: str | Column, percent: float) -> Column:
    """accuracy > percent, where values up to 1 are fractions; false for null and NaN."""
    a = F.col(accuracy) if isinstance(accuracy, str) else accuracy
    return F.coalesce(~F.isnan(a) & F.when(a <= 1, a > percent / 100).otherwise(a > percent), F.lit(False))
