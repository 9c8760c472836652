"""Problem 1: runs of equal consecutive events, by the difference of two row numbers.

Inside an entity, the row number of an event minus its row number among the
entity's events of the same value stays the same exactly as long as the events
follow one another without an event of another value between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.batches import BASE_CODES, BASES, UNCALLED, flat_strings, slices
from kmerloom.session import stored

#: Bytes of sequence that are worked on at once.
SLICE = 2 << 20


def _canonical_events(codes: np.ndarray, entity: np.ndarray, max_gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the events.

    An uncalled position is no event, but where more than max_gap of them stand in
    one place the later ones are events of a value of their own and so end a run.
    """
    uncalled = codes == UNCALLED
    breaks = uncalled.copy()
    for g in range(1, max_gap + 1):
        breaks[g:] &= uncalled[:-g] & (entity[g:] == entity[:-g])
        breaks[:g] = False
    at = np.flatnonzero(~uncalled | breaks)
    return at, codes[at]


def _row_numbers(sorted_entity: np.ndarray, n: int) -> np.ndarray:
    first = np.searchsorted(sorted_entity, np.arange(n))
    return np.arange(len(sorted_entity)) - first[sorted_entity]


def sequence_runs(offsets: np.ndarray, data: np.ndarray, max_gap: int, min_events: int) -> tuple[np.ndarray, ...]:
    """(row, value, begin, end, events) of the runs in the sequences data[offsets[i]:offsets[i+1]]."""
    n = len(offsets) - 1
    codes = BASE_CODES[data]
    entity = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    at, value = _canonical_events(codes, entity, max_gap)
    of = entity[at]
    number = _row_numbers(of, n)
    found = []
    for v in range(len(BASES)):
        mine = np.flatnonzero(value == v)
        if not len(mine):
            continue
        e = of[mine]
        difference = number[mine] - _row_numbers(e, n)
        begins = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (difference[1:] != difference[:-1])])
        ends = np.r_[begins[1:], len(mine)]
        keep = ends - begins >= min_events
        begins, ends = begins[keep], ends[keep]
        first, last, row = at[mine[begins]], at[mine[ends - 1]], e[begins]
        found.append((row, np.full(len(row), v, np.int8), first - offsets[row], last + 1 - offsets[row], ends - begins))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found))


def base_runs(df: DataFrame, key: str, seq: str, max_gap: int = 2, min_events: int = 8) -> DataFrame:
    """(key, base, run_beg, run_end, n_events, n_positions) of the runs of one base in each row's sequence.

    Case is ignored. A run begins and ends with its base, holds no other called
    base, at most max_gap uncalled positions in one place, and min_events called
    bases at least. Null and empty sequences give no row. A sequence lies whole in
    its row, so nothing is shuffled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, (offsets, data) = batch.column(0), flat_strings(batch.column(1))
            for lo, hi in slices(offsets, SLICE):
                part = offsets[lo : hi + 1] - offsets[lo]
                row, value, beg, end, n = sequence_runs(part, data[offsets[lo] : offsets[hi]], max_gap, min_events)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row + lo)), pa.array(np.array(list(BASES))[value.astype(int)]), *(pa.array(x.astype(np.int64)) for x in (beg, end, n, end - beg))],
                    ["key", "base", "run_beg", "run_end", "n_events", "n_positions"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(seq).alias("seq")).mapInArrow(work, f"key {kind}, base string, run_beg bigint, run_end bigint, n_events bigint, n_positions bigint")


def event_runs(df: DataFrame, entity: str, order: list[str], value: str) -> DataFrame:
    """(entity, value, first, last, n_events): runs of equal values among the rows of each entity.

    `order` sorts an entity's rows; its first column gives first and last. Rows with
    a null entity or order are left out; a null value is a value of its own; rows
    that tie in `order` are sorted by value. Row numbers are built from sorted ranges
    of rows and the row counts of the ranges before, so an entity with a third of
    all rows is numbered by many tasks.
    """
    rows = df.filter(F.col(entity).isNotNull() & F.col(order[0]).isNotNull()).select(
        F.col(entity).alias("entity"), F.col(order[0]).alias("at"), F.struct(*order, value).alias("ord"), F.col(value).alias("value")
    )
    ranged = stored(rows.repartitionByRange("entity", "ord").withColumn("part", F.spark_partition_id()))

    def before(name: str, **by: str) -> DataFrame:
        """(part, *by, name): the rows of the same `by` in the ranges before."""
        counts = ranged.groupBy("part", *[F.col(c).alias(to) for c, to in by.items()]).count()
        ahead = Window.partitionBy(*by.values()).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(F.col("part").alias(f"part_{name}"), *by.values(), F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias(name))

    n_all, n_same = before("n_all", entity="entity_a"), before("n_same", entity="entity_s", value="value_s")
    numbered = (
        ranged.withColumn("r_all", F.row_number().over(Window.partitionBy("part", "entity").orderBy("ord")))
        .withColumn("r_same", F.row_number().over(Window.partitionBy("part", "entity", "value").orderBy("ord")))
        .join(n_all, (F.col("part") == F.col("part_n_all")) & (F.col("entity") == F.col("entity_a")))
        .join(n_same, (F.col("part") == F.col("part_n_same")) & (F.col("entity") == F.col("entity_s")) & F.col("value").eqNullSafe(F.col("value_s")))
        .select("entity", "value", "at", (F.col("r_all") + F.col("n_all") - F.col("r_same") - F.col("n_same")).alias("run"))
    )
    return numbered.groupBy("entity", "value", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n_events")).drop("run")
