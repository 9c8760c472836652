"""Problem 3: items that appear together, by stripes.

Every task sums, for each item, an array of its neighbours with their counts (a
stripe). Stripes are cut by ranges of neighbours, so that the stripe of an item that
stands beside millions of others stays small, and merged by item and range.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.session import broadcast_if_small, numbered, stored

#: Pairs that a task sums before it writes stripes, and pairs that it makes at once; neighbours of one stripe as a power of 2.
HELD = 4_000_000
AT_ONCE = 1_000_000
RANGE_BITS = 16
#: Items of a basket beyond which it is cut into blocks that are paired by different tasks.
BLOCK = 1024

_STRIPE = "item int, span int, neighbours array<int>, counts array<int>"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, values) of a list column."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    return offsets - offsets[0], np.asarray(column.flatten())


def _pairs_in(offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (earlier, later) pairs of values inside each list."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    left = np.arange(len(values))
    later = ends - left - 1
    first = np.repeat(left, later)
    place = np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)
    return values[first], values[first + 1 + place]


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct packed pairs in order, counts)."""
    key = a.astype(np.int64) << 32 | b
    if n is None:
        key.sort()
        begins = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
        return key[begins], np.diff(np.r_[begins, len(key)])
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
    return key[begins], np.add.reduceat(n[order], begins) if len(begins) else np.zeros(0, np.int64)


def _stripes(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    a, b = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
    span = b >> RANGE_BITS
    begins = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (span[1:] != span[:-1])])
    offsets = pa.array(np.r_[begins, len(a)].astype(np.int32))
    arrays = [pa.array(a[begins]), pa.array(span[begins]), pa.ListArray.from_arrays(offsets, pa.array(b)), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))]
    return pa.RecordBatch.from_arrays(arrays, ["item", "span", "neighbours", "counts"])


def _by_pairs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of baskets that make AT_ONCE pairs at most, one basket at least."""
    sizes = np.diff(offsets)
    upto = np.r_[0, np.cumsum(sizes * (sizes - 1) // 2)]
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + AT_ONCE, "right")) - 1)
        yield lo, hi
        lo = hi


def _make_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    for batch in batches:
        offsets, values = _lists(batch.column(0))
        with_offsets, others = _lists(batch.column(1))
        ranges = [(i, i + 1) for i in range(batch.num_rows)] if len(others) else _by_pairs(offsets)
        for lo, hi in ranges:
            left = values[offsets[lo] : offsets[hi]]
            if len(others):  # two blocks of one large basket
                right = others[with_offsets[lo] : with_offsets[hi]]
                a, b = np.repeat(left, len(right)), np.tile(right, len(left))
                a, b = np.minimum(a, b), np.maximum(a, b)
            else:
                a, b = _pairs_in(offsets[lo : hi + 1] - offsets[lo], left)
            held.append(_summed(a, b, None))
            size += len(held[-1][0])
            if size >= HELD:
                yield _stripes(*_merged(held))
                held, size = [], 0
    if size:
        yield _stripes(*_merged(held))


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
    return _summed(key >> 32, key & 0xFFFFFFFF, n)


def _merge_stripes(min_count: int):
    def ready(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        keep = n >= min_count
        key, n = key[keep], n[keep]
        return pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], ["a", "b", "n_ab"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, b = _lists(batch.column(2))
            a = np.repeat(np.asarray(batch.column(0)), np.diff(offsets)).astype(np.int64)
            key, n = _merged([(key, n), (a << 32 | b, _lists(batch.column(3))[1].astype(np.int64))])
            # the last item and range may go on in the next batch
            done = np.searchsorted(key, (key[-1] >> (32 + 0) << 32) | ((key[-1] & 0xFFFFFFFF) >> RANGE_BITS << RANGE_BITS))
            yield ready(key[:done], n[:done])
            key, n = key[done:], n[done:]
        yield ready(key, n)

    return work


def _log_likelihood(ab, a, b, n):
    """Dunning's ratio of a 2 x 2 table."""

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, b, ab, n = (x.cast("double") for x in (a, b, ab, n))
    cells = [(ab, a * b), (a - ab, a * (n - b)), (b - ab, (n - a) * b), (n - a - b + ab, (n - a) * (n - b))]
    return F.lit(2.0) * sum((part(seen, expected / n) for seen, expected in cells), F.lit(0.0))


def pairs_together(baskets: DataFrame, key: str, items: str, min_count: int, min_lift: float, min_llr: float = 0.0) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, n_baskets, lift, llr) of the item pairs with n_ab >= min_count, lift >= min_lift and llr >= min_llr.

    One row of `baskets` is a basket (distinct keys). Null items are none and repeated
    ones count once; a basket without an item isn't counted. lift is
    n_ab * n_baskets / (n_a * n_b); llr the log-likelihood ratio; item_a < item_b.

    No pair that qualifies has an item in fewer than min_count baskets or in more than
    n_baskets / min_lift of them, as n_ab <= min(n_a, n_b); such items are left out
    before pairs are made, which loses nothing. Baskets stay rows of one task; one
    with more than BLOCK items is cut into blocks that are paired by many tasks.
    """
    kind = baskets.schema[items].dataType.elementType.simpleString()
    own = F.array_distinct(F.filter(F.coalesce(items, F.array().cast(f"array<{kind}>")), lambda x: x.isNotNull()))
    sets = baskets.select(F.col(key).alias("key"), own.alias("own")).filter(F.size("own") > 0)
    n_baskets = sets.count()
    lift = Decimal(str(min_lift))
    each = sets.select("key", F.explode("own").alias("item"))
    counts = each.groupBy("item").agg(F.count("*").alias("n")).filter((F.col("n") >= min_count) & (F.col("n") * F.lit(lift) <= n_baskets))
    vocabulary = stored(numbered(counts, "id").select("item", "n", F.col("id").cast("int").alias("id")))
    coded = stored(  # read for the small and the large baskets
        each.join(broadcast_if_small(vocabulary.select("item", "id")), "item")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .filter(F.size("ids") > 1)
        .select("ids")
    )
    none = F.array().cast("array<int>")
    blocks = F.expr(f"transform(sequence(0, cast((size(ids) - 1) div {BLOCK} as int)), i -> slice(ids, i * {BLOCK} + 1, {BLOCK}))")
    large = coded.filter(F.size("ids") > BLOCK).select(blocks.alias("blocks"))
    crossed = F.expr("flatten(transform(sequence(0, size(blocks) - 1), i -> transform(filter(sequence(0, size(blocks) - 1), j -> j >= i), j -> struct(blocks[i] as left, if(j = i, cast(array() as array<int>), blocks[j]) as right))))")
    # blocks of large baskets come one pair to a row, spread over the tasks
    cut = large.select(F.explode(crossed).alias("p")).select("p.left", "p.right")
    whole = coded.filter(F.size("ids") <= BLOCK).select(F.col("ids").alias("left"), none.alias("right"))
    spread = cut.filter(F.size("right") > 0).repartition(F.xxhash64("left", "right"))
    stripes = whole.unionByName(cut.filter(F.size("right") == 0)).mapInArrow(_make_stripes, _STRIPE).unionByName(spread.mapInArrow(_make_stripes, _STRIPE))
    merged = stripes.repartition("item", "span").sortWithinPartitions("item", "span").mapInArrow(_merge_stripes(min_count), "a int, b int, n_ab bigint")
    a = vocabulary.select(F.col("id").alias("a"), F.col("item").alias("first"), F.col("n").alias("n_first"))
    b = vocabulary.select(F.col("id").alias("b"), F.col("item").alias("second"), F.col("n").alias("n_second"))
    named = merged.join(a, "a").join(b, "b")
    big = lambda c: F.col(c).cast("decimal(18,0)")
    lifted = named.filter(big("n_ab") * F.lit(n_baskets).cast("decimal(18,0)") >= big("n_first") * big("n_second") * F.lit(lift))
    ordered = F.col("first") < F.col("second")
    either = lambda x, y: F.when(ordered, F.col(x)).otherwise(F.col(y))
    n = F.lit(n_baskets).cast("bigint")
    return lifted.select(
        either("first", "second").alias("item_a"),
        either("second", "first").alias("item_b"),
        either("n_first", "n_second").alias("n_a"),
        either("n_second", "n_first").alias("n_b"),
        "n_ab",
        n.alias("n_baskets"),
        (F.col("n_ab").cast("double") * n / (F.col("n_first").cast("double") * F.col("n_second"))).alias("lift"),
        _log_likelihood(F.col("n_ab"), F.col("n_first"), F.col("n_second"), n).alias("llr"),
    ).filter(F.col("llr") >= min_llr)
