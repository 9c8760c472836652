"""Problem 8: mixing sources to target weights.

The tokens of each source are packed into blocks of one length. The slots of the mix
are dealt to the sources by a pseudorandom permutation, which gives every shard of
the output a multinomial draw of source counts whose totals are the quotas; the
slots of a source go through its own permutation of block numbers, another for each
repeat, and blocks are joined by number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.session import stored

BLOCK_TOKENS = 256
SHARD_SLOTS = 4096
#: Sources with a target; their plan is made on the driver.
MOST_SOURCES = 10_000


def permuted(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at x: four Feistel rounds over the next power of 4, walked on until inside."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64(((seed * 4 + r + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) for r in range(4)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & low
        for key in keys:
            f = (right + key) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & low)
        return (left << np.uint64(half)) | right

    out = once(x.astype(np.uint64))
    while len(far := np.flatnonzero(out >= np.uint64(n))):
        out[far] = once(out[far])
    return out.astype(np.int64)


@dataclass(frozen=True)
class Share:
    source: str
    target: float
    max_repeats: int
    tokens: int
    blocks: int
    slots: int


def plan(sources: list[tuple[str, float, int, int]], block: int, total_tokens: int | None = None) -> list[Share]:
    """Slots of each source from (source, target share, most repeats, tokens).

    Without total_tokens the mix is as large as lets every source that has tokens
    reach its share; with it, sources whose repeats don't suffice give what they can
    and the rest is shared out by the others' targets. Shares of sources without
    tokens go to the others in proportion.
    """
    blocks = {s: -(-t // block) for s, _, _, t in sources}
    cap = {s: blocks[s] * max(0, r) for s, _, r, _ in sources}
    live = {s: w for s, w, _, _ in sources if w > 0 and cap[s] > 0}
    slots = dict.fromkeys(blocks, 0)
    if live:
        weight = sum(live.values())
        left = min(int(cap[s] * weight / w) for s, w in live.items()) if total_tokens is None else min(total_tokens // block, sum(cap[s] for s in live))
        open_ = dict(live)
        while left > 0 and open_:
            weight = sum(open_.values())
            full = [s for s, w in open_.items() if left * w / weight >= cap[s]]
            if not full:
                exact = {s: left * w / weight for s, w in open_.items()}
                for s in open_:
                    slots[s] = int(exact[s])
                over = left - sum(slots[s] for s in open_)
                for s in sorted(open_, key=lambda s: (slots[s] - exact[s], s))[:over]:
                    slots[s] += 1
                break
            for s in full:
                slots[s] = cap[s]
                left -= cap[s]
                del open_[s]
    return [Share(s, w, r, t, blocks[s], slots[s]) for s, w, r, t in sources]


def packed(sizes: DataFrame, seed: int) -> DataFrame:
    """sizes(doc, source, n_tokens) with the offset `start` of each document among its source's tokens, in a random order.

    The prefix sum runs inside groups of some thousand documents and over the sums
    of the groups, so a source with most of the documents is spread over many tasks.
    """
    groups = max(1, -(-sizes.count() // 4000))
    rows = sizes.withColumn("h", F.xxhash64("doc", F.lit(seed))).withColumn("grp", F.pmod("h", F.lit(groups)))
    sums = rows.groupBy("source", "grp").agg(F.sum("n_tokens").alias("sum"))
    ahead = Window.partitionBy("source").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source", "grp", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "grp").orderBy("h", "doc").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum("n_tokens").over(inside)).join(before, ["source", "grp"]).select(
        "doc", "source", "n_tokens", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start")
    )


class Mix:
    """A mix of sizes(doc, source, n_tokens) by targets(source, target_share, max_repeats).

    Rows with a null document, a null source, a source without a target or no tokens
    are in no mix. Equal names of sources among the targets count once.
    """

    def __init__(self, sizes: DataFrame, targets: DataFrame, block: int = BLOCK_TOKENS, total_tokens: int | None = None, seed: int = 1):
        self.seed, self.block = seed, block
        wanted = targets.filter("source is not null and target_share > 0 and max_repeats > 0").dropDuplicates(["source"])
        usable = sizes.filter("n_tokens > 0 and doc is not null").join(F.broadcast(wanted.select("source").limit(MOST_SOURCES)), "source", "left_semi")
        self.docs = stored(packed(usable, seed))
        tokens = self.docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
        rows = wanted.join(tokens, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens")).orderBy("source").limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        self.shares = plan([(r[0], float(r[1]), int(r[2]), int(r[3])) for r in rows], block, total_tokens)

    def slots(self) -> DataFrame:
        """(slot, shard, source, block): which block of which source stands where in the mix."""
        own = [s for s in self.shares if s.slots]
        ends = np.cumsum([s.slots for s in own])
        total, seed = int(ends[-1]) if own else 0, self.seed

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = np.asarray(batch.column(0))
                drawn = permuted(slot, total, seed)
                which = np.searchsorted(ends, drawn, "right")
                index = drawn - (ends - [s.slots for s in own])[which]
                block = np.zeros(len(slot), np.int64)
                for i in np.unique(which):
                    n = own[i].blocks
                    for r in np.unique(index[which == i] // n):
                        here = np.flatnonzero((which == i) & (index // n == r))
                        block[here] = permuted(index[here] % n, n, seed + 7919 * (int(i) + 1) + 104729 * (int(r) + 1))
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // SHARD_SLOTS), pa.array([own[i].source for i in which], pa.string()), pa.array(block)], ["slot", "shard", "source", "block"])

        return self.docs.sparkSession.range(total).mapInArrow(work, "slot bigint, shard bigint, source string, block bigint")

    def uses(self) -> DataFrame:
        """(doc, source, n_tokens, n_uses, tokens_used): n_uses is the most times that a token of the document is used."""
        used = self.slots().groupBy("source", "block").agg(F.count("*").alias("times"))
        size = self.block
        pieces = self.docs.select("*", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n_tokens") - 1) / size))).alias("block"))
        inside = F.least(F.col("start") + F.col("n_tokens"), (F.col("block") + 1) * size) - F.greatest("start", F.col("block") * size)
        return (
            pieces.withColumn("inside", inside)
            .join(used, ["source", "block"])
            .groupBy("doc", "source", "n_tokens")
            .agg(F.max("times").alias("n_uses"), F.sum(F.col("inside") * F.col("times")).alias("tokens_used"))
        )

    def shards(self) -> DataFrame:
        """(shard, source, n_blocks): the draw of every shard of the output."""
        return self.slots().groupBy("shard", "source").agg(F.count("*").alias("n_blocks"))

    def blocks(self, ids: DataFrame) -> DataFrame:
        """(slot, shard, source, block, tokens): the mix itself, from the token ids(doc, ids) of the documents.

        Every document is cut once where blocks end; the parts are put together by source
        and block, and joined with the slots that use the block. The last block of a source
        may be shorter than the others.
        """
        size = self.block
        first, last = f"start div {size}", f"(start + n_tokens - 1) div {size}"
        part = f"transform(sequence({first}, {last}), b -> struct(b as block, greatest(b * {size} - start, 0) as at, slice(ids, cast(greatest(b * {size} - start, 0) as int) + 1, cast(least(n_tokens, (b + 1) * {size} - start) - greatest(b * {size} - start, 0) as int)) as part))"
        cut = self.docs.join(ids.select("doc", "ids"), "doc").select("source", "start", F.explode(F.expr(part)).alias("x"))
        own = cut.groupBy("source", F.col("x.block").alias("block")).agg(F.sort_array(F.collect_list(F.struct((F.col("start") + F.col("x.at")).alias("at"), F.col("x.part").alias("part")))).alias("parts"))
        return self.slots().join(own.select("source", "block", F.flatten("parts.part").alias("tokens")), ["source", "block"]).select("slot", "shard", "source", "block", "tokens")
