"""Problem 2: long exact spans shared between records, by chained seeds.

Seeds are the least hashes of k bases among the k-base words of every stretch of
`span` bases, so that two records that share such a stretch share its seed at the
same place. Shared seeds are joined, extended to exact matches, and the matches of
two records are chained in order in both, with a cost for gaps, by a Fenwick tree.
The parts between the matches of a chain are aligned, so that a chain is a fuzzy
passage with its number of edits; the exact spans are the long matches in the chains.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from kmerloom.llm.batches import BASE_CODES, UNCALLED, flat_strings, slices
from kmerloom.operators.intervals import periods_and_gaps
from kmerloom.session import broadcast_if_small, one_row_per_key, stored

SEED = 50
#: Places of one seed up to which all are joined with each other to find spans; beyond it every stretch is joined with one place of another record.
JOINED = 32
#: Places of one seed that a task joins with all others.
PART = 1024
GAP_COST = 0.05
#: Bases by which two matches of a chain may overlap; they count once.
OVERLAP = 25
#: Half of the first band that two parts are aligned in.
BAND = 32
SLICE = 1 << 20
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray, turn: int) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * turn) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(codes: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k codes from each place on, whether all of them are called)."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    bad = np.cumsum(np.r_[0, codes == UNCALLED])
    step, have, done = codes.astype(np.uint64) & np.uint64(3), 1, 0
    out = np.full(n, seed, np.uint64)
    while True:  # pieces of 1, 2, 4 ... 32 bases put k together
        while k - done >= have and (have == 32 or (k - done) & have):
            out = _mixed(out ^ step[done : done + n], 2 * done + 1 + seed)
            done += have
        if done == k:
            return out, bad[k:] == bad[:-k]
        step = (step[:-have] << np.uint64(2 * have)) | step[have:]
        have *= 2


def _slid(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least or greatest of every w values in a row."""
    pick, have = (np.minimum if least else np.maximum), 1
    n = len(x) - w + 1
    while 2 * have <= w:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[:n], x[w - have : w - have + n])


def seeds_of(codes: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the seeds of all called stretches of `span` codes."""
    w = span - k + 1
    hashes, called = window_hashes(codes, k)
    if len(hashes) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = np.where(called, hashes, _MOST)
    bad = np.cumsum(np.r_[0, codes == UNCALLED])
    whole = bad[span:] == bad[:-span]
    least = np.where(whole, _slid(hashes, w, True), np.uint64(0))
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_slid(np.r_[edge, least, edge], w, False) == hashes)
    return at, hashes[at]


def _separated(offsets: np.ndarray, data: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of rows lo to hi with an uncalled place after each, begin of each)."""
    bounds = offsets[lo : hi + 1] - offsets[lo]
    return np.insert(BASE_CODES[data[offsets[lo] : offsets[hi]]], bounds[1:], UNCALLED), bounds + np.arange(hi - lo + 1)


def _over_reads(find, names: list[str], keep: int | None = None):
    """A mapInArrow function: find(codes) gives places and further columns, which are put beside the read, the place in it, and the column number `keep`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (offsets, data) = batch.column(0), flat_strings(batch.column(1))
            for lo, hi in slices(offsets, SLICE):
                codes, bounds = _separated(offsets, data, lo, hi)
                at, *more = find(codes)
                row = np.searchsorted(bounds, at, "right") - 1
                rows = pa.array(row + lo)
                kept = [] if keep is None else [batch.column(keep).take(rows)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), pa.array(at - bounds[row]), *(pa.array(x.astype(np.int64)) for x in more), *kept], ["read", "pos", *names, *([] if keep is None else [batch.schema.names[keep]])]
                )

    return work


def called_stretches(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(begins, lengths) of the stretches of called codes that are long enough."""
    edges = np.diff(np.r_[0, (codes != UNCALLED).astype(np.int8), 0])
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    keep = ends - begins >= least
    return begins[keep], (ends - begins)[keep]


def _extended(span: int, k: int):
    """Lengths to the left and right by which two contexts go on equally from their seed."""
    side = span - k
    width = 2 * side + k

    def grown(equal: np.ndarray) -> np.ndarray:
        stop = ~equal
        return np.where(stop.any(1), stop.argmax(1), equal.shape[1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (BASE_CODES[flat_strings(batch.column(i))[1]].reshape(-1, width) for i in (4, 5))
            equal = (a == b) & (a != UNCALLED)
            keep = equal[:, side : side + k].all(1)  # a seed is compared by its hash until here
            left, right = grown(equal[:, :side][:, ::-1])[keep], grown(equal[:, side + k :])[keep]
            ids = [batch.column(i).filter(pa.array(keep)) for i in range(4)]
            pos_a, pos_b = (np.asarray(ids[i]) for i in (1, 3))
            size = left + k + right
            yield pa.RecordBatch.from_arrays([ids[0], ids[2], *(pa.array(x.astype(np.int64)) for x in (pos_a - left, pos_b - left, size))], ["read_a", "read_b", "a_beg", "b_beg", "size"])

    return work


class FenwickMax:
    """Greatest (value, index) among the first i places, under updates."""

    def __init__(self, n: int):
        self.best = [(-1.0, -1)] * (n + 1)

    def put(self, place: int, value: float, index: int) -> None:
        place += 1
        while place < len(self.best):
            if self.best[place][0] < value:
                self.best[place] = (value, index)
            place += place & -place

    def before(self, place: int) -> tuple[float, int]:
        top = (-1.0, -1)
        while place:
            if self.best[place][0] > top[0]:
                top = self.best[place]
            place -= place & -place
        return top


def chains(a: list[int], b: list[int], size: list[int], gap_cost: float) -> tuple[list[int], list[float]]:
    """(chain of each match, score of each chain) for the matches of two records in order of a, then b.

    A match goes on from an earlier one that ends before it in both records; the two
    may overlap by up to OVERLAP bases, which count once. The score is the number of
    matched bases less gap_cost for every base between the matches, in both records.
    A part of a chain that would add less than it costs stands alone, so a chain
    scores at least the size of each of its matches. Every match is in one chain.
    """
    n = len(a)
    over = min(OVERLAP, min(size, default=0) // 2)
    end_a, end_b = [x + s for x, s in zip(a, size)], [x + s for x, s in zip(b, size)]
    ranks = sorted(set(end_b))
    tree = FenwickMax(len(ranks))
    by_end = sorted(range(n), key=lambda x: (end_a[x], x))
    score, cost, before = [0.0] * n, [0.0] * n, [-1] * n
    done = 0
    for i in range(n):
        while done < n and end_a[by_end[done]] <= a[i] + over:  # such a match begins before i, so its score is settled
            j = by_end[done]
            tree.put(bisect_left(ranks, end_b[j]), score[j] + gap_cost * (end_a[j] + end_b[j]), j)
            done += 1
        score[i] = size[i]
        j = tree.before(bisect_right(ranks, b[i] + over))[1]
        if j >= 0:
            gaps = (a[i] - end_a[j], b[i] - end_b[j])
            price = max(0, -min(gaps)) + gap_cost * sum(max(0, g) for g in gaps)
            if score[j] > price:
                score[i], cost[i], before[i] = size[i] + score[j] - price, price, j
    chain, scores = [-1] * n, []
    for x in sorted(range(n), key=lambda x: (-score[x], x)):
        path = []
        while x >= 0 and chain[x] < 0:
            chain[x] = 0  # taken
            path.append(x)
            x = before[x]
        running = 0.0
        for i in reversed(path):
            running = running - cost[i] if i != path[-1] else 0.0
            if running <= 0:
                running = 0.0
                scores.append(0.0)
            running += size[i]
            chain[i] = len(scores) - 1
            scores[-1] = max(scores[-1], running)
    return chain, scores


def linked(a: list[int], b: list[int], size: list[int], chain: list[int]) -> list[tuple[int, int, int, int, int]]:
    """For each match of two records, in order: (matched bases new to its chain, gap in a from and to, gap in b from and to).

    The gap is what lies between the match and the chain before it; a match that
    overlaps the chain so far is cut at the front, and adds nothing if no base is left.
    """
    ends: dict[int, tuple[int, int]] = {}
    out = []
    for x, y, n, c in zip(a, b, size, chain):
        end_a, end_b = ends.get(c, (x, y))
        cut = max(0, end_a - x, end_b - y)
        if cut >= n:
            out.append((0, end_a, end_a, end_b, end_b))
        else:
            out.append((n - cut, end_a, x + cut, end_b, y + cut))
            ends[c] = x + n, y + n
    return out


def _edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edits from a to b (b not the shorter) over alignments that leave the diagonal by `most` places at most; exact if the result is `most` or less."""
    far = len(a) + len(b) + 1
    diagonals = np.arange(-most, len(b) - len(a) + most + 1)
    row = np.where(diagonals >= 0, diagonals, far)  # row 0: the place in b is the diagonal
    steps = np.arange(len(diagonals))
    padded = np.r_[np.full(most, 255, np.uint8), b, np.full(most + 1, 255, np.uint8)]
    for i, x in enumerate(a):
        other = padded[i : i + len(diagonals)]
        now = row + ((other != x) | (x == UNCALLED))  # the place in b is i + diagonal
        now[:-1] = np.minimum(now[:-1], row[1:] + 1)
        here = i + 1 + diagonals
        now[(here < 0) | (here > len(b))] = far
        row = np.minimum.accumulate(now - steps) + steps
    return int(row[len(b) - len(a) + most])


def edits(a: np.ndarray, b: np.ndarray) -> int:
    """Least number of substitutions, insertions and deletions from a to b; an uncalled base equals none.

    A band around the diagonal is doubled until the result lies within it, so the
    work is the length times the edits.
    """
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return len(b)
    most = BAND
    while True:
        found = _edits_within(a, b, most)
        if found <= most or most >= len(b):
            return found
        most *= 2


@F.pandas_udf(LongType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    codes = [[BASE_CODES[np.frombuffer(x.encode(), np.uint8)] for x in side] for side in (a, b)]
    return pd.Series([edits(x, y) for x, y in zip(*codes)], dtype="int64")


def merged(read_a: np.ndarray, read_b: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The same columns, sorted, with matches of two records on one diagonal that overlap or touch made one."""
    if not len(a):
        return [read_a, read_b, a, b, size]
    order = np.lexsort((a, a - b, read_b, read_a))
    read_a, read_b, a, b, size = (x[order] for x in (read_a, read_b, a, b, size))
    other = np.r_[True, (read_a[1:] != read_a[:-1]) | (read_b[1:] != read_b[:-1]) | (a[1:] - b[1:] != a[:-1] - b[:-1])]
    ahead = np.cumsum(other) * (int((a + size).max()) + 1)  # ends of one diagonal lie beyond those of all before
    reach = np.maximum.accumulate(ahead + a + size)
    begins = np.flatnonzero(other | np.r_[True, (ahead + a)[1:] > reach[:-1]])
    ends = (reach - ahead)[np.r_[begins[1:], len(a)] - 1]
    cols = [x[begins] for x in (read_a, read_b, a, b)] + [ends - a[begins]]
    order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
    return [x[order] for x in cols]


_MATCH = "read_a bigint, read_b bigint, a_beg bigint, b_beg bigint, size bigint, chain int, score double"
_LINKS = ["matched", "a_from", "a_to", "b_from", "b_to"]


def _chained(gap_cost: float, links: bool = False):
    """Merges the matches of a diagonal and adds the chain and its score, and the links if asked for; matches come sorted by the two records."""
    names = ["read_a", "read_b", "a_beg", "b_beg", "size"]

    def done(cols: list[np.ndarray]) -> pa.RecordBatch:
        read_a, read_b, a, b, size = cols = merged(*cols)
        begins = np.flatnonzero(np.r_[len(read_a) > 0, (read_a[1:] != read_a[:-1]) | (read_b[1:] != read_b[:-1])])
        ends = np.r_[begins[1:], len(read_a)]
        chain, score = np.zeros(len(read_a), np.int32), size.astype(float)
        for lo, hi in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist()):
            of, scores = chains(a[lo:hi].tolist(), b[lo:hi].tolist(), size[lo:hi].tolist(), gap_cost)
            chain[lo:hi] = of
            score[lo:hi] = np.array(scores)[of]
        more = []
        if links:
            link = np.c_[size, a, a, b, b]
            for lo, hi in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist()):
                link[lo:hi] = linked(a[lo:hi].tolist(), b[lo:hi].tolist(), size[lo:hi].tolist(), chain[lo:hi].tolist())
            more = list(np.ascontiguousarray(link.T))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*cols, chain, score, *more)], [*names, "chain", "score", *_LINKS[: len(more)]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.r_[k, np.asarray(batch.column(i))] for i, k in enumerate(kept)]
            other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            last = int(other[-1]) + 1 if len(other) else 0  # the last pair may go on in the next batch
            if last:
                yield done([c[:last] for c in cols])
            kept = [c[last:] for c in cols]
        yield done(kept)

    return work


class SharedSpans:
    """Exact spans of at least `span` called bases that two or more records share.

    `reads` has one row for each key (see session.one_row_per_key); case is ignored,
    uncalled bases belong to no span, null and empty sequences have none.
    """

    def __init__(self, reads: DataFrame, key: str, seq: str, span: int = 100, seed: int = SEED, joined: int = JOINED):
        if not 1 <= seed <= span:
            raise ValueError("the seed must not be longer than the span")
        self.span, self.seed, self.joined = span, seed, joined
        rows = reads.select(F.col(key).cast("bigint").alias("read"), F.upper(seq).alias("seq")).filter(F.length("seq") >= span)
        # records with one and the same sequence: the least of them stands for all in the search
        hashed = rows.select("read", F.xxhash64("seq").alias("h1"), F.xxhash64(F.reverse("seq"), F.lit(1)).alias("h2"))
        classes = hashed.groupBy("h1", "h2").agg(F.min("read").alias("class_id"), F.count("*").alias("n")).filter("n > 1")
        self.copies = stored(hashed.join(classes, ["h1", "h2"]).select("read", "class_id"))
        self.rows = rows
        self.classes = rows.join(broadcast_if_small(self.copies.filter("read <> class_id").select("read")), "read", "left_anti")
        self._find_anchors()

    def _find_anchors(self) -> None:
        """Places of seeds that more than one class holds, with the bases around them."""
        span, k = self.span, self.seed

        def find(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at, hashes = seeds_of(codes, span, k)
            return at, hashes.view(np.int64)

        seeds = stored(self.classes.select("read", "seq").mapInArrow(_over_reads(find, ["seed"]), "read bigint, pos bigint, seed bigint"))
        shared = seeds.groupBy("seed").agg(F.min("read").alias("lo"), F.max("read").alias("hi"), F.count("*").alias("places")).filter("lo <> hi").select("seed", "places")
        held = seeds.join(shared, "seed").groupBy("read").agg(F.collect_list(F.struct("seed", "pos", "places")).alias("at"))  # at most a read's length
        side = "-" * (span - k)
        padded = F.encode(F.concat(F.lit(side), "seq", F.lit(side)), "UTF-8")
        width = 2 * span - k
        self.anchors = stored(
            self.classes.join(held, "read")
            .select("read", padded.alias("padded"), F.explode("at").alias("x"))
            .select("read", "x.seed", "x.pos", "x.places", F.expr(f"substring(padded, cast(x.pos as int) + 1, {width})").alias("around"))
        )

    def _joined(self, own: DataFrame) -> DataFrame:
        """(read_a, read_b, a_beg, b_beg, size): exact matches around the seeds of `own`, every place joined with every other.

        The places of a seed with more than PART are dealt to several tasks.
        """
        parts = F.ceil(F.col("places") / PART).cast("int")
        a = own.select("seed", F.pmod(F.hash("read", "pos"), parts).alias("part"), F.col("read").alias("read_a"), F.col("pos").alias("pos_a"), F.col("around").alias("around_a"))
        b = own.select("seed", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("read").alias("read_b"), F.col("pos").alias("pos_b"), F.col("around").alias("around_b"))
        pairs = a.join(b, ["seed", "part"]).filter("read_a < read_b").select("read_a", "pos_a", "read_b", "pos_b", "around_a", "around_b")
        return pairs.mapInArrow(_extended(self.span, self.seed), "read_a bigint, read_b bigint, a_beg bigint, b_beg bigint, size bigint").distinct()

    def _chains(self, matches: DataFrame, links: bool = False) -> DataFrame:
        return (
            matches.repartition("read_a", "read_b")
            .sortWithinPartitions("read_a", "read_b")
            .mapInArrow(_chained(GAP_COST, links), _MATCH + "".join(f", {x} bigint" for x in _LINKS if links))
        )

    def matches(self, links: bool = False) -> DataFrame:
        """(read_a, read_b, a_beg, b_beg, size, chain, score): the exact matches of all pairs of classes, in chains; with `links` also the columns of linked.

        A stretch that n classes hold makes n * (n - 1) / 2 matches.
        """
        return self._chains(self._joined(self.anchors), links)

    def spanning(self) -> DataFrame:
        """Matches in chains that cover every shared place of every record, as few as do.

        Seeds with up to `joined` places are joined with each other. Of the others every
        stretch is joined with one place of it in another record, so that a stretch that
        n records hold makes n matches. Records with one and the same sequence are joined
        with the least of them.
        """
        span = self.span

        def find(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return called_stretches(codes, span)

        members = self.copies.filter("read <> class_id")
        copied = (
            self.rows.join(broadcast_if_small(members), "read")
            .select("read", "seq", "class_id")
            .mapInArrow(_over_reads(find, ["size"], 2), "read bigint, pos bigint, size bigint, class_id bigint")
            .select(F.col("class_id").alias("read_a"), F.col("read").alias("read_b"), F.col("pos").alias("a_beg"), F.col("pos").alias("b_beg"), "size")
        )
        few = self._joined(self.anchors.filter(F.col("places") <= self.joined))
        return self._chains(few.unionByName(self._starred()).unionByName(copied))

    def passages(self) -> DataFrame:
        """(read_a, read_b, a_beg, a_end, b_beg, b_end, n_matches, longest_match, score, n_equal, n_edits, identity): the chains of two classes, aligned.

        All seeds are joined, so a stretch that n classes hold makes n * (n - 1) / 2 passages.
        Only the parts between the matches of a chain are cut out of the sequences and
        aligned; a part that one record lacks needs no sequence. `identity` is the share
        of equal bases among these and the edits.
        """
        chained = stored(self.matches(True))
        keys = ["read_a", "read_b", "chain"]
        gap_a, gap_b = F.col("a_to") - F.col("a_from"), F.col("b_to") - F.col("b_from")
        both = (gap_a > 0) & (gap_b > 0)
        gaps = chained.filter(both).select(*keys, *_LINKS[1:])
        for x in "ab":
            seqs = self.classes.select(F.col("read").alias(f"read_{x}"), "seq")
            part = F.expr(f"substring(seq, cast({x}_from as int) + 1, cast({x}_to - {x}_from as int))")
            gaps = gaps.join(seqs, f"read_{x}").withColumn(f"part_{x}", part).drop("seq", f"{x}_from", f"{x}_to")
        n = F.greatest(F.length("part_a"), F.length("part_b"))
        aligned = gaps.withColumn("n_edits", _edits("part_a", "part_b")).select(*keys, "n_edits", (n - F.col("n_edits")).alias("n_equal"))
        own = chained.select(*keys, "a_beg", "b_beg", "size", "score", F.col("matched").alias("n_equal"), F.when(both, F.lit(0)).otherwise(gap_a + gap_b).alias("n_edits"))
        found = (
            own.unionByName(aligned, allowMissingColumns=True)
            .groupBy(*keys)
            .agg(
                F.min("a_beg").alias("a_beg"),
                F.max(F.col("a_beg") + F.col("size")).alias("a_end"),
                F.min("b_beg").alias("b_beg"),
                F.max(F.col("b_beg") + F.col("size")).alias("b_end"),
                F.count("size").alias("n_matches"),
                F.max("size").alias("longest_match"),
                F.max("score").alias("score"),
                F.sum("n_equal").alias("n_equal"),
                F.sum("n_edits").alias("n_edits"),
            )
        )
        return found.drop("chain").withColumn("identity", F.round(F.col("n_equal") / (F.col("n_equal") + F.col("n_edits")), 6))

    def _starred(self) -> DataFrame:
        """Matches of one span around seeds with more than `joined` places: each place of a stretch with the least one of it, those in its record with the greatest."""
        span, k = self.span, self.seed
        side, width = span - k, 2 * span - k

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 2000):
                    part = batch.slice(lo, 2000)
                    offsets, data = flat_strings(part.column(2))
                    codes = BASE_CODES[data]
                    h1, called = window_hashes(codes, span)
                    h2, _ = window_hashes(codes, span, 1)
                    at = (np.arange(part.num_rows)[:, None] * width + np.arange(side + 1)).ravel()
                    at = at[called[at]]
                    row = at // width
                    beg = np.asarray(part.column(1))[row] - side + at % width
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(beg), pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64))], ["read", "beg", "h1", "h2"])

        many = self.anchors.filter(F.col("places") > self.joined).select("read", "pos", "around")
        stretches = stored(many.mapInArrow(work, "read bigint, beg bigint, h1 bigint, h2 bigint").distinct())
        place = F.struct("read", "beg")
        ends = stretches.groupBy("h1", "h2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo.read <> hi.read")
        other = F.when(F.col("read") == F.col("lo.read"), F.col("hi")).otherwise(F.col("lo"))
        both = stretches.join(ends, ["h1", "h2"]).select("read", "beg", other.alias("other"))
        first = F.col("read") < F.col("other.read")
        a, b = (F.when(x, place).otherwise(F.col("other")) for x in (first, ~first))
        return both.select(a.alias("a"), b.alias("b")).select(
            F.col("a.read").alias("read_a"), F.col("b.read").alias("read_b"), F.col("a.beg").alias("a_beg"), F.col("b.beg").alias("b_beg"), F.lit(span).cast("bigint").alias("size")
        )

    def spans(self) -> DataFrame:
        """(read, span_beg, span_end): the maximal stretches of shared places of every record.

        Chains with a score below the span can hold no such stretch; of the others the
        matches that are long enough are the spans (what lies between the matches of a
        chain differs within every span), and spans that touch are put together.
        """
        long = self.spanning().filter((F.col("score") >= self.span) & (F.col("size") >= self.span))
        sides = [F.struct(F.col(f"read_{x}").alias("read"), F.col(f"{x}_beg").alias("beg"), (F.col(f"{x}_beg") + F.col("size")).alias("end")) for x in "ab"]
        every = long.select(F.explode(F.array(*sides)).alias("s")).select("s.read", "s.beg", "s.end")
        return periods_and_gaps(every, "read", "beg", "end").filter("kind = 'period'").select(F.col("entity").alias("read"), F.col("beg").alias("span_beg"), F.col("end").alias("span_end"))


def shared_spans(df: DataFrame, key: str, seq: str, span: int = 100) -> SharedSpans:
    return SharedSpans(one_row_per_key(df.select(key, seq), key), key, seq, span)
