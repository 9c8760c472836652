"""Problem 6: how often every word of k bases occurs and in how many records.

Every task keeps its words in a burst trie: the leaves are sorted containers below
a prefix, and a container that holds too many words bursts into its four children.
Containers are shuffled by the first bases of their prefix (the route), their words
as packed differences with counters only where these are not 1. A reader merges the
containers whose ranges lie in one another, i.e. the matching subtrees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.batches import BASE_CODES, BASES, UNCALLED, flat_strings, slices

#: Words that a task holds before it writes its trie; words of a container before it bursts.
HELD = 6_000_000
CAPACITY = 1 << 16
SLICE = 1 << 20
#: Words of a route (merged at once in one task at most) and of a reader, repeated ones counted, that routes and readers are chosen for.
PER_ROUTE, PER_READER = 1 << 20, 1 << 26
MOST_ROUTE_BASES = 11
ZSTD = "zstd"


def words_of(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin positions, words as numbers) of all k-base words without an uncalled position."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bad = np.cumsum(np.r_[0, codes == UNCALLED])
    at = np.flatnonzero(bad[k:] == bad[:-k])
    step, have, out, done = codes.astype(np.uint64) & np.uint64(3), 1, None, 0
    while True:  # words of 1, 2, 4 ... bases; those in the binary form of k are put together
        if k & have:
            out = step[:n] if out is None else (out[:n] << np.uint64(2 * have)) | step[done : done + n]
            done += have
        if 2 * have > k:
            return at, out[at]
        step = (step[:-have] << np.uint64(2 * have)) | step[have:]
        have *= 2


def strings_of(words: np.ndarray, k: int) -> pa.Array:
    letters = np.frombuffer(BASES.encode(), np.uint8)
    out = np.empty((len(words), k), np.uint8)
    for j in range(k):
        out[:, j] = letters[((words >> np.uint64(2 * (k - 1 - j))) & np.uint64(3)).astype(np.int64)]
    offsets = np.arange(len(words) + 1, dtype=np.int32) * k
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))


def counted(words: np.ndarray, records: np.ndarray, n_records: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words in order, occurrences, records that hold them)."""
    spare = 64 - 2 * k
    if n_records <= 1 << spare:
        packed = (words << np.uint64(spare)) | records.astype(np.uint64) if spare else words.copy()
        packed.sort()
        words, fresh = packed >> np.uint64(spare), np.r_[True, packed[1:] != packed[:-1]]
    else:
        order = np.lexsort((records, words))
        words, records = words[order], records[order]
        fresh = np.r_[True, (words[1:] != words[:-1]) | (records[1:] != records[:-1])]
    begins = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    return words[begins], np.diff(np.r_[begins, len(words)]), np.add.reduceat(fresh.astype(np.int64), begins)


def _planes(x: np.ndarray, width: int) -> bytes:
    return x.view(np.uint8).reshape(len(x), x.itemsize)[:, :width].T.tobytes()


def _from_planes(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw[: n * width].reshape(width, n).T
    return out.view(np.uint64).reshape(n)


def packed_container(words: np.ndarray, base: int, occurrences: np.ndarray, records: np.ndarray) -> bytes:
    """A container: differences of its words as byte planes, then the counters that are above 1."""
    steps = np.diff(np.r_[np.uint64(base), words])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    more = np.flatnonzero(occurrences > 1)
    extra = np.stack([np.diff(np.r_[0, more]), occurrences[more], records[more]]).astype(np.uint64)
    wide = max(1, (int(extra.max()).bit_length() + 7) // 8) if len(more) else 1
    body = _planes(steps, width) + b"".join(_planes(np.ascontiguousarray(row), wide) for row in extra)
    return np.array([len(words), width, len(more), wide, len(body)], np.uint32).tobytes() + pa.compress(body, ZSTD, asbytes=True)


def unpacked_container(raw: bytes, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, places of counters above 1, those occurrences, those records)."""
    n, width, m, wide, size = np.frombuffer(raw, np.uint32, 5).tolist()
    body = np.frombuffer(pa.decompress(raw[20:], size, ZSTD, asbytes=True), np.uint8)
    words = np.cumsum(_from_planes(body, n, width), dtype=np.uint64) + np.uint64(base)
    rest = body[n * width :]
    at, occ, rec = (_from_planes(rest[i * m * wide :], m, wide).astype(np.int64) for i in range(3))
    return words, np.cumsum(at), occ, rec


def containers(words: np.ndarray, k: int, route_bases: int, capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(route, first possible word, word after the last possible, from, to) of the leaves of a burst trie over sorted words."""
    shift = 2 * (k - route_bases)
    edges = np.searchsorted(words, np.arange(1, 4**route_bases, dtype=np.uint64) << np.uint64(shift))
    edges = np.r_[0, edges, len(words)]
    for route in np.flatnonzero(np.diff(edges)):
        leaves = [(int(route) << shift, shift, int(edges[route]), int(edges[route + 1]))]
        while leaves:
            first, free, lo, hi = leaves.pop()
            if hi - lo > capacity and free:  # burst
                free -= 2
                cuts = [lo, *(lo + np.searchsorted(words[lo:hi], np.uint64(first + (c << free))) for c in (1, 2, 3)), hi]
                leaves += [(first + (c << free), free, int(cuts[c]), int(cuts[c + 1])) for c in (3, 2, 1, 0) if cuts[c] < cuts[c + 1]]
            else:
                yield int(route), first, first + (1 << free), lo, hi


_LEAF = "route int, first bigint, after bigint, listed boolean, leaf binary"


def _tries(df: DataFrame, k: int, route_bases: int, listed: bool, held: int, capacity: int) -> DataFrame:
    """Leaves of the tries over a one-column table of sequences, a trie for every `held` words of a task."""

    def leaves(parts: list, n_records: int) -> pa.RecordBatch:
        words, occ, rec = counted(np.concatenate([w for w, _ in parts]), np.concatenate([r for _, r in parts]), n_records, k)
        parts.clear()
        rows = [(a, b, c, listed, packed_container(words[lo:hi], b, occ[lo:hi], rec[lo:hi])) for a, b, c, lo, hi in containers(words, k, route_bases, capacity)]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["route", "first", "after", "listed", "leaf"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, n_records = [], 0, 0
        for batch in batches:
            offsets, data = flat_strings(batch.column(0))
            for lo, hi in slices(offsets, SLICE):
                # an uncalled position between two records keeps words inside their record
                bounds = offsets[lo : hi + 1] - offsets[lo] + np.arange(hi - lo + 1)
                codes = np.insert(BASE_CODES[data[offsets[lo] : offsets[hi]]], offsets[lo + 1 : hi + 1] - offsets[lo], UNCALLED)
                at, words = words_of(codes, k)
                parts.append((words, (np.searchsorted(bounds, at, "right") - 1 + n_records).astype(np.uint32)))
                size, n_records = size + len(words), n_records + hi - lo
                if size >= held:
                    yield leaves(parts, n_records)
                    size = n_records = 0
        if size:
            yield leaves(parts, n_records)

    return df.mapInArrow(work, _LEAF)


def _merge(found: list[tuple], k: int, only_listed: bool) -> pa.RecordBatch | None:
    """Counts of one subtree from its leaves (first, listed, bytes)."""
    mine = [unpacked_container(raw, first) for first, listed, raw in found if not listed]
    asked = [unpacked_container(raw, first)[0] for first, listed, raw in found if listed]
    if only_listed and not asked:
        return None
    every = np.concatenate([w for w, *_ in mine]) if mine else np.zeros(0, np.uint64)
    every.sort()
    begins = np.flatnonzero(np.r_[len(every) > 0, every[1:] != every[:-1]])
    words = every[begins]
    occ = np.diff(np.r_[begins, len(every)])  # a leaf counts 1 for each of its words ...
    rec = occ.copy()
    for w, at, o, r in mine:  # ... and the rest where there is more
        to = np.searchsorted(words, w[at])
        occ[to] += o - 1
        rec[to] += r - 1
    if only_listed:
        want = np.unique(np.concatenate(asked))
        to = np.minimum(np.searchsorted(words, want), max(len(words) - 1, 0))
        there = words[to] == want if len(words) else np.zeros(len(want), bool)
        words, occ, rec = want, *(np.where(there, x[to] if len(x) else 0, 0) for x in (occ, rec))
    return pa.RecordBatch.from_arrays([strings_of(words, k), pa.array(occ, pa.int64()), pa.array(rec, pa.int64())], ["word", "n_occurrences", "n_records"])


def word_counts(df: DataFrame, seq: str, k: int, listed: DataFrame | None = None, held: int = HELD, capacity: int = CAPACITY) -> DataFrame:
    """(word, n_occurrences, n_records) of every k-base word in the sequences, a row of df being a record.

    Words hold called bases only, in upper case; overlapping places count. Null,
    empty and short sequences hold none. With `listed` (one column of words of k
    called bases) the rows are the listed words, absent ones with 0; everything is
    counted all the same. k is at most 31.
    """
    if not 2 <= k <= 31:
        raise ValueError("k must be from 2 to 31")
    spark = df.sparkSession
    # routes are as long as keeps the words of one, and the routes of a reader, few at any size of the table
    n_words = df.agg(F.sum(F.length(seq).cast("bigint"))).first()[0] or 0
    readers = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words // PER_READER))
    route_bases = min(k, MOST_ROUTE_BASES, max(4, math.ceil(math.log(64 * readers, 4)), math.ceil(math.log(max(1, n_words / PER_ROUTE), 4))))
    leaves = _tries(df.select(seq), k, route_bases, False, held, capacity)
    if listed is not None:
        leaves = leaves.unionByName(_tries(listed.select(F.col(listed.columns[0])), k, route_bases, True, held, capacity))
    only_listed = listed is not None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, after = [], -1
        for batch in batches:
            firsts, afters, flags, raws = (batch.column(i) for i in (1, 2, 3, 4))
            for i in range(batch.num_rows):
                first, end = firsts[i].as_py(), afters[i].as_py()
                if first >= after and group:
                    if (out := _merge(group, k, only_listed)) is not None:
                        yield out
                    group, after = [], -1
                group.append((first, flags[i].as_py(), raws[i].as_py()))
                after = max(after, end)
        if group and (out := _merge(group, k, only_listed)) is not None:
            yield out

    return (
        leaves.repartition(readers, "route")
        .sortWithinPartitions("first", F.col("after").desc())
        .select("route", "first", "after", "listed", "leaf")
        .mapInArrow(work, "word string, n_occurrences bigint, n_records bigint")
    )
