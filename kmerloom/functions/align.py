"""Pairwise alignments as Arrow-batched functions; the inner loops are numpy over anti-diagonals or rows.

Spark brings the pairs (joins on shared k-mers, length gates) and spreads them.
Sequences are whole; a null sequence counts as an empty one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

ALIGNMENT = T.StructType([T.StructField("score", T.DoubleType())] + [T.StructField(x, T.IntegerType()) for x in ("align_len", "matches", "mismatches", "gap_positions", "gap_extends", "end1", "end2")])
_DIAG, _LEFT, _UP, _STOP = 3, 2, 1, 0
#: Bytes up to which the table of a pair is kept whole for the way back.
WHOLE = 1 << 25


def _bytes(x: str | None) -> np.ndarray:
    return np.frombuffer((x or "").encode("latin-1", "replace"), np.uint8)


class _Rows:
    """Rows 0 to n of a table, each made from the one before by step(state, i) -> state; the last member of a state is what the way back reads.

    Up to WHOLE bytes all of them are kept. Of a larger table the states of every
    sqrt(n)-th row are, and the rows between are made again, a block at a time.
    """

    def __init__(self, n: int, first: tuple, step: Callable[[tuple, int], tuple], look: Callable[[int, tuple], None] = lambda i, state: None, size: int = 0):
        self.step, self.every, self.block = step, max(n, 1), 0
        whole = (n + 1) * (size or first[-1].nbytes) <= WHOLE
        if not whole:
            self.every, self.block = isqrt(n) + 1, -1
        self.states, self.rows, state = [first], [first[-1]], first
        for i in range(1, n + 1):
            state = step(state, i)
            look(i, state)
            if whole:
                self.rows.append(state[-1])
            elif i % self.every == 0:
                self.states.append(state)

    @classmethod
    def of(cls, rows: list) -> _Rows:
        """A table of which all rows are there."""
        table = cls(0, (rows[0],), lambda state, i: state, size=1)
        table.rows, table.every = rows, max(1, len(rows) - 1)
        return table

    def two(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Row i and the one above; that of 0 stands for its own."""
        block = max(0, i - 1) // self.every
        if block != self.block:
            state, self.block = self.states[block], block
            self.rows = [state[-1]]
            for x in range(block * self.every + 1, i + 1):  # the way back never goes down
                state = self.step(state, x)
                self.rows.append(state[-1])
        at = i - block * self.every
        return self.rows[at], self.rows[max(0, at - 1)]

    def one(self, i: int) -> object:
        """Row i."""
        return self.rows[i] if not self.block and i < len(self.rows) else self.two(i)[0]


def affine(s1: str | None, s2: str | None, match: float = 1.0, mismatch: float = -1.0, opening: float = -1.0, extending: float = -0.5, fitting: bool = False) -> tuple:
    """Affine-gap alignment: local, or (fitting) of all of s1 to any part of s2.

    A gap of n costs opening + n * extending, and opening is not positive. Among equal
    scores a step prefers the diagonal, then a gap in s1, then one in s2, and the last
    best end wins. An alignment without a positive score, or of an empty sequence, is
    empty.
    """
    if opening > 0:
        raise ValueError("opening must not be positive")
    a, b = _bytes(s1), _bytes(s2)
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0, 0, 0, 0, 0, 0, 0, 0
    costs = (match, mismatch, opening, extending)
    halves = all(float(2 * x).is_integer() for x in costs) and max(map(abs, costs)) * (n + m) < 1 << 27
    kind = np.int32 if halves else np.float64  # whole numbers of halves are exact and quick
    same, other, opened, longer = (kind(2 * x) if halves else kind(x) for x in costs)
    none = kind(-(1 << 29))
    pair = {x: np.where(b == x, same, other).astype(kind) for x in np.unique(a).tolist()}
    slope = longer * np.arange(m + 1, dtype=kind)
    letters = a.tolist()

    def step(state: tuple, i: int) -> tuple:
        score, down, _ = state
        diag = score[:-1] + pair[letters[i - 1]]
        up = np.maximum(down + longer, score[1:] + (opened + longer))
        best = np.empty(m + 1, kind)
        best[0] = opened + longer * i if fitting else 0
        np.maximum(diag, up, out=best[1:])
        if not fitting:
            np.maximum(best, 0, out=best)
        left = (np.maximum.accumulate(best - slope) + (slope + opened))[:-1] + longer  # a gap that follows a gap is never better
        np.maximum(best[1:], left, out=best[1:])
        way = np.empty(m + 1, np.int8)
        way[0] = _UP if fitting else _STOP
        now = best[1:]
        way[1:] = np.where(diag == now, _DIAG, np.where(left == now, _LEFT, up == now))
        return best, up, way

    top, end = none, (0, 0)

    def look(i: int, state: tuple) -> None:
        nonlocal top, end
        if i == n or not fitting:
            row = state[0][1:]
            if (most := row.max()) >= top:
                top, end = most, (i, m - int(row[::-1].argmax()))

    table = _Rows(n, (np.zeros(m + 1, kind), np.full(m, none, kind), np.zeros(m + 1, np.int8)), step, look)
    if top < 0 or not fitting and top == 0:
        return 0.0, 0, 0, 0, 0, 0, 0, 0
    i, j = end
    steps = []
    while i or j:
        w = int(table.two(i)[0][j])
        if w == _STOP:
            break
        steps.append(w if w != _DIAG else (4 if a[i - 1] == b[j - 1] else 5))
        i, j = i - (w in (_DIAG, _UP)), j - (w in (_DIAG, _LEFT))
    kinds = np.array(steps, np.int8)
    gaps = int(np.isin(kinds, (_LEFT, _UP)).sum())
    runs = sum(int(np.sum((kinds == g) & (np.r_[0, kinds[:-1]] != g))) for g in (_LEFT, _UP))
    return float(top) / (2 if halves else 1), len(kinds), int((kinds == 4).sum()), int((kinds == 5).sum()), gaps, gaps - runs, *end


#: Cells of a diagonal, and bytes of a table, that the pairs aligned side by side have together.
SIDE, SIDE_TABLE = 48_000, 1 << 27


def _side_by_side(pairs: list[tuple[bytes, bytes]], deep: bool = False) -> list[list[int]]:
    """Numbers of the pairs in groups of like lengths; with deep, groups whose tables fit SIDE_TABLE, without the pairs that are too large for that."""
    size = [(len(a), len(b)) for a, b in pairs]
    order = sorted((i for i, (n, m) in enumerate(size) if n and m and not (deep and 4 * (n + 1) * (m + 1) > SIDE_TABLE)), key=lambda i: size[i])
    wide = max(64, round(len(order) ** 0.5 * 5))
    order = [i for k in range(0, len(order), wide) for i in sorted(order[k : k + wide], key=lambda i: size[i][1])]
    out: list[list[int]] = []
    n = m = 0
    for i in order:
        x, y = max(n, size[i][0]), max(m, size[i][1])
        most = len(out[-1]) + 1 if out else 0
        if not out or most * min(x, y) > SIDE or deep and 2 * (1 + (x + y > 8_000)) * most * (x + 1) * (y + 1) > SIDE_TABLE:
            out.append([])
            x, y = size[i]
        out[-1].append(i)
        n, m = x, y
    return out


def _coded(pairs: list[tuple[bytes, bytes]], unit: int, extra: int) -> tuple | None:
    """(a, b backwards) as matrices place x pair of numbers whose common bits are at least `unit` for equal letters, and `extra` for others and beyond the ends; None if there are too many letters."""
    letters = sorted(set().union(*(x for p in pairs for x in p)))
    n, m = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    kind = np.int16 if 2 * min(n, m) + n + m < 32_000 and unit << len(letters) < 1 << 15 else np.int32
    if unit << len(letters) >= 1 << 31:
        return None
    code = np.full(256, extra, kind)
    code[letters] = [(unit << k) | extra for k in range(len(letters))]
    a, b = np.full((n, len(pairs)), extra, kind), np.full((m, len(pairs)), extra, kind)
    for k, (x, y) in enumerate(pairs):
        a[: len(x), k] = code[np.frombuffer(x, np.uint8)]
        b[m - len(y) :, k] = code[np.frombuffer(y, np.uint8)[::-1]]
    return a.ravel(), b.ravel(), n, m, kind


def _affine_together(pairs: list[tuple[bytes, bytes]], fitting: bool, memory: np.ndarray) -> list[tuple] | None:
    """affine() with its own costs for pairs of like lengths, a diagonal of all of them at a time.

    Scores are doubled, and i + j is added to that of the place (i, j): so a gap costs
    nothing more for each base, an equal one counts 4 and another one 0. All scores
    are kept in `memory`, and the way back is found from them.
    """
    if (coded := _coded(pairs, 4, 0)) is None:
        return None
    a, b, n, m, kind = coded
    w = len(pairs)
    table = memory.view(kind)
    low = np.iinfo(kind).min // 2
    left, up, up2 = (np.full((n + 1) * w, low, kind) for _ in range(3))
    same, opened, floor = np.empty((3, (n + 1) * w), kind)
    four, most = np.full((n + 1) * w, 4, kind), np.zeros((n + 1) * w, kind)  # an operation with one number is slower than with a row of them
    d = np.arange(n + m + 1)
    low_row, high_row = np.maximum(0, d - m), np.minimum(n, d)
    sizes = (high_row - low_row + 1) * w
    begins = np.cumsum(sizes) - sizes - low_row * w
    if sizes.sum() > len(table):
        return None
    begin = begins.tolist()
    for d in range(n + m + 1):
        at, x, y = begin[d], max(1, d - m), min(n, d - 1)
        if x <= y:  # the places within the table
            back, s = slice((x - 1) * w, y * w), slice(x * w, (y + 1) * w)
            part, best, gap = same[s], table[at + x * w : at + (y + 1) * w], opened[(x - 1) * w : (y + 1) * w]
            np.bitwise_and(a[back], b[(m - d + x) * w : (m - d + y + 1) * w], out=part)
            np.minimum(part, four[s], out=part)
            np.add(part, table[begin[d - 2] + (x - 1) * w : begin[d - 2] + y * w], out=part)
            np.subtract(table[begin[d - 1] + (x - 1) * w : begin[d - 1] + (y + 1) * w], 2, out=gap)
            np.maximum(left[s], gap[w:], out=left[s])
            np.maximum(up[back], gap[:-w], out=up2[s])
            up, up2 = up2, up
            np.maximum(part, left[s], out=part)
            if fitting:
                np.maximum(part, up[s], out=best)
            else:
                np.maximum(part, up[s], out=part)
                floor[s].fill(d)
                np.maximum(part, floor[s], out=best)
                np.subtract(best, d, out=part)
                np.maximum(most[s], part, out=most[s])
        if d <= m:
            table[at : at + w] = d
        if d <= n and d:
            table[at + d * w : at + (d + 1) * w] = -2 if fitting else d
    scores, out, most = memoryview(table), [], most.reshape(n + 1, w)
    for k, (s1, s2) in enumerate(pairs):
        i = len(s1) if fitting else n - int(most[::-1, k].argmax())
        last = table[begins[i + 1 : i + len(s2) + 1] + (i * w + k)] - np.arange(i + 1, i + len(s2) + 1, dtype=kind)
        j = len(s2) - int(last[::-1].argmax())
        top = int(last[j - 1])
        if top < 0 or not fitting and top == 0:
            out.append((0.0, 0, 0, 0, 0, 0, 0, 0))
            continue
        ends, equal, other, gaps, extends, before = (i, j), 0, 0, 0, 0, 0
        while i and j:
            own, alike = scores[begin[i + j] + i * w + k], s1[i - 1] == s2[j - 1]
            if own == scores[begin[i + j - 2] + (i - 1) * w + k] + 4 * alike:
                i, j, before = i - 1, j - 1, 0
                if alike:
                    equal += 1
                else:
                    other += 1
                continue
            # a gap leads here from a place with own + 2, and where one does, none between has less than own
            c = j - 1
            while c and own <= scores[begin[i + c] + i * w + k] != own + 2:
                c -= 1
            if scores[begin[i + c] + i * w + k] == own + 2:
                way = _LEFT
                j -= 1
            else:
                c = i - 1
                while c and own <= scores[begin[c + j] + c * w + k] != own + 2:
                    c -= 1
                if scores[begin[c + j] + c * w + k] != own + 2:
                    break
                way = _UP
                i -= 1
            gaps += 1
            extends += before == way
            before = way
        if fitting and i and not j:
            gaps, extends = gaps + i, extends + i - (before != _UP)
        out.append((top / 2, equal + other + gaps, equal, other, gaps, extends, *ends))
    return out


#: Rows on either side of its middle of the band in which an alignment is expected, diagonals made between two looks at the places that still count, and length of the words that lead to the band.
BAND, LOOK, WORD = 48, 32, 12
#: Places of a diagonal that pairs aligned within bounds have together, and letters of such a pair at most.
NARROW, LONGEST = 30_000, 15_000
_LOW = -16_000


def _start(a: bytes, b: bytes) -> tuple[int, int]:
    """Where the diagonal that most common words of a and b lie near begins; (0, 0) if there are none."""
    if len(a) > len(b):
        return _start(b, a)[::-1]
    found = []
    for i in range(0, len(a) - WORD + 1, max(8, len(a) // 64)):
        if (j := b.find(a[i : i + WORD])) >= 0:
            found.append(j - i)
    if not found:
        return 0, 0
    found.sort()
    most = max(range(len(found)), key=lambda k: bisect_right(found, found[k] + BAND) - k)
    at = found[(most + bisect_right(found, found[most] + BAND)) // 2]
    return max(0, -at), max(0, at)


def _hashes(x: bytes) -> np.ndarray:
    """A number of 16 bits for the eight letters from each place on."""
    return ((_eights(np.frombuffer(x, np.uint8)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.intp)


def _most_left(x: bytes, own: np.ndarray, other: np.ndarray, there: np.ndarray) -> np.ndarray:
    """From each place of x on, twice the score that the letters left can add at most: one for each, less 1.5 for each eight of them that the other sequence doesn't hold, as these need a mismatch or a gap."""
    n = len(x)
    less = np.zeros(n + 1, np.int32)
    if len(own):
        there[other] = 1
        lacking = (1 - there[own]).tobytes()
        there[other] = 0
        at = lacking.rfind(1)
        places = []
        while at >= 0:
            places.append(at)
            at = lacking.rfind(1, 0, max(0, at - 7))
        less[places] = 3
    whole = 2 * np.arange(n, -1, -1, dtype=np.int32)
    return np.minimum(whole, whole - less[::-1].cumsum(dtype=np.int32)[::-1] + 1)  # 1: an alignment may end before the last letter of such eight


class _Bounded:
    """A pair whose local alignment is looked for within bounds.

    As in _affine_together scores are doubled and 1 + i + j is added. `least` is the
    doubled score that the pair has at least, `left` what can still be added from a row
    or a column on. Of a diagonal only the rows from the first to the last one from
    which that score can be reached are made: all alignments with it or more lie
    there, so they and the choice between them are those of the whole table. Only the
    scores of a band are kept. `lost`: such an alignment may end beyond the band.
    """

    def __init__(self, key: int, pair: tuple[bytes, bytes], code: np.ndarray, start: tuple[int, int], least: int, left: tuple[np.ndarray, np.ndarray]):
        self.key, self.pair, self.n, self.m, self.least, self.lost = key, pair, len(pair[0]), len(pair[1]), least, least <= 4 * LOOK
        self.off = start[0] - start[1]
        # codes of the letters, and what is left less the score needed; columns backwards, from LOOK beyond the last one on
        self.rows, self.cols = np.zeros((2, self.n + 2 * LOOK + 2), np.int16), np.zeros((2, self.m + 4 * LOOK + 4), np.int16)
        self.rows[0, 1 : self.n + 1] = code[np.frombuffer(pair[0], np.uint8)]
        self.cols[0, 2 * LOOK : 2 * LOOK + self.m] = code[np.frombuffer(pair[1], np.uint8)[::-1]]
        self.rows[1], self.cols[1] = _LOW, _LOW
        self.rows[1, : self.n + 1] = left[0] - least
        self.cols[1, 2 * LOOK : 2 * LOOK + self.m + 1] = left[1][::-1] - least
        self.zero = 2 * LOOK + self.m  # place of column 0
        self.lo, self.hi, self.period = 0, 0, 0
        self.first_rows: list[int] = []
        self.slot = 0

    def first(self) -> int:
        """First row of the band in the diagonals of the period."""
        return (self.period * LOOK + self.off) // 2 - BAND


def _run(waiting: Iterator[_Bounded], bands: np.ndarray, free: list[int]) -> Iterable[_Bounded]:
    """Makes the pairs beside each other, each with the rows that it needs, and gives those that are done; the scores of their bands are in the slots of `bands`."""
    own: list[_Bounded] = []
    state, places = np.full((4, 1), _LOW, np.int16), []  # the last diagonals but one and last, gaps to the left and up
    width = 2 * BAND + 1 + LOOK // 2
    following = next(waiting, None)
    guard, blank = np.full((4, 1), _LOW, np.int16), np.full((4, 3 * LOOK + 4 * BAND), _LOW, np.int16)
    no_rows, size = np.array([[0], [_LOW]], np.int16).repeat(LOOK, 1), 0
    while own or following:
        while following and free and (not own or size < NARROW):
            own.append(following)
            own[-1].slot, following = free.pop(), next(waiting, None)
            places.append((0, 0))
            size += 2 * LOOK
        # the rows of each pair: a lower place, the rows up to LOOK beyond the last one, and places for the letters to move along
        states, rows, cols, bases, at = [], [], [], [], 0
        for x, (begin, end) in zip(own, places):
            lo, top = x.lo, x.hi + LOOK
            states += guard, state[:, begin:end], blank[:, : top + LOOK - lo - (end - begin)]
            rows += no_rows[:, :1], x.rows[:, lo : top + 1], no_rows[:, : LOOK - 1]
            q = x.zero - x.period * LOOK - LOOK + 1 + lo
            cols += no_rows[:, :1], x.cols[:, q : q + top - lo + LOOK]
            bases.append(at)
            at += top - lo + LOOK + 1
        size = at
        cols.append(no_rows)
        state, rows, cols = (np.concatenate(x, 1) for x in (states, rows, cols))
        guards = np.array(bases)
        table = np.empty((LOOK + 2, size), np.int16)
        table[:2] = state[:2]
        lefts, up = state[2], state[3]
        (a, down), (b, right) = rows, cols
        part, floor, gap, up2 = np.empty((4, size), np.int16)
        four = np.full(size, 4, np.int16)
        for t in range(1, LOOK + 1):
            one, two, now = table[t], table[t - 1], table[t + 1]
            np.bitwise_and(a, b[LOOK - t : LOOK - t + size], out=part)
            np.minimum(part, four, out=part)
            np.add(part[1:], two[:-1], out=part[1:])
            np.subtract(one, 2, out=gap)
            np.maximum(lefts, gap, out=lefts)
            np.maximum(up[:-1], gap[:-1], out=up2[1:])
            up, up2 = up2, up
            up[guards] = _LOW
            np.maximum(part, lefts, out=part)
            np.maximum(part, up, out=part)
            floor.fill(t)
            np.maximum(part, floor, out=now)
            now[guards] = _LOW
        # places that count
        alive, high = np.zeros((2, size), bool)
        for e, back in ((LOOK, 0), (LOOK - 1, 1)):  # a step along the diagonal passes over one of two
            np.minimum(down, right[back : back + size], out=part)
            part += table[e + 1]
            alive |= part >= e
        limits = np.full(size, 32_000, np.int16)
        for x, base in zip(own, bases):
            f, begin, n = x.first() - x.lo + base + 1, base + 1, x.hi + LOOK - x.lo + 1
            limits[begin : begin + n] = x.least - LOOK - 4  # up to the next look so much is added at most
            limits[max(begin, f + LOOK // 2 + LOOK // 4 + 1) : max(begin, f + LOOK // 2 + 2 * BAND - LOOK // 4)] = 32_000  # gaps from there beyond the band cost more than can be added
        for e in (LOOK, LOOK - 1):
            np.subtract(table[e + 1], e, out=part)
            high |= part >= limits
        for p in np.unique(np.searchsorted(guards, np.flatnonzero(high), "right") - 1).tolist():
            own[p].lost = True
        alive = np.flatnonzero(alive)
        spans = np.searchsorted(alive, np.append(guards, size)).tolist()
        going, places = [], []
        for k, (x, base) in enumerate(zip(own, bases)):
            f, lo, top = x.first(), x.lo, x.hi + LOOK
            r, s = max(f, lo), min(f + width, top + 1)
            kept = bands[x.slot, x.period]
            if s - r < width:
                kept.fill(_LOW)
            if r < s:
                np.add(table[2:, base + 1 + r - lo : base + 1 + s - lo], x.period * LOOK, out=kept[:, r - f : s - f])
            x.first_rows.append(f)
            x.period += 1
            done = x.lost or spans[k] == spans[k + 1]
            if not done:
                x.lo, x.hi = (lo + int(alive[y]) - base - 1 for y in (spans[k], spans[k + 1] - 1))
            if done:
                yield x
            else:
                going.append(x)
                places.append((base + 1 + x.lo - lo, base + 2 + x.hi - lo))
        own = going
        state = np.stack([table[-2], table[-1], lefts, up])
        state -= LOOK
        np.maximum(state, _LOW, out=state)
        size = sum(e - b + 2 * LOOK for b, e in places)


def _band_best(pairs: list[tuple[bytes, bytes]]) -> list[int]:
    """The best doubled score of a local alignment within BAND of the main diagonal, for pairs of like lengths beside each other."""
    a, b, n, m, kind = _coded(pairs, 4, 0)
    w, low = len(pairs), np.iinfo(kind).min // 2
    most = np.zeros((2 * BAND + 1) * w, kind)
    one, two, now, lefts, up, up2 = (np.full((n + 3) * w, low, kind)[w:] for _ in range(6))
    same, opened, floor = np.empty((3, (n + 1) * w), kind)
    four = np.full((n + 1) * w, 4, kind)
    for d in range(n + m + 1):
        lo, hi = max(0, d - m, (d - BAND) // 2), min(d, n, (d + BAND) // 2)
        if lo > hi:
            break
        x, y = max(1, lo), min(hi, d - 1)
        if x <= y:
            back, s, beyond = slice((x - 1) * w, y * w), slice(x * w, (y + 1) * w), slice((x - 1) * w, (y + 1) * w)
            part, gap = same[s], opened[beyond]
            np.bitwise_and(a[back], b[(m - d + x) * w : (m - d + y + 1) * w], out=part)
            np.minimum(part, four[s], out=part)
            np.add(part, two[back], out=part)
            np.subtract(one[beyond], 2, out=gap)
            np.maximum(lefts[s], gap[w:], out=lefts[s])
            np.maximum(up[back], gap[:-w], out=up2[s])
            up, up2 = up2, up
            up[(x - 1) * w : x * w] = low
            np.maximum(part, lefts[s], out=part)
            np.maximum(part, up[s], out=part)
            floor[s].fill(d)
            np.maximum(part, floor[s], out=now[s])
            np.subtract(now[s], d, out=part)
            np.maximum(most[: len(part)], part, out=most[: len(part)])
        now[(lo - 1) * w : lo * w] = low
        now[(hi + 1) * w : (hi + 2) * w] = low
        if not lo:
            now[:w] = d
        if hi == d:
            now[d * w : (d + 1) * w] = d
        one, two, now = now, one, two
    return most.reshape(-1, w).max(0).tolist()


#: Steps along the diagonal that are looked at together on the way back, and numbers that the bands of pairs may have together.
STEPS, BANDS = 8, 1 << 26


def _ways_back(done: list[_Bounded], bands: np.ndarray) -> dict[int, tuple]:
    """The rows of affine() by key, the ways back of all pairs taken together; none for those that leave their band."""
    done = [x for x in done if not x.lost]
    if not done:
        return {}
    width, ends, tops, floor = bands.shape[3], [], [], np.arange(1, LOOK + 1)[:, None]
    for x in done:
        own = bands[x.slot, : x.period]
        # after a look at less than this the score can't be reached before the next one
        near = own[:, -2:].max((1, 2)) >= x.least + LOOK * np.arange(1, x.period + 1) - LOOK - 4
        near[1:] |= near[:-1]
        found = []
        for p in np.flatnonzero(near).tolist():
            above = own[p] - (floor + p * LOOK)
            top = int(above.max())
            if not found or top >= found[0]:
                end = max((r + x.first_rows[p], p * LOOK + d - r - x.first_rows[p]) for d, r in np.argwhere(above == top).tolist())
                found = [top, max(end, found[1]) if found and top == found[0] else end]
        tops.append(found[0] if found else 0)
        ends.append(found[1] if found else (0, 0))
    before_of = lambda sizes: np.cumsum([0, *sizes[:-1]])
    first_at, row_at, col_at = (before_of([f(x) for x in done]) for f in (lambda x: x.period, lambda x: x.n, lambda x: x.m))
    table, table_at = bands.ravel(), np.array([x.slot for x in done]) * (bands.size // len(bands))
    first = np.concatenate([x.first_rows for x in done])
    a, b = (np.frombuffer(b"".join(x.pair[y] for x in done), np.uint8) for y in (0, 1))
    k = np.arange(len(done))
    row, col = (np.array([e[y] for e in ends]) for y in (0, 1))
    steps, scores = np.arange(STEPS), memoryview(table)
    own = table[table_at + (row + col) * width + row - first[first_at + (row + col) // LOOK]]
    equal, other = np.zeros((2, len(done)), np.int64)
    gaps, extends, before, lost = ([0] * len(done) for _ in range(4))
    firsts, tables_at = [x.first_rows for x in done], table_at.tolist()
    while len(k):
        d = (row + col)[:, None] - 2 - 2 * steps
        inner = row[:, None] - 1 - steps - first.take(first_at[k][:, None] + d // LOOK, mode="clip")
        beyond = table.take(table_at[k][:, None] + d * width + inner, mode="clip")
        beyond[(inner < 0) | (inner >= width)] = _LOW
        alike = a.take((row_at[k] + row - 1)[:, None] - steps, mode="clip") == b.take((col_at[k] + col - 1)[:, None] - steps, mode="clip")
        reached = beyond + 4 * alike
        good = np.zeros((len(k), STEPS + 1), bool)
        good[:, 0] = reached[:, 0] == own
        good[:, 1:-1] = reached[:, 1:] == beyond[:, :-1]
        run = np.minimum(good.argmin(1), np.minimum(row, col))
        same = (alike & (steps < run[:, None])).sum(1)
        equal[k] += same
        other[k] += run - same
        row, col = row - run, col - run
        moved = run > 0
        own = np.where(moved, beyond[np.arange(len(k)), run - 1], own)
        ended = (row == 0) | (col == 0)
        for x in np.flatnonzero(~ended & (run < STEPS)).tolist():
            p, i, j, mine = int(k[x]), int(row[x]), int(col[x]), int(own[x])
            # a gap leads here from a place with mine + 2, and where one does, none between has less than mine
            way, f, at = 0, firsts[p], tables_at[p]
            for to, limit in ((_LEFT, j), (_UP, i)):
                for c in range(1, limit + 1):
                    e = i + j - c
                    r = i - c * (to == _UP) - f[e // LOOK]
                    if not 0 <= r < width:
                        lost[p] = 1
                        break
                    value = scores[at + e * width + r]
                    if value == mine + 2:
                        way = to
                        break
                    if value < mine:
                        break
                if way or lost[p]:
                    break
            if not way or lost[p]:
                ended[x] = True
                continue
            i, j = i - (way == _UP), j - (way == _LEFT)
            row[x], col[x], own[x] = i, j, scores[at + (i + j) * width + i - f[(i + j) // LOOK]]
            gaps[p] += 1
            extends[p] += way == (0 if moved[x] else before[p])
            before[p] = way
            ended[x] = i == 0 or j == 0
        for x in np.flatnonzero(run == STEPS).tolist():
            before[k[x]] = 0
        if ended.any():
            kept = ~ended
            k, row, col, own = (x[kept] for x in (k, row, col, own))
    out = {}
    for p, x in enumerate(done):
        if not lost[p] and tops[p] >= x.least:
            e, o = int(equal[p]), int(other[p])
            out[x.key] = (tops[p] / 2, e + o + gaps[p], e, o, gaps[p], extends[p], *ends[p])
    return out


def _local_all(pairs: list[tuple[bytes, bytes]]) -> dict[int, tuple]:
    """affine() with its own costs for the pairs, by their number, that are made within bounds."""
    letters = sorted(set().union(*(x for p in pairs for x in p)))
    own = [i for i, (a, b) in enumerate(pairs) if min(len(a), len(b)) > 2 * LOOK and len(a) + len(b) <= LONGEST]
    if len(letters) > 12 or not own:
        return {}
    code = np.zeros(256, np.int16)
    code[letters] = [4 << k for k in range(len(letters))]
    starts = {i: _start(*pairs[i]) for i in own}
    cut = {}
    for i, (x, y) in starts.items():
        a, b = pairs[i][0][x:], pairs[i][1][y:]
        n = min(len(a), len(b)) + BAND
        cut[i] = a[:n], b[:n]
    groups: list[list[int]] = []
    for i in sorted(own, key=lambda i: sum(map(len, cut[i]))):
        if not groups or len(groups[-1]) * BAND >= NARROW or sum(map(len, cut[i])) > 1.2 * sum(map(len, cut[groups[-1][0]])) + 100:
            groups.append([])
        groups[-1].append(i)
    least: dict[int, int] = {}
    for group in groups:
        least |= zip(group, _band_best([cut[i] for i in group]))
    hashes = {x: _hashes(x) for x in {x for i in own for x in pairs[i]}}
    there, out = np.zeros(1 << 16, np.int8), {}
    own.sort(key=lambda i: -sum(map(len, pairs[i])))
    while own:
        longest = sum(map(len, pairs[own[0]]))
        alike = [i for i in own if 2 * sum(map(len, pairs[i])) > longest]
        own = own[len(alike) :]
        shape = longest // LOOK + 3, LOOK, 2 * BAND + 1 + LOOK // 2
        slots = min(len(alike), 256, BANDS // (shape[0] * shape[1] * shape[2]))
        bands, free, done = np.empty((slots, *shape), np.int16), list(range(slots)), []
        todo = (_Bounded(i, (a, b), code, starts[i], least[i], (_most_left(a, hashes[a], hashes[b], there), _most_left(b, hashes[b], hashes[a], there))) for i in alike for a, b in (pairs[i],))
        for x in _run(todo, bands, free):
            done.append(x)
            if len(done) > slots // 3:
                out |= _ways_back(done, bands)
                free += [x.slot for x in done]
                done = []
        out |= _ways_back(done, bands)
    return out


def affine_all(first: Iterable[str | None], second: Iterable[str | None], fitting: bool = False) -> list[tuple]:
    """affine(x, y, fitting=fitting) of all pairs."""
    pairs = [tuple((x or "").encode("latin-1", "replace") for x in p) for p in zip(first, second)]
    made = {} if fitting else _local_all(pairs)
    rest = [i for i in range(len(pairs)) if i not in made]
    groups = _side_by_side([pairs[i] for i in rest], True)
    table = np.empty(SIDE_TABLE if groups else 0, np.uint8)  # one for all: touching new memory takes long
    for group in groups:
        own = [rest[k] for k in group]
        made |= zip(own, _affine_together([pairs[i] for i in own], fitting, table) or [])
    return [made.get(i) or affine(a.decode("latin-1"), b.decode("latin-1"), fitting=fitting) for i, (a, b) in enumerate(pairs)]


def affine_span(s1: str | None, s2: str | None) -> tuple[int, int, int, int, int, int]:
    """(begin and end in s1, begin and end in s2, matches, length) of the local alignment; all 0 if there is none.

    The begins are the ends of the same alignment made backwards from its ends.
    """
    *_, end1, end2 = affine(s1, s2)
    if not end1:
        return 0, 0, 0, 0, 0, 0
    _, n, matches, *_, back1, back2 = affine(s1[:end1][::-1], s2[:end2][::-1])
    return end1 - back1, end1, end2 - back2, end2, matches, n


def lcs_table(a: np.ndarray, b: np.ndarray) -> _Rows:
    """The longest common subsequences of all prefixes, a row at a time: bit j - 1 of row i is 0 where the one of a[:i] and b[:j] is longer than that of a[:i] and b[:j - 1].

    A row is a whole number of len(b) bits, so a step of it is a few operations on
    long numbers.
    """
    letters, every = a.tolist(), (1 << len(b)) - 1
    at = {x: int.from_bytes(np.packbits(b == x, bitorder="little").tobytes(), "little") for x in np.unique(a).tolist()}
    size = len(b) // 7 + 64
    if (len(a) + 1) * size <= WHOLE:
        row, rows = every, [every]
        for i in range(0, len(letters), 16):
            for x in letters[i : i + 16]:  # bits that are carried beyond the last place change none before it
                new = row & at[x]
                row = (row + new) | (row - new)
                rows.append(row)
            row &= every
        return _Rows.of(rows)

    def step(state: tuple, i: int) -> tuple:
        (row,) = state
        new = row & at[letters[i - 1]]
        return (((row + new) | (row - new)) & every,)

    return _Rows(len(a), (every,), step, size=size)


def common_length(s1: str | None, s2: str | None) -> int:
    """Length of the longest common subsequence."""
    a, b = _bytes(s1), _bytes(s2)
    row = every = (1 << len(b)) - 1
    at = {x: int.from_bytes(np.packbits(b == x, bitorder="little").tobytes(), "little") for x in np.unique(a).tolist()}
    for x in a.tolist():
        new = row & at[x]
        row = ((row + new) | (row - new)) & every
    return len(b) - row.bit_count()


def common_subsequence(s1: str | None, s2: str | None) -> str:
    """Longest common subsequence; where several exist, the trace goes left, then up, then along the diagonal."""
    a, b = _bytes(s1), _bytes(s2)
    t = lcs_table(a, b)
    i, j, out = len(a), len(b), bytearray()
    while i and j:
        own, above = t.two(i)
        if own >> (j - 1) & 1:
            j -= 1
        elif not above >> (j - 1) & 1:  # a step of the row above at the same place is the same one
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(a[i])
    return bytes(reversed(out)).decode("latin-1")


def common_supersequence(s1: str | None, s2: str | None) -> str:
    """Shortest common supersequence, of length n + m - LCS."""
    a, b = _bytes(s1), _bytes(s2)
    t = lcs_table(a, b)
    i, j, out = len(a), len(b), bytearray()
    while i or j:
        own, above = t.two(i)
        if not i or (j and own >> (j - 1) & 1):
            j -= 1
            out.append(b[j])
        elif not j or not above >> (j - 1) & 1:
            i -= 1
            out.append(a[i])
        else:
            i, j = i - 1, j - 1
            out.append(a[i])
    return bytes(reversed(out)).decode("latin-1")


def _eights(x: np.ndarray) -> np.ndarray:
    """The eight letters from each place on as one number."""
    x = x.astype(np.uint64)
    for n in (1, 2, 4):
        x = (x[:-n] << np.uint64(8 * n)) | x[n:]
    return x


def common_substring(s1: str | None, s2: str | None) -> str:
    """Longest common substring, the first in s1 among equals."""
    a, b = _bytes(s1), _bytes(s2)
    if min(len(a), len(b)) >= 8:
        x, y = _eights(a), _eights(b)
        order = np.argsort(y, kind="stable")
        begins, ends = (np.searchsorted(y[order], x, side) for side in ("left", "right"))
        n = ends - begins
        if 0 < (hits := int(n.sum())) <= 16 * (len(a) + len(b)):  # else the rows below take less
            i = np.repeat(np.arange(len(x)), n)
            j = order[np.repeat(begins - np.cumsum(n) + n, n) + np.arange(hits)]
            places = np.sort((j - i + len(a)) * (len(a) + 1) + i)  # those that follow each other belong to one stretch
            first = np.flatnonzero(np.r_[True, np.diff(places) != 1])
            lengths = np.diff(np.r_[first, hits])
            begin = int((places[first[lengths == lengths.max()]] % (len(a) + 1)).min())
            return (s1 or "")[begin : begin + int(lengths.max()) + 7]
    row, best, end = np.zeros(len(b) + 1, np.int32), 0, 0
    for i in range(len(a)):
        now = np.zeros_like(row)
        now[1:] = np.where(b == a[i], row[:-1] + 1, 0)
        if len(b) and int(now.max()) > best:
            best, end = int(now.max()), i + 1
        row = now
    return (s1 or "")[end - best : end]


def anchored_score(s1: str | None, s2: str | None) -> int:
    """Local score (+1, -1, -1) of alignments that end at the end of s1; 0 if s2 is outside 0.8 to 1.4 times its length."""
    a, b = _bytes(s1), _bytes(s2)
    if not len(a) or len(b) < 0.8 * len(a) or len(b) > 1.4 * len(a):
        return 0
    places = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        now = np.zeros_like(row)
        now[1:] = np.maximum(0, np.maximum(row[:-1] + np.where(b == x, 1, -1), row[1:] - 1))
        row = np.maximum.accumulate(now + places) - places  # gaps to the left cost 1 a place
    return int(row.max())


def _anchored_together(pairs: list[tuple[bytes, bytes]]) -> list[int] | None:
    """anchored_score() for pairs of like lengths, a diagonal of all of them at a time; i + j is added to the score of the place (i, j)."""
    if (coded := _coded(pairs, 2, 1)) is None:
        return None
    a, b, n, m, kind = coded
    w = len(pairs)
    one, two, now, part, floor = np.zeros((5, (n + 1) * w), kind)
    three = np.full((n + 1) * w, 3, kind)
    ns, ms = (np.array([len(p[x]) for p in pairs]) for x in (0, 1))
    ends, top = ns * w + np.arange(w), np.zeros(w, np.int64)
    for d in range(n + m + 1):
        x, y = max(1, d - m), min(n, d - 1)
        if x <= y:
            back, s = slice((x - 1) * w, y * w), slice(x * w, (y + 1) * w)
            own = part[s]
            np.bitwise_and(a[back], b[(m - d + x) * w : (m - d + y + 1) * w], out=own)
            np.minimum(own, three[s], out=own)
            own += two[back]
            np.maximum(own, one[s], out=own)
            np.maximum(own, one[back], out=own)
            floor[s].fill(d)
            np.maximum(own, floor[s], out=now[s])
        if d <= m:
            now[:w] = d
        if d <= n:
            now[d * w : (d + 1) * w] = d
        np.maximum(top, np.where((d > ns) & (d <= ns + ms), now[ends].astype(np.int64) - d, 0), out=top)
        one, two, now = now, one, two
    return top.tolist()


def anchored_all(first: Iterable[str | None], second: Iterable[str | None]) -> list[int]:
    """anchored_score() of all pairs."""
    pairs = [tuple((x or "").encode("latin-1", "replace") for x in p) for p in zip(first, second)]
    out = [0] * len(pairs)
    kept = [i for i, (a, b) in enumerate(pairs) if a and 0.8 * len(a) <= len(b) <= 1.4 * len(a)]
    for group in _side_by_side([pairs[i] for i in kept]):
        own = [kept[k] for k in group]
        scores = _anchored_together([pairs[i] for i in own]) or [anchored_score(*(x.decode("latin-1") for x in pairs[i])) for i in own]
        for i, x in zip(own, scores):
            out[i] = x
    return out


def gapped_rows(s1: str, s2: str) -> tuple[str, str]:
    """Global alignment with matches (+1) and gaps (-1) only: both rows with '-'."""
    left, right = (x.encode("latin-1", "replace") for x in (s1, s2))
    t = lcs_table(_bytes(s1), _bytes(s2))  # without mismatches the best alignment has most matches
    i, j, x, y = len(left), len(right), bytearray(), bytearray()
    row = t.rows.__getitem__ if len(t.rows) > i else t.one
    while i and j:
        if (c := left[i - 1]) == right[j - 1]:  # equal bases are always part of a best alignment
            i -= 1
            j -= 1
            x.append(c)
            y.append(c)
        elif (bits := row(i)) >> (j - 1) & 1:
            n = (~bits & ((1 << j) - 1)).bit_length()  # the bases from there on leave the length as it is
            up = right.rfind(c, n, j) + 1 or n  # but equal ones come first
            x += b"-" * (j - up)
            y += right[up:j][::-1]
            j = up
        else:
            i -= 1
            x.append(c)
            y.append(45)
    x, y = (z[::-1].decode("latin-1") for z in (x, y))
    return s1[:i] + "-" * j + x, "-" * i + s2[:j] + y


def aligned_places(s1: str, s2: str, beg: int, end: int) -> tuple[int, int, int, int]:
    """(begin and end in s2, begin and end in s1) of the columns of gapped_rows() between two places of s1, without the rows themselves."""
    left, right = (x.encode("latin-1", "replace") for x in (s1, s2))
    t = lcs_table(_bytes(s1), _bytes(s2))
    i, j, found = len(left), len(right), []
    row = t.rows.__getitem__ if len(t.rows) > i else t.one
    for place in (max(beg, end), beg):
        if place > len(left):
            found.append((len(right), len(left)))
            continue
        if place <= 0:
            found.append((0, 0))
            continue
        while j and i >= place:  # the same way back as in gapped_rows()
            while j and i > place and left[i - 1] == right[j - 1]:
                i -= 1
                j -= 1
            if not j or left[i - 1] == right[j - 1]:
                break
            if (bits := row(i)) >> (j - 1) & 1:
                n = (~bits & ((1 << j) - 1)).bit_length()
                j = right.rfind(left[i - 1], n, j) + 1 or n
            elif i > place:
                i -= 1
            else:
                break
        found.append((j, place))
    (read_end, to), (read_beg, at) = found
    return read_beg, read_end, at, to


def progressive_consensus(seqs: list[str]) -> str:
    """Consensus of sequences aligned one after another to a growing master.

    A column stays if at least as many rows have a base as a gap; its base is that of
    the last row that has one. '' for no sequence.
    """
    if not seqs:
        return ""
    bases, gaps, last = np.ones(len(seqs[0]), int), np.zeros(len(seqs[0]), int), list(seqs[0])
    for n, seq in enumerate(seqs[1:], 1):
        old, new = gapped_rows("".join(last), seq)
        at, counts = 0, []
        for o, s in zip(old, new):
            if o == "-":
                counts.append((1, n, s))
            else:
                counts.append((bases[at] + (s != "-"), gaps[at] + (s == "-"), s if s != "-" else last[at]))
                at += 1
        bases, gaps, last = np.array([c[0] for c in counts]), np.array([c[1] for c in counts]), [c[2] for c in counts]
    return "".join(c for c, b, g in zip(last, bases, gaps) if b >= g)


def sample_of_four(a: str, b: str, c: str, d: str) -> str:
    return common_subsequence(common_supersequence(a, b), common_supersequence(c, d))


def sample_of_three(a: str, b: str, c: str) -> str:
    ab, bc, ca = common_supersequence(a, b), common_supersequence(b, c), common_supersequence(c, a)
    return common_subsequence(common_subsequence(ab, bc), ca)


def _draws(seed: int):
    """Whole numbers below n, from a multiplicative hash of seed and count."""
    count = 0

    def below(n: int) -> int:
        nonlocal count
        count += 1
        x = ((seed * 0x9E3779B97F4A7C15) ^ (count * 0xBF58476D1CE4E5B9)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 31)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        return (x >> 20) % n

    return below


def consensus_tree(reads: list[str], seed: int = 1129, shortest: int = 450, longest: int = 550, most: int = 99, groups: int = 4, branching: int = 4) -> tuple[str | None, int, bool]:
    """(consensus, reads that support it, accepted) of the reads of one neighbourhood.

    Reads strictly between the lengths are used, at most `most`, and more than three
    are needed. A seed is made of the triple that scores best against one of its
    reads; reads that score above 300 against it support it, and again more than three
    are needed. Samples of four supporting reads are joined four at a time in a tree.
    The result is accepted if each of the four sub-consensuses scores above 0.9 of its length.
    """
    own = [r for r in reads if shortest < len(r) < longest][:most]
    if len(own) <= 3:
        return None, 0, False
    below = _draws(seed)

    def others(n: int, of: list[int], than: tuple[int, ...] = ()) -> list[int]:
        rest = [x for x in of if x not in than]
        return [rest.pop(below(len(rest))) for _ in range(n)]

    everyone = list(range(len(own)))
    best, triple = 0, None
    for i in everyone:
        j, k = others(2, everyone, (i,))
        score = anchored_score(own[i], own[j])
        if score > 150:
            score += anchored_score(own[i], own[k])
        if score > best:
            best, triple = score, (i, j, k)
    if triple is None:
        return None, 0, False
    core = sample_of_three(*(own[x] for x in triple))
    support = [i for i in everyone if anchored_score(core, own[i]) > 300]
    if len(support) <= 3:
        return None, len(support), False

    def level(n: int) -> str:
        if n == 0:
            return sample_of_four(*(own[x] for x in others(4, support)))
        return sample_of_four(*(level(n - 1) for _ in range(branching)))

    subs = [level(2 if groups == 4 else 1) for _ in range(4)]
    out = sample_of_four(*subs)
    return out, len(support), all(anchored_score(out, s) > 0.9 * len(out) for s in subs)


def _pairwise(f: Callable, returns: T.DataType):
    @pandas_udf(returns)
    def own(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b)])

    return own


lcs = _pairwise(common_subsequence, T.StringType())
scs = _pairwise(common_supersequence, T.StringType())
longest_substring = _pairwise(common_substring, T.StringType())
lcs_length = _pairwise(common_length, T.IntegerType())


@pandas_udf(T.IntegerType())
def linear_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(anchored_all(a, b))



def alignment(fitting: bool = False, match: float = 1.0, mismatch: float = -1.0, opening: float = -1.0, extending: float = -0.5):
    """A column function (seq1, seq2) -> struct of ALIGNMENT."""
    @pandas_udf(ALIGNMENT)
    def own(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        if (match, mismatch, opening, extending) == (1, -1, -1, -0.5):
            rows = affine_all(a, b, fitting)
        else:
            rows = [affine(x, y, match, mismatch, opening, extending, fitting) for x, y in zip(a, b)]
        return pd.DataFrame(rows, columns=ALIGNMENT.names)

    return own
