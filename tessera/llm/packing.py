"""Filling fixed-capacity containers with items of many lengths.

Only the histogram of lengths is planned, at most ``capacity`` numbers whatever the number of items. Patterns
that fill a container are enumerated, every length leading some; non-negative least squares fits how often to
use each so that the histogram is met; what the fit leaves makes further patterns. The repeats are rounded, down
first and then up where the counts allow it, and the rest is fitted again; what remains is packed largest first, a pattern and as many repeats
of it as the counts allow at a time. Items then find their container from their
rank within their length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import ranked

#: Fits at most, each on what the rounding of the one before left.
_PASSES = 8

Plan = list[tuple[dict[int, int], int]]


class _Fill:
    """Fills containers from a histogram: lengths ascending and how many of each may be used."""

    def __init__(self, left: dict[int, int]):
        self.lengths = np.array(sorted(n for n, c in left.items() if c > 0), np.int64)
        self.left, self.top = left, self.lengths.tolist()

    def below(self, room: int) -> int:
        """How many of the lengths are at most ``room``."""
        return bisect_right(self.top, room)

    def from_(self, leader: int, k: int, start: int, capacity: int) -> dict[int, int]:
        """``k`` of the leader, then downwards from the place ``start`` as many as there are and fit, closed by an exact rest as soon as there is one."""
        pattern, room, at = {leader: k}, capacity - k * leader, start
        while room:
            i = self.below(room)
            if not i:
                break
            n = self.top[i - 1]
            if n != room or self.left[n] <= pattern.get(n, 0):
                at = min(at, i) - 1
                if at < 0:
                    break
                n = self.top[at]
            times = min(room // n, self.left[n] - pattern.get(n, 0))
            if n == room:
                times = min(times, 1)
            if times > 0:
                pattern[n] = pattern.get(n, 0) + times
                room -= times * n
        return pattern


def patterns(left: dict[int, int], capacity: int, least_fill: float) -> list[dict[int, int]]:
    """Fillings of a container, at least ``least_fill`` full and with no more of a length than there are.

    Every length leads patterns: one of it and the longest that fit; one and those near half the room left; and as many as there
    are with its shorter neighbours. So their number is at most three a length.
    """
    fill, out = _Fill(left), {}
    for i, a in enumerate(fill.top):
        room = capacity - a
        for k, start in ((1, fill.below(min(room, a))), (1, fill.below(room // 2)), (min(left[a], capacity // a), i)):
            pattern = fill.from_(a, k, start, capacity)
            if sum(n * c for n, c in pattern.items()) >= least_fill * capacity:
                out.setdefault(tuple(sorted(pattern.items())), pattern)
    return list(out.values())


class _Columns:
    """Patterns as the columns of a sparse matrix, rows being lengths; each row is scaled by its weight."""

    def __init__(self, tried: list[dict[int, int]], at: dict[int, int], weight: np.ndarray):
        self.row = np.array([at[n] for p in tried for n in p], np.int64)
        self.col = np.repeat(np.arange(len(tried)), [len(p) for p in tried])
        self.value = np.array([k for p in tried for k in p.values()], np.float64) * weight[self.row]
        self.rows, self.cols = len(at), len(tried)

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * x[self.col], self.rows)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * r[self.row], self.cols)


def least_squares(a, h: np.ndarray, x: np.ndarray | None = None, tolerance: float = 1e-3, steps: int = 20_000) -> np.ndarray:
    """x >= 0 that minimises |a x - h|, by accelerated projected gradient steps with restarts, until a step of the gradient would gain no more than ``tolerance`` of |h|.

    ``a`` has times(x) and back(r). Scaling the columns to one length makes the steps even.
    """
    squares = np.bincount(a.col, a.value**2, a.cols)
    scale = 1 / np.sqrt(np.maximum(squares, 1e-12))
    v = np.ones(a.cols)
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = scale * a.back(a.times(scale * v))
        v /= max(np.linalg.norm(v), 1e-12)
    bound = float(np.linalg.norm(scale * a.back(a.times(scale * v)))) * 1.05 + 1e-12
    x = y = np.zeros(a.cols) if x is None else x / scale
    t, size = 1.0, float(np.linalg.norm(h)) + 1e-12
    for step in range(steps):
        g = scale * a.back(a.times(scale * y) - h)
        new = np.maximum(0.0, y - g / bound)
        if step % 50 == 49:
            free = np.where(new > 0, scale * a.back(a.times(scale * new) - h), np.minimum(0.0, scale * a.back(a.times(scale * new) - h)))
            if np.linalg.norm(free) <= tolerance * size:
                x = new
                break
        if (y - new) @ (new - x) > 0:
            t = 1.0  # momentum points uphill
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = np.maximum(0.0, new + (t - 1) / t_new * (new - x))
        x, t = new, t_new
    return x * scale


def fitted(left: dict[int, int], capacity: int, rounds: int = 8, good: float = 0.02) -> tuple[list[dict[int, int]], np.ndarray, float]:
    """(patterns, how often to use each, norm of what they leave of the histogram over its norm).

    What a fit leaves uncovered makes the next round's patterns, of the least fill one step lower, until little is left.
    """
    lengths = sorted(n for n, c in left.items() if c > 0)
    at = {n: i for i, n in enumerate(lengths)}
    weight = np.sqrt(np.array(lengths, np.float64))  # an unplaced long item leaves more to pack than a short one
    h = np.array([left[n] for n in lengths], np.float64)
    tried: dict[tuple, dict[int, int]] = {}
    x, norm, rest = np.zeros(0), 1.0, dict(left)
    for r in range(rounds):
        for p in patterns(rest, capacity, 1.0 - 0.002 * r):
            tried.setdefault(tuple(sorted(p.items())), p)
        if not tried:
            continue
        a = _Columns(list(tried.values()), at, weight)
        x = least_squares(a, h * weight, np.append(x, np.zeros(a.cols - len(x))))
        over = h - a.times(x) / weight
        norm = float(np.linalg.norm(over * weight) / np.linalg.norm(h * weight))
        rest = {n: int(np.ceil(over[i])) for n, i in at.items() if over[i] > 0.02 * h[i] + 1e-6}
        if norm <= good or not rest:
            break
    return list(tried.values()), x, norm


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """(pattern, repeats): pattern gives how many items of each length a container takes; every item is placed."""
    return planned(counts, capacity)[0]


def planned(counts: dict[int, int], capacity: int) -> tuple[Plan, int, float]:
    """The plan, how many items its fitted patterns place, and the first fit's residual."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    out: Plan = []
    placed, norm, passes = 0, 0.0, 0
    while any(left.values()) and passes < _PASSES:
        tried, x, residual = fitted(left, capacity)
        norm, passes, before = norm or residual, passes + 1, placed
        order = np.argsort(-x, kind="stable")
        for up in (False, True):  # whole repeats first, then those that a fraction asks for and the counts still allow
            for j in order[x[order] > 1e-3].tolist():
                times = min([1 if up else int(x[j] + 1e-6), *(left[n] // k for n, k in tried[j].items())])
                if times < 1:
                    continue
                out.append((tried[j], times))
                for n, k in tried[j].items():
                    left[n] -= k * times
                    placed += k * times
        if placed == before:
            break
    fill = _Fill(left)
    while len(fill.top):
        pattern: dict[int, int] = {}
        room, i = capacity, len(fill.top)
        while i and room:
            i = min(i, fill.below(room))
            if not i:
                break
            n = fill.top[i - 1]
            k = min(room // n, left[n])
            pattern[n] = k
            room -= k * n
            i -= 1
        times = min(left[n] // k for n, k in pattern.items())
        out.append((pattern, times))
        for n, k in pattern.items():
            left[n] -= k * times
        fill.top = [n for n in fill.top if left[n] > 0]
    return out, placed, norm


def packed(lengths: DataFrame, capacity: int) -> DataFrame:
    """(container, id, piece, start, n_tokens): every item's place.

    ``lengths``: id, n_tokens BIGINT. An item over ``capacity`` is split into full containers and a rest; no
    other item is split. Items of 0 or null tokens take no place. An id that occurs twice is packed twice.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    c = F.lit(capacity).cast("long")
    pieces = lengths.filter("n_tokens > 0").select("id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_tokens - 1) div {int(capacity)}"))).alias("piece"))
    pieces = pieces.select("id", "piece", (F.col("piece") * c).alias("start"), F.least(c, F.col("n_tokens") - F.col("piece") * c).alias("size"))
    items = ranked(pieces, "size", "pieces")
    counts = {int(r[0]): int(r[1]) for r in items.groupBy("size").count().collect()}  # at most capacity rows
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for pattern, times in plan(counts, capacity):
        for n, k in pattern.items():
            slots.setdefault(n, []).append((taken.get(n, 0), base, k))
            taken[n] = taken.get(n, 0) + k * times
        base += times
    tables = {n: tuple(np.array(column, np.int64) for column in zip(*rows)) for n, rows in slots.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            container = np.empty(len(size), np.int64)
            for n in np.unique(size):
                begin, first, k = tables[int(n)]
                here = np.flatnonzero(size == n)
                i = np.searchsorted(begin, rank[here], "right") - 1
                container[here] = first[i] + (rank[here] - begin[i]) // k[i]
            yield pa.RecordBatch.from_arrays([pa.array(container), *(batch.column(x) for x in ("id", "piece", "start", "size"))], names=["container", "id", "piece", "start", "n_tokens"])

    return items.mapInArrow(assign, f"container bigint, id {dict(lengths.dtypes)['id']}, piece bigint, start bigint, n_tokens bigint")
