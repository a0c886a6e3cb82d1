"""Searches in any Minkowski space and any dimension by pivots: exact neighbours and range joins.

Points are dealt to the Voronoi cells of sampled pivots and to rings about them. How far a
cell's points are from every pivot, and a ring's from its own, is known by two numbers each;
with the triangle inequality a query rules out what cannot hold an answer. Rings are put together
to blocks; a query goes once to each block with rings that are left, and a task holds one block while the
queries of its share stream by. What the driver and every task hold of the index is bounded by
``PIVOTS``, ``RINGS`` and ``BLOCK``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.frames import discard, stored

#: Most pivots, rings of a cell, points and queries that are held against each other at once, and queries that a task gathers before it sends them.
PIVOTS, RINGS, PACK, ASKED, GATHERED = 256, 32, 2048, 256, 8192
#: Bytes of the points of a block, of the vectors in one row of a table, and of the rows that a task sends on at once.
BLOCK, ROW, SENT = 2**23, 2**13, 2**23
#: Tasks of a search among many points, and fewest points for each.
TASKS, SHARE = 64, 512
#: Rows and columns of a matrix of distances that are worked out together, coordinate by coordinate.
TILE = 64, 2048
#: Pairs whose exact distances are worked out at once.
TOGETHER = 20_000
#: Share of a distance that rounding may take.
ROUNDING = 1e-9
#: With u = wt, no gap t is less than ``STEEP`` / w * (1 - cos u + ``THIRD`` * (1 - cos 3u)); of normal gaps that is nine tenths.
STEEP, THIRD = 1.28, 0.155
#: Largest share of the pairs that a bound by waves may leave; with more, all are worked out.
SIFTED = 1 / 4


def far(a: np.ndarray, b: np.ndarray, p: float) -> tuple[np.ndarray, float]:
    """Distances of all rows of ``a`` from all of ``b``, and what they may be off by."""
    if p == 2:
        na, nb = (a * a).sum(1), (b * b).sum(1)
        d = na[:, None] + nb - 2 * (a @ b.T)
        most = math.sqrt(max(na.max(initial=0), nb.max(initial=0)))
        return np.sqrt(np.maximum(d, 0)), 1e-6 * most
    if p == 1 or math.isinf(p):
        out = by_coordinate(a, b, p, np.float64)
    else:
        out = np.empty((len(a), len(b)))
        for j, y in enumerate(b):
            out[:, j] = exact(a, y, p)
    return out, ROUNDING * out.max(initial=0)


def near(a: np.ndarray, b: np.ndarray, p: float) -> tuple[np.ndarray, float]:
    """As ``far``, in few bits where that is faster: whole numbers exactly, others in single precision; what they may be off by is then more."""
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if (p != 1 and not math.isinf(p)) or not most < 1e30:
        return far(a, b, p)
    dims = a.shape[1]
    kind = whole(a, b, dims if p == 1 else 1)
    if kind is not None:
        return by_coordinate(a, b, p, kind), 0.0
    return by_coordinate(a, b, p, np.float32), 2.0**-23 * most * (4 if math.isinf(p) else dims * (2 + dims))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Squared Euclidean distances of all rows of ``a`` from all of ``b``, exact, as one product in single precision; None if that cannot hold them."""
    most, dims = max(np.abs(x).max(initial=0) for x in (a, b)), a.shape[1]
    if not 4 * dims * most * most < 2**24 or any((x != np.floor(x)).any() for x in (a, b)):
        return None
    left, right = np.ones((len(a), dims + 2), np.float32), np.ones((len(b), dims + 2), np.float32)
    left[:, :dims], left[:, dims] = -2 * a, (a * a).sum(1)
    right[:, :dims], right[:, dims + 1] = b, (b * b).sum(1)
    return left @ right.T


@dataclass
class Waves:
    """Lower bounds of sums of gaps (p = 1) by one product in single precision, of four values a coordinate."""

    w: float
    dims: int

    @classmethod
    def fitted(cls, a: np.ndarray, b: np.ndarray) -> Waves | None:
        """With the frequency that bounds gaps of some rows of ``a`` from some of ``b`` best; any is right. None if there are no gaps, or angles would be rounded."""
        some = [x[:: -(-len(x) // 64) or 1] for x in (a, b)]
        gaps = np.abs(some[0][:, None] - some[1]).ravel()
        mean = gaps.mean() if gaps.size else 0.0
        if not 0 < mean < math.inf:
            return None
        gaps = gaps[:: -(-len(gaps) // 2**14)]
        tried = [cls(float(w), a.shape[1]) for w in np.geomspace(0.5, 2, 13) / mean]
        return max(tried, key=lambda t: t.least(gaps).sum())

    def least(self, gaps: np.ndarray) -> np.ndarray:
        return STEEP / self.w * (1 - np.cos(self.w * gaps) + THIRD * (1 - np.cos(3 * self.w * gaps)))

    def of(self, rows: np.ndarray) -> np.ndarray | None:
        """Values of rows, whose product is ``most`` less the bound; None if angles would be rounded."""
        if not np.abs(rows).max(initial=0) * self.w < 1e6:
            return None
        c, s = np.cos(self.w * rows), np.sin(self.w * rows)
        return (np.concatenate([c, s, math.sqrt(THIRD) * c * (4 * c * c - 3), math.sqrt(THIRD) * s * (3 - 4 * s * s)], axis=1) * math.sqrt(STEEP / self.w)).astype(np.float32)

    def floor(self, bounds: np.ndarray) -> np.ndarray:
        """What the product is at least for pairs within the bounds."""
        most = self.dims * STEEP / self.w * (1 + THIRD)
        return (most - bounds - most * (4 * self.dims + 16) * 2.0**-23).astype(np.float32)


def whole(a: np.ndarray, b: np.ndarray, gaps: int) -> type | None:
    """The least type that holds the values and so many gaps together, if all are whole numbers and one of one or two bytes does."""
    ends = [f for x in (a, b) if x.size for f in (x.min(), x.max())]
    span = max(ends, default=0) - min(ends, default=0)
    most = max(span * gaps, *map(abs, ends), 0) if ends else 0
    kind = next((k for k in (np.int8, np.int16) if most <= np.iinfo(k).max), None)
    return kind if kind is not None and all((x == x.astype(kind)).all() for x in (a, b)) else None


def within(d: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which distances are at most the bound of their row, compared in their own type."""
    if d.dtype.kind == "i":
        bounds = np.floor(np.clip(bounds, -1, np.iinfo(d.dtype).max)).astype(d.dtype)
    return d <= bounds[:, None]


def by_coordinate(a: np.ndarray, b: np.ndarray, p: float, kind: type) -> np.ndarray:
    """Sums (p = 1) or greatest of the gaps of all rows of ``a`` from all of ``b``."""
    out, (high, wide) = np.zeros((len(a), len(b)), kind), TILE
    columns, rows = np.ascontiguousarray(a.T, kind), np.ascontiguousarray(b.T, kind)
    add, gaps = np.add if p == 1 else np.maximum, np.empty((high, wide), kind)
    for i in range(0, len(a), high):
        for j in range(0, len(b), wide):
            held = out[i : i + high, j : j + wide]
            gap = gaps[: held.shape[0], : held.shape[1]]
            for x, y in zip(columns[:, i : i + high], rows[:, j : j + wide], strict=True):
                np.abs(np.subtract(x[:, None], y, out=gap), out=gap)
                add(held, gap, out=held)
    return out


def exact(a: np.ndarray, y: np.ndarray, p: float) -> np.ndarray:
    """Distances of the rows of ``a`` from one point or from as many."""
    gap = np.abs(a - y)
    if math.isinf(p):
        return gap.max(axis=1, initial=0)
    return (gap**p).sum(axis=1) ** (1 / p)


def of_pairs(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sums of the gaps (p = 1) of the rows ``i`` of ``x`` from the rows ``j`` of ``y``; gaps of whole numbers fit their type (see ``whole``)."""
    out, ones = np.empty(len(i)), np.ones(x.shape[1], np.float32 if x.dtype.kind == "i" else np.float64)
    for n in range(0, len(i), TOGETHER):
        gap = x.take(i[n : n + TOGETHER], 0)
        np.abs(np.subtract(gap, y.take(j[n : n + TOGETHER], 0), out=gap), out=gap)
        out[n : n + TOGETHER] = gap.astype(np.float32) @ ones if gap.dtype.kind == "i" else gap.sum(1)
    return out


def marked(close: np.ndarray) -> np.ndarray:
    """Numbers of the true values of a contiguous matrix with few of them, which is looked through eight values at a time."""
    flat = close.ravel()
    eights = np.flatnonzero(flat[: len(flat) // 8 * 8].view(np.uint64))
    at = (8 * eights[:, None] + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], len(flat) // 8 * 8 + np.flatnonzero(flat[len(flat) // 8 * 8 :])])


def packed(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows).tobytes()


def narrowed(rows: np.ndarray) -> bytes:
    """Rows in one or two bytes a value if they are whole numbers that fit, else as they are."""
    kind = whole(rows, rows[:0], 1)
    return packed(rows if kind is None else rows.astype(kind))


def widened(data: bytes, values: int) -> np.ndarray:
    """What ``narrowed`` packed, so many values."""
    return np.frombuffer(data, {1: np.int8, 2: np.int16, 8: np.float64}[len(data) // values if values else 8]).astype(float)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


@dataclass
class Shape:
    """What queries know of the points: pivots, by how much rings differ, and what lies how far from what."""

    p: float
    pivots: np.ndarray
    #: First number of each ring (neighbouring ones of few points are one), cell, count, least and greatest distance from the pivot, blocks.
    keys: np.ndarray
    cell: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray
    blocks: np.ndarray
    #: Least and greatest distance of a cell's points from each pivot.
    cell_low: np.ndarray
    cell_high: np.ndarray
    #: Block of each part of each ring, first part of each ring, first and last ring of each block.
    block: np.ndarray
    first: np.ndarray
    spans: list[tuple[int, int]]
    #: Shares that the queries of a block are dealt over.
    shares: int

    def least(self, d: np.ndarray, off: float) -> np.ndarray:
        """Least distance that a point of each ring can have from each query, of distances ``d`` from the pivots."""
        cells = np.empty((len(d), len(self.pivots)))
        for held, row in zip(cells, d, strict=True):
            np.maximum((row - self.cell_high).max(1), (self.cell_low - row).max(1), out=held)
        own = d[:, self.cell]
        rings = np.maximum(cells[:, self.cell], np.maximum(own - self.high, self.low - own))
        return np.maximum(rings * (1 - ROUNDING) - 2 * off, 0)

    def nearest(self, d: np.ndarray, ks: np.ndarray) -> np.ndarray:
        """Which rings hold k points that are likely near (up to a pack of each cell, for a closer bound): those of the query's own cell by their distance from it, then of the next."""
        chosen = np.zeros((len(d), len(self.cell)), bool)
        ends = np.searchsorted(self.cell, np.arange(len(self.pivots) + 1))
        for i, k in enumerate(ks.tolist()):
            home = d[i].argmin()
            for c in [home] if self.count[ends[home] : ends[home + 1]].sum() >= k else np.argsort(d[i]):
                mine = np.arange(ends[c], ends[c + 1])
                mine = mine[np.argsort(np.maximum(d[i, c] - self.high[mine], self.low[mine] - d[i, c]), kind="stable")]
                upto = np.cumsum(self.count[mine])
                chosen[i, mine[: int(np.searchsorted(upto, max(k, PACK))) + 1]] = True
                k -= int(upto[-1]) if len(upto) else 0
                if k <= 0:
                    break
        return chosen


#: A row is a point in its ring, or (without x) what a task found out about a ring or, with lists, a cell.
DEALT = "k long, point_id long, h long, x binary, n long, low double, high double, lows array<double>, highs array<double>"


def _dealt(pivots: np.ndarray, p: float, width: float):
    """Points with their rings; at the end of a task, counts and ends of its rings, and its cells' least and greatest distances from all pivots."""
    m = len(pivots)
    kinds = pa.schema(
        [("k", pa.int64()), ("point_id", pa.int64()), ("h", pa.int64()), ("x", pa.binary()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("lows", pa.list_(pa.float64())), ("highs", pa.list_(pa.float64()))]
    )

    def rows(size: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(size, f.type) for f in kinds], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, low, high = np.zeros(m * RINGS, np.int64), np.full(m * RINGS, np.inf), np.zeros(m * RINGS)
        cell_low, cell_high = np.full((m, m), np.inf), np.zeros((m, m))
        for batch in batches:
            x = matrix(batch.column("p"))
            if not len(x):
                continue
            d, off = far(x, pivots, p)
            home = d.argmin(1)
            own = d[np.arange(len(d)), home]
            ring = home * RINGS + np.minimum(own / width, RINGS - 1).astype(np.int64)
            np.add.at(count, ring, 1)
            np.minimum.at(low, ring, own - off)
            np.maximum.at(high, ring, own + off)
            for c in np.unique(home):
                mine = d[home == c]
                cell_low[c] = np.minimum(cell_low[c], mine.min(0) - off)
                cell_high[c] = np.maximum(cell_high[c], mine.max(0) + off)
            yield rows(len(x), k=pa.array(ring), point_id=batch.column("point_id"), h=batch.column("h"), x=pa.array([packed(r) for r in x], pa.binary()))
        rings = np.flatnonzero(count)
        cells = np.unique(rings // RINGS)
        yield rows(len(rings), k=pa.array(rings), n=pa.array(count[rings]), low=pa.array(low[rings]), high=pa.array(high[rings]))
        lists = [pa.array(e[cells].tolist(), pa.list_(pa.float64())) for e in (cell_low, cell_high)]
        yield rows(len(cells), k=pa.array(cells), lows=lists[0], highs=lists[1])

    return run


def merged(rings: list[tuple[int, int, float, float]]) -> list[tuple[int, int, float, float]]:
    """Rings (number, count, low, high), with neighbours of one cell put together until they fill half a pack."""
    out: list[tuple[int, int, float, float]] = []
    for k, n, low, high in rings:
        if out and out[-1][0] // RINGS == k // RINGS and out[-1][1] + n <= PACK // 2:
            out[-1] = out[-1][0], out[-1][1] + n, min(out[-1][2], low), max(out[-1][3], high)
        else:
            out.append((k, n, low, high))
    return out


def blocked(count: np.ndarray, parts: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], int]:
    """Blocks of rings of ``count`` points in so many parts, as ``Shape`` has them: of ``BLOCK`` bytes at most (and one part), and enough for ``TASKS``."""
    size, first = int(count.sum()), np.cumsum(parts) - parts
    tasks = min(TASKS, -(-size // SHARE))
    limit = max(1, min(BLOCK // (8 * max(dims, 1)), -(-size // math.isqrt(tasks))))
    each = np.repeat(count / parts, parts)
    block = np.unique(((np.cumsum(each) - each) // limit).astype(np.int64), return_inverse=True)[1]
    ring = np.repeat(np.arange(len(count)), parts)
    n = int(block[-1]) + 1
    spans = [(int(ring[lo]), int(ring[hi - 1])) for lo, hi in zip(np.searchsorted(block, np.arange(n)), np.searchsorted(block, np.arange(n), "right"), strict=True)]
    return block, first, spans, -(-tasks // n)


def _parts(shape):
    """Points of a ring dealt over its parts, whatever their coordinates, with the parts' blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shape.value
        for batch in batches:
            at = np.searchsorted(s.keys, batch.column("k").to_numpy(), "right") - 1
            block = s.block[s.first[at] + batch.column("h").to_numpy() % s.blocks[at]]
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(at), batch.column("point_id"), batch.column("x")], names=["block", "ring", "point_id", "x"])

    return run


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block and ring, sorted, as packs of ``ROW`` bytes."""
    key, ids, xs, done = None, [], [], []

    def out() -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "ring", "ids", "xs"])

    for batch in batches:
        for block, ring, i, x in zip(*(batch.column(c).to_pylist() for c in ("block", "ring", "point_id", "x")), strict=True):
            if ids and (key != (block, ring) or (len(ids) + 1) * len(x) > ROW):
                done.append((*key, packed(np.array(ids, np.int64)), b"".join(xs)))
                ids, xs = [], []
            key = block, ring
            ids.append(i)
            xs.append(x)
        yield out()
        done = []
    if ids:
        done.append((*key, packed(np.array(ids, np.int64)), b"".join(xs)))
    yield out()


#: Packs of points (of a ring) and of queries (with k, bound and, as bits, the block's rings that they ask) on their way to a block's share.
SENDING = "slot long, ids binary, xs binary, ring long, ks binary, bounds binary, rings binary"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Queries (ids, rows, k, bound) of a task, some thousands at a time."""
    held, n = [], 0
    for batch in batches:
        if len(batch):
            held.append((batch.column("query_id").to_numpy(), matrix(batch.column("q")), batch.column("k").to_numpy(), batch.column("bound").to_numpy()))
            n += len(batch)
        if n >= GATHERED:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _asks(shape, epsilon: float, first: bool):
    """Packs of queries for the blocks with rings that they go to: the nearest (``first``), or all that can hold an answer within the bound."""
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in SENDING.split(", ")]

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shape.value
        for ids, qs, ks, bounds in _gathered(batches):
            d, off = far(qs, s.pivots, s.p)
            share = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % s.shares
            rows: list[tuple] = []
            size, most = 0, max(1, ROW // max(8 * qs.shape[1], 1))
            order = np.lexsort((d.min(1), d.argmin(1)))
            for start in range(0, len(order), ASKED):
                part = order[start : start + ASKED]
                goes = s.nearest(d[part], ks[part]) if first else s.least(d[part], off) * (1 + epsilon) <= bounds[part, None] * (1 + ROUNDING)
                for b, (low, high) in enumerate(s.spans):
                    own = goes[:, low : high + 1]
                    asked = np.flatnonzero(own.any(1))
                    for t in np.unique(share[part[asked]]).tolist():
                        mine = asked[share[part[asked]] == t]
                        for n in range(0, len(mine), most):
                            at = part[mine[n : n + most]]
                            bits = packed(np.packbits(own[mine[n : n + most]], axis=1))
                            rows.append((b * s.shares + t, packed(ids[at]), narrowed(qs[at]), None, packed(ks[at]), packed(bounds[at]), bits))
                            size += qs[at].nbytes + len(bits)
                    if size > SENT:
                        yield sent(rows)
                        rows, size = [], 0
            yield sent(rows)

    return run


def _answers(q: np.ndarray, ks: np.ndarray | None, bounds: np.ndarray, x: np.ndarray, points: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, point and distance of what lies within the bounds; with ``ks``, of the k nearest of each query, ties by id."""
    square = squares(q, x) if p == 2 else None
    d, off = near(q, x, p) if square is None else (square, 0.0)
    if square is None:
        close = within(d, bounds + 2 * off)
    else:  # a little more than the bound's square, as a whole number of their type
        close = d <= np.floor(np.minimum(bounds * np.abs(bounds) * (1 + ROUNDING), 2.0**24)).astype(np.float32)[:, None]
    if ks is not None and ks.min() < len(x) and np.count_nonzero(close) > 4 * np.minimum(ks, len(x)).sum():
        least = np.partition(d, np.unique(np.minimum(ks, len(x))) - 1, axis=1)
        close &= within(d, least[np.arange(len(q)), np.minimum(ks, len(x)) - 1] + 4 * off)
    i, j = np.divmod(np.flatnonzero(close), len(x))
    if off:
        e = np.concatenate([exact(x[j[n : n + TOGETHER]], q[i[n : n + TOGETHER]], p) for n in range(0, len(i), TOGETHER)] or [np.empty(0)])
    else:  # they are exact as they stand
        e = d[i, j].astype(float) if square is None else np.sqrt(square[i, j].astype(float))
    return (i, points[j], e) if ks is None else nearest_of(i, points[j], e, ks, bounds)


def nearest_of(i: np.ndarray, points: np.ndarray, e: np.ndarray, ks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (query, point, distance), the k nearest of each query within its bound, ties by id."""
    order = np.lexsort((points, e, i))
    i, points, e = i[order], points[order], e[order]
    good = (np.arange(len(i)) - np.searchsorted(i, i) < ks[i]) & (e <= bounds[i])
    return i[good], points[good], e[good]


def tightened(best: tuple[np.ndarray, np.ndarray, np.ndarray], ks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bounds no greater than the k-th distance in ``best`` (of ``nearest_of``), where there are k."""
    ends = np.searchsorted(best[0], np.arange(len(ks)), "right")
    full = np.flatnonzero((np.diff(ends, prepend=0) >= ks) & (ks > 0))
    out = bounds.copy()
    out[full] = np.minimum(out[full], best[2][ends[full] - 1])
    return out


class _Block:
    """The points of one block, ring after ring."""

    def __init__(self, s: Shape, block: int, rings: list[int], ids: list[np.ndarray], xs: list[np.ndarray]):
        self.s, self.low, self.high = s, *s.spans[block]
        self.ids, self.x = np.concatenate(ids), np.concatenate(xs).reshape(sum(map(len, ids)), -1)
        ends = np.cumsum(np.bincount(np.array(rings) - self.low, [len(i) for i in ids], self.high - self.low + 1).astype(np.int64))
        self.starts = np.concatenate([[0], ends])
        self.waves = self.felt = self.ends = self.rows = None

    def sifts(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Values of the queries and points for a bound by waves (p = 1), queries as rows of the type of ``self.rows``; None if there is no such bound."""
        if self.felt is None:
            self.waves = Waves.fitted(q, self.x)
            self.felt = self.waves and self.waves.of(self.x)
            if self.felt is None:
                return None
            if whole(self.x, self.x[:0], 1) is not None:
                self.ends = np.array([[self.x.min(), self.x.max()]])
        felt = self.waves.of(q)
        if felt is None:
            return None
        kind = np.float64 if self.ends is None else whole(q, self.ends, 1) or np.float64
        if self.rows is None or self.rows.dtype != kind:
            self.rows = self.x.astype(kind)
        return felt, q.astype(kind)

    def sifted(self, felt: np.ndarray, q: np.ndarray, mine: np.ndarray, bounds: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """As ``_answers`` of the queries ``mine`` and points from ``low`` to ``high``, pairs worked out only where waves leave them; None if those are many."""
        close = felt[mine] @ self.felt[low:high].T >= self.waves.floor(bounds)[:, None]
        if np.count_nonzero(close) > SIFTED * close.size:
            return None
        i, j = np.divmod(marked(close), high - low)
        j += low
        e = of_pairs(q, self.rows, mine[i], j)
        good = e <= bounds[i]
        return i[good], self.ids[j[good]], e[good]

    def pieces(self, goes: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """Neighbouring rings that are asked, in pieces of ``PACK`` points at most: which queries ask, and from where to where."""
        held: list[int] = []
        asked = np.flatnonzero(goes.any(0) & (np.diff(self.starts) > 0)).tolist()
        for r, after in zip(asked, [*asked[1:], None], strict=True):
            held.append(r)
            if after is None or after != r + 1 or self.starts[after + 1] - self.starts[held[0]] > PACK:
                mine = np.flatnonzero(goes[:, held[0] : r + 1].any(1))
                for n in range(int(self.starts[held[0]]), int(self.starts[r + 1]), PACK):
                    yield mine, n, min(n + PACK, int(self.starts[r + 1]))
                held = []

    def meet(self, rows: list[tuple[np.ndarray, ...]], nearest: bool) -> Iterator[pa.RecordBatch]:
        ids, ks, bounds = (np.concatenate([r[c] for r in rows]) for c in (0, 2, 3))
        q = np.concatenate([r[1] for r in rows]).reshape(len(ids), -1)
        rings = self.high - self.low + 1
        goes = np.concatenate([np.unpackbits(r[4].reshape(len(r[0]), -1), axis=1, count=rings) for r in rows]).astype(bool)
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        sifts = self.sifts(q) if self.s.p == 1 and np.isfinite(bounds).any() else None
        for mine, low, high in self.pieces(goes):
            got = self.sifted(*sifts, mine, bounds[mine], low, high) if sifts is not None else None
            i, points, e = got or _answers(q[mine], ks[mine] if nearest else None, bounds[mine], self.x[low:high], self.ids[low:high], self.s.p)
            if nearest:
                best = nearest_of(*map(np.concatenate, zip(best, (mine[i], points, e), strict=True)), ks, bounds)
                bounds = tightened(best, ks, bounds)
            else:
                yield found(ids[mine[i]], points, e)
        if nearest:
            yield found(ids[best[0]], *best[1:])


def found(ids: np.ndarray, points: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(points), pa.array(e)], names=["query_id", "point_id", "dist"])


def _meet(shape, nearest: bool):
    """Sorted packs of each block's share: its points, then the queries that stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, slot, block = shape.value, None, None
        rings, ids, xs, asked, n = [], [], [], [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("ids", "xs", "ks", "bounds", "rings")]
            for r, (at, ring) in enumerate(zip(batch.column("slot").to_pylist(), batch.column("ring").to_pylist(), strict=True)):
                if at != slot:
                    if n:
                        yield from block.meet(asked, nearest)
                    slot, block, rings, ids, xs, asked, n = at, None, [], [], [], [], 0
                of = lambda c, kind: np.frombuffer(columns[c][r].as_py(), kind)  # noqa: B023, E731
                if ring is not None:
                    rings.append(ring)
                    ids.append(of(0, np.int64))
                    xs.append(of(1, np.float64))
                    continue
                if block is None:
                    block = _Block(s, slot // s.shares, rings, ids, xs)
                    rings, ids, xs = [], [], []
                who = of(0, np.int64)
                asked.append((who, widened(columns[1][r].as_py(), len(who) * s.pivots.shape[1]), of(2, np.int64), of(3, np.float64), of(4, np.uint8)))
                n += len(asked[-1][0])
                if n >= ASKED:
                    yield from block.meet(asked, nearest)
                    asked, n = [], 0
        if n:
            yield from block.meet(asked, nearest)

    return run


class PivotIndex:
    """An index of points (point_id, p) under a Minkowski distance; its blocks are a table in the shared folder.

    Arrays are of one length. Ids are unique; repeated coordinates may be any share of the points, as
    a ring's points are dealt by a hash of their ids over as many blocks as it needs.
    """

    def __init__(self, points: DataFrame, p: float = 2, pivots: int | None = None):
        self.p, self.spark = p, points.sparkSession
        rows = points.select(F.col("point_id").cast("long").alias("point_id"), F.col("p").cast("array<double>").alias("p"), F.abs(F.xxhash64("point_id") % 2**31).alias("h"))
        self.size = rows.count()
        m = pivots or min(PIVOTS, max(1, math.isqrt(self.size)))
        chosen = [r["p"] for r in rows.orderBy("h", "point_id").limit(m).select("p").collect()]
        self.shape = None
        if not chosen:
            return
        centres = np.unique(np.array(chosen, float).reshape(len(chosen), -1), axis=0)
        between, _ = far(centres, centres, p)
        np.fill_diagonal(between, np.inf)
        width = float(np.median(between.min(1))) / 8 if len(centres) > 1 else 1.0
        dealt = stored(rows.mapInArrow(_dealt(centres, p, width or 1.0), DEALT), "dealt")
        each = dealt.where("n is not null").groupBy("k").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        rings = merged(sorted((r["k"], r["n"], r["low"], r["high"]) for r in each.collect()))
        pairs = dealt.where("lows is not null").select("k", F.posexplode(F.arrays_zip("lows", "highs")).alias("j", "e"))
        ends = pairs.groupBy("k", "j").agg(F.min("e.lows").alias("low"), F.max("e.highs").alias("high")).collect()
        cell_low, cell_high = np.full((len(centres), len(centres)), np.inf), np.zeros((len(centres), len(centres)))
        for r in ends:
            cell_low[r["k"], r["j"]], cell_high[r["k"], r["j"]] = r["low"], r["high"]
        keys, count, low, high = (np.array(column) for column in zip(*rings, strict=True))
        parts = -(-count // PACK)
        self.shape = Shape(p, centres, keys, keys // RINGS, count, low, high, parts, cell_low, cell_high, *blocked(count, parts, centres.shape[1]))
        self.sent = self.spark.sparkContext.broadcast(self.shape)
        blocks = dealt.where("x is not null").select("k", "point_id", "h", "x").mapInArrow(_parts(self.sent), "block long, ring long, point_id long, x binary")
        blocks = blocks.repartition("block").sortWithinPartitions("block", "ring")
        self.blocks = stored(blocks.mapInArrow(_packs, "block long, ring long, ids binary, xs binary"), "blocks")
        discard(dealt)

    def _met(self, queries: DataFrame, epsilon: float, first: bool, nearest: bool) -> DataFrame:
        shares = self.shape.shares
        dealt = queries.select("query_id", "q", "k", "bound").repartition("query_id")  # a file may have all of them
        asks = dealt.mapInArrow(_asks(self.sent, epsilon, first), SENDING)
        slots = F.explode(F.sequence(F.col("block") * shares, F.col("block") * shares + shares - 1))
        both = self.blocks.select(slots.alias("slot"), "ids", "xs", "ring").unionByName(asks, allowMissingColumns=True)
        dealt = both.repartitionById(len(self.shape.spans) * shares, F.col("slot").cast("int")).sortWithinPartitions("slot", F.col("ring").asc_nulls_last())
        return dealt.mapInArrow(_meet(self.sent, nearest), "query_id long, point_id long, dist double")

    def _asked(self, queries: DataFrame, k: int | str, bound: float | str) -> DataFrame:
        of = lambda v, kind: (F.col(v) if isinstance(v, str) else F.lit(v)).cast(kind)
        return queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"), of(k, "long").alias("k"), of(bound, "double").alias("bound"))

    def knn(self, queries: DataFrame, k: int | str, within: float = math.inf, epsilon: float = 0) -> DataFrame:
        """The k nearest points of each query (query_id, q), closer than ``within``: query_id, point_id, dist, rank.

        ``k`` is a number or the name of a column of ``queries``. Ties go by point_id. With ``epsilon``, cells
        are left out unless they can hold a point nearer than the k-th so far by a factor of 1 + epsilon: the
        k-th distance given is at most so many times the true one. A first round over the nearest rings bounds the k-th
        distance; the second visits the other rings that the bound does not rule out.
        """
        if self.shape is None:
            return self.spark.createDataFrame([], "query_id long, point_id long, dist double, rank int")
        asked = self._asked(queries, k, math.inf).where("k > 0")
        begun = stored(self._met(asked, 0, True, True), "first")
        top = F.array_sort(F.collect_list(F.struct("dist", "point_id")))
        kth = begun.groupBy("query_id").agg(top.alias("top"))
        known = asked.drop("bound").join(kth, "query_id", "left")
        last = F.coalesce(F.get("top", (F.col("k") - 1).cast("int"))["dist"], F.lit(math.inf))
        known = known.select("query_id", "q", "k", F.least(last, F.lit(float(within))).alias("bound"))
        found = self._met(known, epsilon, False, True)
        if epsilon:  # the nearest rings may be among those left out
            found = found.unionByName(begun).groupBy("query_id", "point_id").agg(F.min("dist").alias("dist"))
        every = found.where(F.col("dist") < within).groupBy("query_id").agg(top.alias("top"))
        ranked = every.join(asked.select("query_id", "k"), "query_id").select("query_id", F.posexplode(F.slice("top", 1, F.col("k").cast("int"))).alias("rank", "e"))
        return ranked.select("query_id", "e.point_id", "e.dist", (F.col("rank") + 1).alias("rank"))

    def ball(self, queries: DataFrame, radius: float | str, epsilon: float = 0) -> DataFrame:
        """Pairs with distance <= radius (a number or a column of ``queries``): query_id, point_id, dist.

        With ``epsilon``, rings go unvisited whose points are all farther than radius / (1 + epsilon).
        """
        if self.shape is None:
            return self.spark.createDataFrame([], "query_id long, point_id long, dist double")
        asked = self._asked(queries, 1, radius)
        found = self._met(asked.withColumn("bound", F.col("bound") + 1e-9), epsilon, False, False).withColumn("dist", F.round("dist", 9))
        if isinstance(radius, str):
            return found.join(asked.select("query_id", F.col("bound").alias("__r")), "query_id").where("dist <= __r").drop("__r")
        return found.where(F.col("dist") <= radius)

    def visited(self, queries: DataFrame, bound: float | str, epsilon: float = 0) -> DataFrame:
        """How many points each query (query_id, q) is held against within ``bound``: query_id, n. No point is read."""
        sent = self.sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = sent.value
            for ids, qs, _, bounds in _gathered(batches):
                d, off = far(qs, s.pivots, s.p)
                for i in range(0, len(ids), ASKED):
                    goes = s.least(d[i : i + ASKED], off) * (1 + epsilon) <= bounds[i : i + ASKED, None] * (1 + ROUNDING)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + ASKED]), pa.array((goes * s.count).sum(1))], names=["query_id", "n"])

        return self._asked(queries, 1, bound).mapInArrow(run, "query_id long, n long")
