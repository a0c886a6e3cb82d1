"""Operators on grids of any rank: volumes, stacks of frames, signals.

A ``Space`` names the axes that an operator works along; every other key column (image, frame, channel)
only tells grids apart, which is how an operator of lower rank is applied over leading axes.
Cells go to blocks with a border of neighbours, which work on arrays; a cell is sent a bounded number
of times whatever the footprint, and no grid has to fit a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.borders import MODES
from ..plans.frames import numbered, stored
from ..plans.tiles import TOGETHER
from .labels import joined, rooted
from .neighbourhood import _copies

c = F.col
#: Cells of a block by rank, about; sides are powers of two.
SIDES = {1: 65_536, 2: 128, 3: 32, 4: 16}
#: Cells of whole blocks whose components are found together, about.
GATHERED = 65_536
Offsets = list[tuple[tuple[int, ...], float]]


def offsets(kernel, anchor: Sequence[int] | None = None, flip: bool = True, dilation: int = 1) -> Offsets:
    """Where a kernel (nested lists of any rank) reads and with which weight; convolution turns it, the anchor stays."""
    a = np.asarray(kernel, float)
    if anchor is None:
        if any(n % 2 == 0 for n in a.shape):
            raise ValueError("a kernel of even size needs an anchor")
        anchor = [n // 2 for n in a.shape]
    a = np.flip(a) if flip else a
    return [(tuple((i - m) * dilation for i, m in zip(at, anchor, strict=True)), float(w)) for at, w in np.ndenumerate(a) if w]


def element(rank: int, connectivity: int = 1, hole: bool = False) -> np.ndarray:
    """Cells of the 3 x ... x 3 box whose offsets differ from 0 along at most ``connectivity`` axes."""
    away = np.abs(np.indices((3,) * rank) - 1).sum(0)
    return ((away <= connectivity) & ~(hole & (away == 0))).astype(float)


def _changes(rows: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Which rows differ from the one before in a column of ``names``; the first does."""
    out = np.ones(len(rows), bool)
    if len(rows) > 1:
        out[1:] = False
        for column in (rows.column(n).combine_chunks() for n in names):
            here, before = column[1:], column[:-1]
            empty = column.is_null().to_numpy(zero_copy_only=False)
            out[1:] |= (empty[1:] != empty[:-1]) | pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
    return out


def _parts(keys: list[str], at: list[str], side: int, steps: list[tuple[int, ...]]):
    """Rows sorted by grid, block and raster number ``__n``, with part: the least number of the cell's component within its block.

    The blocks of some ten thousand cells are worked on together.
    """
    blocks = [f"__{a}" for a in at]

    def of(rows: pa.Table) -> pa.Table:
        numbers = rows.column("__n").to_numpy()
        v = rows.column("v").cast(pa.float64()).to_numpy()
        on = np.flatnonzero((v != 0) & rows.column("v").is_valid().to_numpy())
        code = np.cumsum(_changes(rows, [*keys, *blocks]))[on]
        strides = [(side + 2) ** i for i in range(len(at))][::-1]  # an empty cell round each block
        code *= (side + 2) ** len(at)
        for a, b, stride in zip(at, blocks, strides, strict=True):
            code += (rows.column(a).to_numpy().astype(np.int64) - rows.column(b).to_numpy() * side + 1)[on] * stride
        order = np.argsort(code, kind="stable")
        ranked, pairs = code[order], []
        for step in steps:
            wanted = ranked + int(np.dot(step, strides))
            place = np.minimum(np.searchsorted(ranked, wanted), max(len(ranked) - 1, 0))
            meets = ranked[place] == wanted
            pairs.append((order[meets], order[place[meets]]))
        a, b = (np.concatenate(e) for e in zip(*pairs, strict=True))
        touch = v[on[a]] == v[on[b]]
        part, none = np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
        part[on], none[on] = numbers[on][joined(len(on), a[touch], b[touch])], False
        return rows.drop_columns(blocks).append_column("part", pa.array(part, mask=none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            n += len(batch)
            if n >= GATHERED:
                rows = pa.Table.from_batches(held)
                last = int(np.flatnonzero(_changes(rows, [*keys, *blocks]))[-1])  # the last block may go on
                if last:
                    yield from of(rows.slice(0, last)).to_batches()
                held, n = rows.slice(last).to_batches(), n - last
        if n:
            yield from of(pa.Table.from_batches(held)).to_batches()

    return run


class Space:
    """Axes as (coordinate, size) column names, and the keys that tell grids apart; ``v`` holds the values."""

    def __init__(self, axes: Sequence[tuple[str, str]] = (("z", "d"), ("y", "h"), ("x", "w")), keys: Sequence[str] = ("image_id",), side: int | None = None):
        self.at, self.sizes, self.keys = [a for a, _ in axes], [n for _, n in axes], list(keys)
        self.rank = len(self.at)
        self.cell = [*self.keys, *self.sizes, *self.at]
        self.side = side or SIDES.get(self.rank, 8)

    def pad(self, px: DataFrame, low: Sequence[int], high: Sequence[int], mode: str = "constant", value: float = 0.0) -> DataFrame:
        """Cells outside the grid as the border mode says, ``low`` before and ``high`` after it along each axis."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if mode == "valid" or not any((*low, *high)):
            return px
        if mode != "constant":
            for a, n, b, e in zip(self.at, self.sizes, low, high, strict=True):
                px = px.withColumn(a, F.explode(_copies(a, n, b, e, mode)))
            return px
        frame = px.select(*self.keys, *self.sizes).distinct()
        for a, n, b, e in zip(self.at, self.sizes, low, high, strict=True):
            frame = frame.withColumn(a, F.explode(F.sequence(F.lit(-b), c(n) + e - 1)))
        inside = F.lit(True)
        for a, n in zip(self.at, self.sizes, strict=True):
            inside &= c(a).between(0, c(n) - 1)
        return px.select(*self.cell, "v").unionByName(frame.where(~inside).select(*self.cell, F.lit(float(value)).alias("v")))

    def _schema(self, px: DataFrame, *more: str) -> str:
        kinds = {f.name: f.dataType.simpleString() for f in px.schema}
        return ", ".join([*(f"{n} {kinds[n]}" for n in self.cell), *more])

    def over_blocks(self, px: DataFrame, low: Sequence[int], high: Sequence[int], kernel: Callable[[np.ndarray], np.ndarray], inner: bool = False) -> DataFrame:
        """``v`` by a function of arrays, from a block with ``low`` and ``high`` further cells to the block; cells that are not there are 0."""
        at, sizes, keys, side = self.at, self.sizes, self.keys, max(self.side, *low, *high)
        rows = px.select(*self.cell, "v")
        for a, n, b, e in zip(at, sizes, low, high, strict=True):
            first = F.greatest(F.floor((c(a) - e) / side), F.lit(0)).cast("int")
            last = F.least(F.floor((c(a) + b) / side), F.floor((c(n) - 1) / side)).cast("int")
            rows = rows.withColumn(f"__{a}", F.explode(F.filter(F.sequence(first, F.greatest(first, last)), lambda t: t <= last)))  # noqa: B023 - called at once

        def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
            size = [int(cells[n].iloc[0]) for n in sizes]
            start = [int(k) * side for k in key[len(keys) :]]
            stop = [min(n, s + side) for n, s in zip(size, start, strict=True)]
            a = np.zeros([e - s + b + t for s, e, b, t in zip(start, stop, low, high, strict=True)])
            a[tuple(cells[n].to_numpy() - s + b for n, s, b in zip(at, start, low, strict=True))] = cells["v"]
            places = np.indices([e - s for s, e in zip(start, stop, strict=True)])
            out = dict(zip(keys, key, strict=False)) | dict(zip(sizes, size, strict=True))
            out |= {n: p.ravel() + s for n, p, s in zip(at, places, start, strict=True)}
            out = pd.DataFrame(out | {"v": np.asarray(kernel(a), float).ravel()})
            for n, m, b, t in zip(at, size, low, high, strict=True) if inner else ():
                out = out[out[n].between(b, m - 1 - t)]
            return out

        return rows.groupBy(*keys, *(f"__{a}" for a in at)).applyInPandas(run, self._schema(px, "v double"))

    def _near(self, px: DataFrame, taps: Offsets, mode: str, value: float, kernel: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
        """A function of as many arrays as there are taps, each of what that tap reads."""
        where = np.array([o for o, _ in taps]).reshape(-1, self.rank)
        low, high = np.maximum(0, -where.min(0)).tolist(), np.maximum(0, where.max(0)).tolist()

        def run(a: np.ndarray) -> np.ndarray:
            size = [n - b - e for n, b, e in zip(a.shape, low, high, strict=True)]
            step = max(1, TOGETHER // max(1, int(np.prod(size[1:])) * len(where)))
            parts = []
            for i in range(0, size[0], step):
                rows = min(size[0], i + step) - i
                views = [a[tuple(slice(b + o + (i if k == 0 else 0), b + o + (i + rows if k == 0 else n)) for k, (b, o, n) in enumerate(zip(low, at, size, strict=True)))] for at in where.tolist()]
                parts.append(kernel(views))
            return np.concatenate(parts) if parts else np.zeros(size)

        return self.over_blocks(self.pad(px, low, high, mode, value), low, high, run, mode == "valid")

    def convolve(self, px: DataFrame, kernel, anchor=None, mode: str = "constant", value: float = 0.0, dilation: int = 1) -> DataFrame:
        taps = offsets(kernel, anchor, dilation=dilation)
        if not taps:
            return px.withColumn("v", F.lit(0.0))
        return self._near(px, taps, mode, value, lambda views: sum(w * a for (_, w), a in zip(taps, views, strict=True)))

    def mean_filter(self, px: DataFrame, footprint, mode: str = "constant", value: float = 0.0) -> DataFrame:
        a = np.asarray(footprint, float)
        return self.convolve(px, a / a.sum(), mode=mode, value=value)

    def variance_filter(self, px: DataFrame, footprint, mode: str = "constant", value: float = 0.0) -> DataFrame:
        a = np.asarray(footprint, float)
        taps = offsets(a / a.sum())

        def kernel(views: list[np.ndarray]) -> np.ndarray:
            return sum(w * a * a for (_, w), a in zip(taps, views, strict=True)) - sum(w * a for (_, w), a in zip(taps, views, strict=True)) ** 2

        return self._near(px, taps, mode, value, kernel)

    def gaussian_filter(self, px: DataFrame, sigma: float | Sequence[float], truncate: float = 3.0, mode: str = "reflect", value: float = 0.0) -> DataFrame:
        """One pass of a line along each axis."""
        from ..functions.kernels import gaussian_line

        for axis, s in enumerate([sigma] * self.rank if isinstance(sigma, (int, float)) else sigma):
            line = np.array(gaussian_line(s, truncate)).reshape([-1 if k == axis else 1 for k in range(self.rank)])
            px = self.convolve(px, line, mode=mode, value=value)
        return px

    def rank_filter(self, px: DataFrame, footprint, rank: int, anchor=None, mode: str = "constant", value: float = 0.0) -> DataFrame:
        """The rank-th smallest (from 1) under the footprint, which is not turned."""
        taps = offsets(footprint, anchor, flip=False)
        if not 1 <= rank <= len(taps):
            raise ValueError(f"rank must be from 1 to {len(taps)}")
        return self._near(px, taps, mode, value, lambda views: np.partition(np.stack(views, axis=-1), rank - 1, axis=-1)[..., rank - 1])

    def median_filter(self, px: DataFrame, footprint, mode: str = "constant", value: float = 0.0) -> DataFrame:
        """Rank n // 2 of n, counted from 1."""
        return self.rank_filter(px, footprint, len(offsets(footprint, flip=False)) // 2, mode=mode, value=value)

    def _extreme(self, px: DataFrame, shape, anchor, border: float, least: bool) -> DataFrame:
        shape = element(self.rank) if shape is None else shape
        pick = np.minimum.reduce if least else np.maximum.reduce
        return self._near(px, offsets(shape, anchor), "constant", border, pick)

    def erosion(self, px: DataFrame, shape=None, anchor=None, border: float = 0.0) -> DataFrame:
        """Least value under the element: binary and gray erosion."""
        return self._extreme(px, shape, anchor, border, True)

    def dilation(self, px: DataFrame, shape=None, anchor=None, border: float = 0.0) -> DataFrame:
        return self._extreme(px, shape, anchor, border, False)

    def opening(self, px: DataFrame, shape=None, anchor=None, border: float = 0.0) -> DataFrame:
        return self.dilation(self.erosion(px, shape, anchor, border), shape, anchor, border)

    def closing(self, px: DataFrame, shape=None, anchor=None, border: float = 0.0) -> DataFrame:
        return self.erosion(self.dilation(px, shape, anchor, border), shape, anchor, border)

    def raster(self) -> Column:
        """A cell's number in raster order."""
        n = F.lit(0).cast("long")
        for a, size in zip(self.at, self.sizes, strict=True):
            n = n * c(size) + c(a)
        return n

    def components(self, px: DataFrame, connectivity: int = 1) -> DataFrame:
        """Adds root to the cells with v <> 0: the least raster number of their component. Equal values that touch are one
        component; cells touch that differ by one along at most ``connectivity`` axes.

        Blocks find their components; what touches across blocks are the edges of a graph of those.
        """
        at, side = self.at, self.side
        blocks = [f"__{a}" for a in at]
        steps = [tuple(int(i) - 1 for i in o) for o in np.argwhere(element(self.rank, connectivity, hole=True)) if tuple(o) > (1,) * self.rank]
        dealt = px.select("*", self.raster().alias("__n"), *(F.floor(c(a) / side).alias(b) for a, b in zip(at, blocks, strict=True)))
        dealt = dealt.repartition(*self.keys, *blocks).sortWithinPartitions(*self.keys, *blocks, "__n")
        schema = StructType([*px.schema.fields, StructField("__n", LongType()), StructField("part", LongType())])
        cells = stored(dealt.mapInArrow(_parts(self.keys, at, side, steps), schema), "cells")
        seam = cells.where(F.greatest(*(F.array_contains(F.array(F.lit(0), F.lit(side - 1)), F.pmod(c(a), F.lit(side))).cast("int") for a in at), F.lit(0)) == 1)
        seam = seam.where("part is not null").select(*self.keys, *at, c("v").cast("double").alias("v"), "part")
        moves = F.explode(F.array(*(F.struct(*(F.lit(o).alias(a) for a, o in zip(at, s, strict=True))) for s in steps))).alias("m")
        out = seam.select("*", moves).select(*self.keys, "v", c("part").alias("a"), *((c(a) + c(f"m.{a}")).alias(a) for a in at), *(F.floor(c(a) / side).alias(f"__{a}") for a in at))
        other = F.lit(False)
        for a in at:
            other |= F.floor(c(a) / side) != c(f"__{a}")
        meet = out.where(other).join(seam.withColumnRenamed("part", "b"), [*self.keys, *at, "v"])
        roots = rooted(meet.select(self.grid().alias("image_id"), F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).select(c("image_id").alias("__g"), c("a").alias("__p"), c("root").alias("__r"))
        # cells of no component have keys of their own, so that they are not one large group
        named = cells.withColumn("__g", self.grid()).withColumn("__p", F.coalesce("part", -1 - c("__n"))).join(roots, ["__g", "__p"], "left")
        return named.select(*px.columns, F.coalesce("__r", "part").alias("root"))

    def grid(self) -> Column:
        """What tells a grid apart, as one column."""
        return c(self.keys[0]) if len(self.keys) == 1 else F.struct(*self.keys)

    def _found(self, px: DataFrame, connectivity: int) -> DataFrame:
        """Stored components, with the grid and a key for joins: the root or, where there is none, a number of the cell's own."""
        found = self.components(px, connectivity).withColumn("__g", self.grid()).withColumn("__n", self.raster())
        return stored(found.withColumn("__k", F.coalesce("root", -1 - c("__n"))), "components")

    def label(self, px: DataFrame, connectivity: int = 1) -> DataFrame:
        """0 for background, else 1, 2, ... by each component's first cell in raster order."""
        found = self._found(px, connectivity)
        names = numbered(found.where("root = __n").select("__g", "__k"), "__g", [c("__k")], "label")
        return found.join(names, ["__g", "__k"], "left").select(*self.cell, F.coalesce("label", F.lit(0)).cast("long").alias("label"))

    def remove_small_objects(self, px: DataFrame, threshold: int = 32, connectivity: int = 1) -> DataFrame:
        """Keeps components of more than ``threshold`` cells."""
        found = self._found(px, connectivity)
        large = found.where("root is not null").groupBy("__g", "__k").agg(F.count("*").alias("n")).where(c("n") > threshold)
        return found.join(large, ["__g", "__k"], "left").select(*self.cell, c("n").isNotNull().cast("double").alias("v"))

    def fill_holes(self, px: DataFrame, connectivity: int = 1) -> DataFrame:
        """Background that does not reach the grid's border becomes foreground."""
        flipped = px.withColumn("v", (c("v") == 0).cast("double"))
        found = self._found(flipped, connectivity)
        edge = F.lit(False)
        for a, n in zip(self.at, self.sizes, strict=True):
            edge |= (c(a) == 0) | (c(a) == c(n) - 1)
        open_ = found.where(edge & c("root").isNotNull()).select("__g", "__k").distinct().withColumn("o", F.lit(1))
        return found.join(open_, ["__g", "__k"], "left").select(*self.cell, c("o").isNull().cast("double").alias("v"))
