"""Tiles with a border of neighbours: what an operator needs to work on arrays without holding an image.

A pixel goes to the tiles whose window it is in, which are four at most while a border is no wider than a
tile; tiles grow with wide borders, so that the copies stay bounded whatever the neighbourhood.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import IMAGE

c = F.col
#: Side of a tile, or the widest border if that is more.
TILE = 128


def _range(at: str, size: str, before: int, after: int, side: int) -> Column:
    """Tiles along an axis whose windows have a place; ``before`` and ``after`` cells belong to a window beside its tile."""
    first = F.greatest(F.floor((c(at) - after) / side), F.lit(0)).cast("int")
    last = F.least(F.floor((c(at) + before) / side), F.floor((c(size) - 1) / side)).cast("int")
    return F.filter(F.sequence(first, F.greatest(first, last)), lambda t: t <= last)


def windows(px: DataFrame, top: int, bottom: int, left: int, right: int, side: int) -> DataFrame:
    """``px`` (with what lies outside the image, if need be) and for each pixel the tiles (gy, gx) that read it."""
    rows = px.withColumn("gy", F.explode(_range("y", "h", top, bottom, side)))
    return rows.withColumn("gx", F.explode(_range("x", "w", left, right, side)))


def over_tiles(px: DataFrame, reach: tuple[int, int, int, int], kernel: Callable[[np.ndarray], np.ndarray], inner: bool = False, side: int | None = None) -> DataFrame:
    """``v`` by a function of arrays: from a tile with ``reach`` cells above, below, left and right to the tile.

    Cells that no pixel fills are 0. With ``inner``, only cells whose window is within the image are there.
    """
    top, bottom, left, right = reach
    side = side or max(TILE, *reach)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h, w, y0, x0 = int(rows["h"].iloc[0]), int(rows["w"].iloc[0]), key[1] * side, key[2] * side
        y1, x1 = min(h, y0 + side), min(w, x0 + side)
        a = np.zeros((y1 - y0 + top + bottom, x1 - x0 + left + right))
        a[rows["y"] - y0 + top, rows["x"] - x0 + left] = rows["v"]
        y, x = np.mgrid[y0:y1, x0:x1]
        out = pd.DataFrame({"image_id": key[0], "h": h, "w": w, "y": y.ravel(), "x": x.ravel(), "v": np.asarray(kernel(a), float).ravel()})
        return out[out["y"].between(top, h - 1 - bottom) & out["x"].between(left, w - 1 - right)] if inner else out

    rows = windows(px.select(*IMAGE, "y", "x", "v"), top, bottom, left, right, side)
    return rows.groupBy("image_id", "gy", "gx").applyInPandas(run, "image_id long, h int, w int, y int, x int, v double")


#: Values under footprints that are looked at together.
TOGETHER = 2_000_000


def ranked(taps: list[tuple[int, int]], rank: int, top: int, left: int) -> Callable[[np.ndarray], np.ndarray]:
    """The rank-th smallest (from 1) of what the taps (dy, dx) read."""
    bottom, right = max(0, *(t[0] for t in taps)), max(0, *(t[1] for t in taps))
    dy, dx = np.array(taps).T

    def run(a: np.ndarray) -> np.ndarray:
        h, w = a.shape[0] - top - bottom, a.shape[1] - left - right
        out, rows = np.empty((h, w)), max(1, TOGETHER // (w * len(taps)))
        for y in range(0, h, rows):
            ys = np.arange(y, min(h, y + rows))[:, None, None] + top + dy
            out[y : y + rows] = np.partition(a[ys, np.arange(w)[:, None] + left + dx], rank - 1, axis=-1)[..., rank - 1]
        return out

    return run


def weighted(taps: list[tuple[int, int, float]], top: int, left: int) -> Callable[[np.ndarray], np.ndarray]:
    """Sum of the taps (dy, dx, weight). Of a whole box of equal weights, four reads of prefix sums a cell, whatever its size."""
    dys, dxs = [t[0] for t in taps], [t[1] for t in taps]
    bottom, right = max(0, *dys), max(0, *dxs)
    y0, y1, x0, x1 = min(dys), max(dys), min(dxs), max(dxs)
    box = len({t[2] for t in taps}) == 1 and len(taps) == (y1 - y0 + 1) * (x1 - x0 + 1)

    def run(a: np.ndarray) -> np.ndarray:
        h, w = a.shape[0] - top - bottom, a.shape[1] - left - right
        if box:
            s = np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            p = lambda dy, dx: s[top + dy : top + dy + h, left + dx : left + dx + w]
            return taps[0][2] * (p(y1 + 1, x1 + 1) - p(y0, x1 + 1) - p(y1 + 1, x0) + p(y0, x0))
        out = np.zeros((h, w))
        for dy, dx, wt in taps:
            out += wt * a[top + dy : top + dy + h, left + dx : left + dx + w]
        return out

    return run
