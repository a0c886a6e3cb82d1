"""What can be reached from seeds by an element's moves, which need not lead back.

Tiles with a border flood what they can by themselves; what they reach is stored, borders are exchanged, and so on
until nothing is added. A round costs one pass, and there are as many as tiles on the longest way.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans import tiles
from ..plans.frames import PIXEL, discard, stored

c = F.col
#: Values of cells: closed, open, reached.
CLOSED, OPEN, REACHED = 0.0, 1.0, 2.0


def _flood(moves: list[tuple[int, int]], reach: tuple[int, int, int, int]):
    """A tile's states once what is reached in it or in its border has spread over its open cells; 3 for those added."""
    top, bottom, left, right = reach

    def run(a: np.ndarray) -> np.ndarray:
        a = np.pad(a, max(1, *reach))  # moves out of the window meet closed cells
        flat, width = a.ravel(), a.shape[1]
        before = flat == REACHED
        front = np.flatnonzero(before)
        steps = np.array([dy * width + dx for dy, dx in moves])
        while len(front):
            to = (front[:, None] + steps).ravel()
            front = np.unique(to[flat[to] == OPEN])
            flat[front] = REACHED
        flat[(flat == REACHED) & ~before] = 3.0
        p = max(1, *reach)
        out = flat.reshape(a.shape)[p:-p, p:-p]
        return out[top : out.shape[0] - bottom, left : out.shape[1] - right]

    return run


def reached(states: DataFrame, moves: list[tuple[int, int]], side: int | None = None) -> DataFrame:
    """``states`` (v: 0 closed, 1 open, 2 reached) once every open cell that a reached one has a move (dy, dx) to is reached."""
    moves = [m for m in moves if m != (0, 0)]
    if not moves:
        return states
    dys, dxs = [m[0] for m in moves], [m[1] for m in moves]
    reach, last = (max(0, *dys), max(0, -min(dys)), max(0, *dxs), max(0, -min(dxs))), None
    while True:
        done = stored(tiles.over_tiles(states, reach, _flood(moves, reach), side=side), "reached")
        if last is not None:
            discard(last)
        states, last = done.withColumn("v", F.least("v", F.lit(REACHED))), done
        if done.where("v > 2").isEmpty():
            return states


def fill_holes(px: DataFrame, element: K.Kernel | None = None, anchor=None, side: int | None = None) -> DataFrame:
    """Background that no chain of the element's steps joins to the outside becomes foreground.

    A background cell is open if a cell under the turned element is outside or open.
    """
    taps = [t[:2] for t in K.taps(element or K.default_element(), anchor)]
    outside = F.lit(False)
    for dy, dx in taps:
        outside |= ~((c("y") + dy).between(0, c("h") - 1) & (c("x") + dx).between(0, c("w") - 1))
    states = px.select(*PIXEL, F.when(c("v") != 0, CLOSED).when(outside, REACHED).otherwise(OPEN).alias("v"))
    return reached(states, [(-dy, -dx) for dy, dx in taps], side).withColumn("v", (c("v") != REACHED).cast("double"))


def region_fill(px: DataFrame, seed: tuple[int, int], element: K.Kernel | None = None, anchor=None, tolerance: float = 0, binary: bool = True, value: float = 1.0, side: int | None = None) -> DataFrame:
    """Flood fill from ``seed`` by an element's steps: a cell leads to those that its element covers, and back only if theirs covers it.

    Binary: the zeros that are reached join the ones. Numeric: cells reached within ``tolerance`` of the seed's
    value are filled, as is every cell outside the tolerance. The seed is reached if it is open.
    """
    at_seed = (c("y") == seed[0]) & (c("x") == seed[1])
    if binary:
        rows = px.withColumn("open", c("v") == 0)
    else:
        level = px.where(at_seed).select("image_id", c("v").alias("level"))
        rows = px.join(level, "image_id").withColumn("open", F.abs(c("v") - c("level")) <= tolerance)
    states = rows.select(*PIXEL, F.when(~c("open"), CLOSED).when(at_seed, REACHED).otherwise(OPEN).alias("v"))
    moves = [t[:2] for t in K.taps(element or K.default_element(), anchor, flip=False)]
    return reached(states, moves, side).withColumn("v", F.when(c("v") != OPEN, value).otherwise(0.0))
