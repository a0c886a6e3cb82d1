"""The search for line segments that is sequential within an image: one Arrow group for each image."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..plans.frames import PIXEL
from .features import default_angles


def array_of(rows: pd.DataFrame) -> np.ndarray:
    a = np.zeros((int(rows["h"].iloc[0]), int(rows["w"].iloc[0])))
    a[rows["y"], rows["x"]] = rows["v"]
    return a


def _arm(mask: np.ndarray, y: int, x: int, dy: int, dx: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells from a set pixel on, by steps, up to the last set one before a hole of more than ``gap`` cells or the border."""
    room = [(n - 1 - p) // d if d > 0 else p // -d for p, d, n in ((y, dy, mask.shape[0]), (x, dx, mask.shape[1])) if d]
    k = np.arange(min(room, default=0) + 1)
    ys, xs = y + dy * k, x + dx * k
    there = np.flatnonzero(mask[ys, xs])
    holes = np.flatnonzero(np.diff(there) - 1 > gap)
    last = there[holes[0]] if len(holes) else there[-1]
    return ys[: last + 1], xs[: last + 1]


def line_segments(a: np.ndarray, theta: Sequence[float], threshold: int, length: int, gap: int) -> list[tuple[int, int, int, int]]:
    """Segments found while votes come in by raster order: once a pixel's best cell passes the threshold, the line
    through it is followed both ways over gaps; if long enough, its pixels and their votes for it are taken back."""
    mask = np.abs(a) > 2.220446049250313e-16
    h, w = a.shape
    co, si = np.cos(theta), np.sin(theta)
    shift = math.ceil(math.hypot(h, w))
    votes = np.zeros((2 * shift + 1, len(co)), np.int64)
    every = np.arange(len(co))
    rho = lambda y, x, t: np.floor(co[t] * x + si[t] * y + 0.5).astype(int) + shift
    out = []
    for y0, x0 in np.argwhere(mask).tolist():
        if not mask[y0, x0]:
            continue
        cells = rho(y0, x0, every)
        votes[cells, every] += 1
        t = int(np.argmax(votes[cells, every]))
        if votes[cells[t], t] <= threshold:
            continue
        if abs(si[t]) > abs(co[t]):
            step = (math.floor(co[t] / abs(si[t]) + 0.5), 1 if si[t] < 0 else -1)
        else:
            step = (1 if co[t] > 0 else -1, math.floor(-si[t] / abs(co[t]) + 0.5))
        arms = [_arm(mask, y0, x0, way * step[0], way * step[1], gap) for way in (1, -1)]
        (ya, xa), (yb, xb) = ((int(y[-1]), int(x[-1])) for y, x in arms)
        if max(abs(ya - yb), abs(xa - xb)) < length:
            continue
        for y, x in arms:
            on = mask[y, x]
            np.subtract.at(votes, (rho(y[on], x[on], t), t), 1)
            mask[y[on], x[on]] = False
        out.append((ya, xa, yb, xb))
    return out


def hough_probabilistic_line(px: DataFrame, theta: Sequence[float] | None = None, threshold: int = 10, length: int = 50, gap: int = 8) -> DataFrame:
    """Segments (image_id, i, y1, x1, y2, x2) of each image."""
    theta = list(theta or default_angles())

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        got = line_segments(array_of(rows), theta, threshold, length, gap)
        return pd.DataFrame([(rows["image_id"].iloc[0], i, *s) for i, s in enumerate(got)], columns=["image_id", "i", "y1", "x1", "y2", "x2"]).astype("int64")

    return px.select(*PIXEL, "v").groupBy("image_id").applyInPandas(run, "image_id long, i long, y1 long, x1 long, y2 long, x2 long")
