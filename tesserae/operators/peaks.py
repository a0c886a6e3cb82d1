"""Peaks: candidates that no cell in their reach exceeds, then the greedy choice by falling value, in rounds.

Greedily, the best candidate that is left becomes a peak and silences those near it. In rounds: whatever
has no better candidate near it, and so nothing that could silence it, becomes a peak; what these silence goes; until
none is left. The result is the same, and no grid has to fit a task. With plateaus, a peak takes the cells
that touch it with its value; pieces of equal cells then win together, once nothing better is near any of their cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.frames import PIXEL, discard, numbered, stored
from .neighbourhood import local_max_filter
from .volumes import Space

c = F.col
Near = Callable[..., Column]


def in_box(reach: Sequence[int]) -> Near:
    return lambda *gaps: _all(F.abs(g) <= r for g, r in zip(gaps, reach, strict=True))


def in_ball(radius: float, p: float = 2) -> Near:
    if math.isinf(p):
        return lambda *gaps: _all(F.abs(g) <= radius for g in gaps)
    return lambda *gaps: sum((F.pow(F.abs(g).cast("double"), F.lit(float(p))) for g in gaps), F.lit(0.0)) <= float(radius) ** p + 1e-9


def _all(terms) -> Column:
    out = F.lit(True)
    for t in terms:
        out &= t
    return out


def _met(a: DataFrame, b: DataFrame, keys: list[str], at: list[str], reach: Sequence[int], near: Near) -> DataFrame:
    """Rows of ``a`` and ``b`` (its columns named b_...) near each other: buckets as wide as the reach, and the neighbouring ones."""
    bucket = [f"__{n}" for n in at]
    left = a.select("*", *(F.floor(c(n) / (r + 1)).alias(m) for n, m, r in zip(at, bucket, reach, strict=True)))
    right = b.select(*keys, *(c(n).alias(f"b_{n}") for n in b.columns if n not in keys))
    for n, m, r in zip(at, bucket, reach, strict=True):
        here = F.floor(c(f"b_{n}") / (r + 1))
        right = right.withColumn(m, F.explode(F.array(here - 1, here, here + 1)))
    return left.join(right, [*keys, *bucket]).where(near(*(c(n) - c(f"b_{n}") for n in at))).drop(*bucket)


def greedy(cells: DataFrame, space: Space, reach: Sequence[int], near: Near, plateau: bool) -> DataFrame:
    """The peaks among ``cells`` (keys, sizes, coordinates, v), each cell with ``peak``, the raster number of the one that has it.

    Better is the greater value, then the lesser raster number (of a piece's first cell).
    """
    keys, at, last = space.keys, space.at, None
    live, taken = stored(cells.select(*space.cell, "v", space.raster().alias("n")), "live"), []
    while not live.isEmpty():
        if plateau:
            code = F.when(c("v") >= 0, c("v") + 1).otherwise(c("v"))  # 0 would be background
            pieces = space.components(live.select(*space.cell, code.alias("v")), space.rank).select(*keys, *at, c("root").alias("peak"))
            units = stored(live.join(pieces, [*keys, *at]), "units")
        else:
            units = live.withColumn("peak", c("n"))
        better = (c("b_v") > c("v")) | ((c("b_v") == c("v")) & (c("b_peak") < c("peak")))
        blocked = _met(units, units.select(*keys, *at, "v", "peak"), keys, at, reach, near).where(better).select(*keys, "peak").distinct()
        won = stored(units.join(blocked, [*keys, "peak"], "left_anti").select(*space.cell, "v", "n", "peak"), "peaks")
        taken.append(won)
        rest = live.join(won.select(*keys, "n"), [*keys, "n"], "left_anti").select(*live.columns)
        silenced = _met(rest, won.where("n = peak").select(*keys, *at), keys, at, reach, near).select(*keys, "n").distinct()
        old, live = live, stored(rest.join(silenced, [*keys, "n"], "left_anti").select(*live.columns), "live")
        discard(old)
        if plateau:
            discard(units)
    out = taken[0] if taken else live.withColumn("peak", c("n"))
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def ranked(found: DataFrame, space: Space, n_peaks: int) -> DataFrame:
    """``found`` with each peak's rank by falling value, then raster number; those past ``n_peaks`` (if positive) are dropped."""
    key = F.to_json(F.struct(*space.keys)).alias("__k")
    first = found.where("n = peak").select(*space.keys, "peak", "v", key)
    ranks = numbered(first, "__k", [-c("v"), c("peak")], "rank").select(*space.keys, "peak", c("rank").cast("long").alias("rank"))
    out = found.join(ranks, [*space.keys, "peak"])
    return out.where(c("rank") <= n_peaks) if n_peaks > 0 else out


PLANE = Space((("y", "h"), ("x", "w")))


def candidates(px: DataFrame, footprint: K.Kernel, threshold: float | None, mode: str, value: float, sign: int = 1) -> DataFrame:
    """Cells above the threshold (half the image's greatest value by default) and no lower than any under the footprint.

    With ``sign`` -1: below it, and no higher; ``v`` is then the negative.
    """
    px = px.select(*PIXEL, (sign * c("v")).alias("v"))
    top = local_max_filter(px, footprint, mode, sign * value).select("image_id", "y", "x", c("v").alias("top"))
    most = px.groupBy("image_id").agg((0.5 * F.max(sign * c("v"))).alias("th")) if threshold is None else px.select("image_id").distinct().withColumn("th", F.lit(float(threshold)))
    return px.join(top, ["image_id", "y", "x"]).join(most, "image_id").where((c("v") > sign * c("th")) & (c("v") >= c("top"))).select(*PIXEL, "v")


def peak_suppression(px: DataFrame, distance: int | tuple[int, int], threshold: float | None = None, n_peaks: int = -1, mode: str = "constant", value: float = 0.0, invert: bool = False, top: float = 255.0) -> DataFrame:
    """Peaks (image_id, y, x, v, rank): greedy by value, each with its plateau, which shares its rank; the box of a peak is kept clear.

    With ``invert``, of the image ``top`` - v, and ``v`` is that value.
    """
    reach = (distance, distance) if isinstance(distance, int) else distance
    px = px.withColumn("v", top - c("v")) if invert else px
    found = candidates(px, K.box(2 * reach[0] + 1, 2 * reach[1] + 1), threshold, mode, value)
    return ranked(greedy(found, PLANE, reach, in_box(reach), True), PLANE, n_peaks).select("image_id", "y", "x", "v", "rank")


def find_peaks(
    px: DataFrame,
    distance: int = 1,
    threshold: float | None = None,
    n_peaks: int = -1,
    mode: str = "constant",
    value: float = 0.0,
    p: float = 2,
    footprint: K.Kernel | None = None,
    invert: bool = False,
) -> DataFrame:
    """Local extrema (image_id, y, x, v, rank) at more than ``distance`` from better ones, in a Minkowski norm.

    A candidate is the greatest under ``footprint`` (by default the box of the distance) and above ``threshold``; with
    ``invert``, the least and below it.
    """
    sign = -1 if invert else 1
    found = candidates(px, footprint or K.box(2 * distance + 1, 2 * distance + 1), threshold, mode, value, sign)
    out = ranked(greedy(found, PLANE, (distance, distance), in_ball(distance, p), False), PLANE, n_peaks)
    return out.select("image_id", "y", "x", (sign * c("v")).alias("v"), "rank")


def _strong(votes: DataFrame, space: Space, reach: Sequence[int], threshold: float | None) -> DataFrame:
    """Cells of a sparse accumulator above the threshold (half an image's greatest) that none in their box exceeds."""
    th = votes.groupBy("image_id").agg((F.max("v") * 0.5).alias("th"))
    strong = stored(votes.join(th, "image_id").where(c("v") > (c("th") if threshold is None else F.lit(threshold))).select(*space.cell, "v"), "strong")
    beaten = _met(strong, strong.select(*space.keys, *space.at, "v"), space.keys, space.at, reach, in_box(reach)).where("b_v > v").select(*space.keys, *space.at).distinct()
    return strong.join(beaten, [*space.keys, *space.at], "left_anti")


def hough_line_peak(votes: DataFrame, n_peaks: int = -1, distance: int = 7, theta: int = 7, threshold: float | None = None) -> DataFrame:
    """Peaks of line votes (image_id, rho, theta_ix, votes) with their plateaus, in a box of (distance, theta); ranks by votes."""
    ends = votes.agg(F.min("rho").alias("a"), F.max("rho").alias("b"), F.max("theta_ix").alias("t")).first()
    low, size = ends["a"] or 0, ((ends["b"] or 0) - (ends["a"] or 0) + 1, (ends["t"] or 0) + 1)
    space = Space((("y", "h"), ("x", "w")))
    rows = votes.select("image_id", *(F.lit(n).alias(m) for n, m in zip(size, "hw", strict=True)), (c("rho") - low).cast("int").alias("y"), c("theta_ix").cast("int").alias("x"), c("votes").cast("double").alias("v"))
    reach = (distance, theta)
    found = ranked(greedy(_strong(rows, space, reach, threshold), space, reach, in_box(reach), True), space, n_peaks)
    return found.select("image_id", (c("y") + low).cast("int").alias("rho"), c("x").alias("theta_ix"), c("v").cast("long").alias("votes"), "rank")


def hough_circle_peak(votes: DataFrame, n_peaks: int = -1, dy: int = 7, dx: int = 7, threshold: float | None = None) -> DataFrame:
    """Peaks of circle votes (image_id, radius_ix, y, x, votes), in a box that reaches the next radii, with their plateaus.

    ``n_peaks`` keeps the first in raster order of (radius, y, x), not those of most votes.
    """
    ends = votes.agg(*(F.max(n) for n in ("radius_ix", "y", "x"))).first()
    size = [(e or 0) + 1 for e in ends]
    space = Space((("radius_ix", "d"), ("y", "h"), ("x", "w")))
    at = [c(n).cast("int").alias(n) for n in space.at]
    rows = votes.select("image_id", *(F.lit(n).alias(m) for n, m in zip(size, "dhw", strict=True)), *at, c("votes").cast("double").alias("v"))
    reach = (0 if size[0] == 1 else 1, dy, dx)
    found = greedy(_strong(rows, space, reach, threshold), space, reach, in_box(reach), True)
    if n_peaks >= 0:
        found = numbered(found, "image_id", [c("n")], "k").where(c("k") <= n_peaks)
    return found.select("image_id", "radius_ix", "y", "x", c("v").cast("long").alias("votes"))
