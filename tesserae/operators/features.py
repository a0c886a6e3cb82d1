"""Integral images, Haar-like features, FAST corners, and Hough votes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shapes import circle_points
from ..plans.frames import PIXEL
from .neighbourhood import neighbours

c = F.col


def integral_image(px: DataFrame) -> DataFrame:
    """Inclusive sums over all cells above and to the left: two running sums, by row and by column."""
    rows = px.withColumn("v", F.sum("v").over(Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("v", F.sum("v").over(Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)))


#: Parts of a feature along (y, x) and each part's place: edge and line along an axis, diagonal quarters.
HAAR = {
    ("edge", 0): ((2, 1), ((0, 0), (1, 0))), ("edge", 1): ((1, 2), ((0, 0), (0, 1))), ("line", 0): ((3, 1), ((0, 0), (1, 0), (2, 0))),
    ("line", 1): ((1, 3), ((0, 0), (0, 1), (0, 2))), ("diag", 0): ((2, 2), ((0, 0), (0, 1), (1, 1), (1, 0))),
}


def haar_rectangles(px: DataFrame, kind: str, axis: int = 0, dims: tuple[int, int] = (2, 2)) -> DataFrame:
    """Rectangles of every feature that fits: image_id, y, x, dh, dw (place and size of a part), rect, y0, x0, y1, x1."""
    (ny, nx), parts = HAAR[kind, 0 if kind == "diag" else axis]
    sizes = F.explode(F.array(*(F.struct(F.lit(a).alias("dh"), F.lit(b).alias("dw")) for a in range(1, dims[0] + 1) for b in range(1, dims[1] + 1))))
    at = px.select("image_id", "h", "w", "y", "x", sizes.alias("s")).select("*", "s.*").drop("s")
    at = at.where((c("y") + ny * c("dh") <= c("h")) & (c("x") + nx * c("dw") <= c("w")))
    rects = F.explode(F.array(*(F.struct(F.lit(i).alias("rect"), F.lit(a).alias("ky"), F.lit(b).alias("kx")) for i, (a, b) in enumerate(parts))))
    r = at.select("*", rects.alias("r")).select("*", "r.*").drop("r")
    y0, x0 = c("y") + c("ky") * c("dh"), c("x") + c("kx") * c("dw")
    return r.select("image_id", "y", "x", "dh", "dw", "rect", y0.alias("y0"), x0.alias("x0"), (y0 + c("dh") - 1).alias("y1"), (x0 + c("dw") - 1).alias("x1"))


def haar_features(px: DataFrame, kind: str, axis: int = 0, dims: tuple[int, int] = (2, 2)) -> DataFrame:
    """Sum of the odd rectangles less that of the even ones, from four corners of the integral image each."""
    r = haar_rectangles(px, kind, axis, dims)
    sign = F.when(c("rect") % 2 == 1, 1.0).otherwise(-1.0)
    corner = lambda y, x, s: F.struct(y.alias("cy"), x.alias("cx"), (sign * s).alias("s"))
    corners = F.array(corner(c("y1"), c("x1"), 1), corner(c("y0") - 1, c("x1"), -1), corner(c("y1"), c("x0") - 1, -1), corner(c("y0") - 1, c("x0") - 1, 1))
    wanted = r.select("image_id", "y", "x", "dh", "dw", F.explode(corners).alias("k")).select("image_id", "y", "x", "dh", "dw", "k.*").where("cy >= 0 and cx >= 0")
    sums = integral_image(px).select("image_id", c("y").alias("cy"), c("x").alias("cx"), c("v").alias("i"))
    return wanted.join(sums, ["image_id", "cy", "cx"]).groupBy("image_id", "y", "x", "dh", "dw").agg(F.sum(c("s") * c("i")).alias("v"))


#: The ring of 16 cells in order.
RING = ((-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1))


def corner_fast(px: DataFrame, n: int = 12, threshold: float = 0.1) -> DataFrame:
    """Where n neighbours on the ring in a row are all brighter or all darker: the sum of whole differences, else 0."""
    taps = [(0, 0, 16), *((dy, dx, i) for i, (dy, dx) in enumerate(RING))]
    got = neighbours(px, taps, "constant", 0.0, pad_zeros=False).groupBy(*PIXEL).agg(F.map_from_entries(F.collect_list(F.struct(c("wt").cast("int"), "v"))).alias("m"))
    ring = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: c("m")[k])
    side = F.transform(ring, lambda u: F.when(u > c("m")[16] + threshold, F.lit("+")).when(u < c("m")[16] - threshold, F.lit("-")).otherwise("0"))
    twice = F.array_join(F.concat(side, side), "")  # a run on the ring is a run in the ring written twice
    hit = twice.contains("+" * n) | twice.contains("-" * n)
    inner = c("y").between(3, c("h") - 4) & c("x").between(3, c("w") - 4)
    total = F.aggregate(ring, F.lit(0.0), lambda s, u: s + F.floor(F.abs(u - c("m")[16])))
    return got.select(*PIXEL, F.when(inner & hit, total).otherwise(0.0).alias("v"))


def default_angles(n: int = 180) -> list[float]:
    return [-math.pi / 2 + math.pi * i / n for i in range(n)]


def hough_line(px: DataFrame, theta: Sequence[float] | None = None) -> DataFrame:
    """Votes (image_id, rho, theta_ix, votes), sparse; rho = floor(x cos + y sin + 1/2). Votes add up before the shuffle."""
    angles = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(math.cos(t)).alias("co"), F.lit(math.sin(t)).alias("si")) for i, t in enumerate(theta or default_angles())))
    rows = px.where("abs(v) > 2.220446049250313e-16").select("image_id", "y", "x", F.explode(angles).alias("t"))
    rho = F.floor(F.round(c("x") * c("t.co") + c("y") * c("t.si"), 9) + 0.5).cast("int")
    return rows.groupBy("image_id", rho.alias("rho"), c("t.i").alias("theta_ix")).agg(F.count("*").alias("votes"))


def hough_circle(px: DataFrame, radii: Sequence[int]) -> DataFrame:
    """Votes (image_id, radius_ix, y, x, votes) of circle centres, sparse; outside the image none."""
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("dy"), F.lit(b).alias("dx")) for i, r in enumerate(radii) for a, b in circle_points(r)))
    rows = px.where("abs(v) > 2.220446049250313e-16").select("image_id", "h", "w", "y", "x", F.explode(offsets).alias("o"))
    at = rows.select("image_id", "h", "w", c("o.i").alias("radius_ix"), (c("y") + c("o.dy")).alias("y"), (c("x") + c("o.dx")).alias("x"))
    at = at.where(c("y").between(0, c("h") - 1) & c("x").between(0, c("w") - 1))
    return at.groupBy("image_id", "radius_ix", "y", "x").agg(F.count("*").alias("votes"))
