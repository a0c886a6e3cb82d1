"""Drawing: generators of cells, and painting them on images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shapes import Point, circle_points, ellipse_points
from ..plans.frames import PIXEL

c = F.col


def lines(segments: DataFrame) -> DataFrame:
    """Cells of segments (y1, x1, y2, x2 and any keys), in order (i): a generator, no join and no Python.

    Along the longer way the other coordinate is rounded, halves forwards.
    """
    dy, dx = F.abs(c("y2") - c("y1")), F.abs(c("x2") - c("x1"))
    n = F.greatest(dy, dx)
    rows = segments.select("*", F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("i"))
    sy, sx = (F.when(c(f"{a}2") > c(f"{a}1"), 1).otherwise(-1) for a in "yx")
    short = lambda d: F.when(n == 0, 0).otherwise(F.floor((2 * d * c("i") + n) / (2 * n))).cast("int")
    steep = dy > dx
    y = c("y1") + sy * F.when(steep, c("i")).otherwise(short(dy))
    x = c("x1") + sx * F.when(steep, short(dx)).otherwise(c("i"))
    return rows.select(*(k for k in segments.columns if k not in ("y1", "x1", "y2", "x2")), "i", y.cast("int").alias("y"), x.cast("int").alias("x"))


def _around(centres: DataFrame, offsets: Sequence[Point]) -> DataFrame:
    array = F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in dict.fromkeys(offsets)))
    rows = centres.withColumn("o", F.explode(array))
    return rows.withColumns({"y": c("y") + c("o.dy"), "x": c("x") + c("o.dx")}).drop("o")


def circles(centres: DataFrame, radius: int) -> DataFrame:
    """Cells of circles about centres (y, x and any keys)."""
    return _around(centres, circle_points(radius))


def ellipses(centres: DataFrame, a: int, b: int) -> DataFrame:
    return _around(centres, ellipse_points(a, b))


def paint(px: DataFrame, cells: DataFrame, value: float = 255.0) -> DataFrame:
    """``px`` with the cells (image_id, y, x) set; those outside are left out. A union and an aggregate, no join."""
    inked = cells.select("image_id", "y", "x", F.lit(float(value)).alias("ink"))
    marks = px.select(*PIXEL, "v", F.lit(None).cast("double").alias("ink")).unionByName(inked, allowMissingColumns=True)
    out = marks.groupBy("image_id", "y", "x").agg(F.max("h").alias("h"), F.max("w").alias("w"), F.max("v").alias("v"), F.max("ink").alias("ink")).where("h is not null")
    return out.select(*PIXEL, F.coalesce("ink", "v").alias("v"))


#: Stamps of at most 7 cells a side.
SHAPES = {"CIRCLE": circle_points(3), "SQUARE": [(a, b) for a in range(-3, 4) for b in range(-3, 4) if max(abs(a), abs(b)) == 3], "CROSS": [(a, b) for a in range(-3, 4) for b in range(-3, 4) if a == 0 or b == 0]}


def mark_points(px: DataFrame, points: DataFrame, shape: str = "CIRCLE", colour: tuple[float, float, float] = (255.0, 0.0, 0.0)) -> DataFrame:
    """Gray or colour images as colour images with a stamp on each point (image_id, y, x); stamps are cut at the border."""
    if "v" in px.columns:
        px = px.withColumns({n: c("v") for n in "rgb"}).drop("v")
    inked = _around(points.select("image_id", "y", "x"), SHAPES[shape]).select("image_id", "y", "x", F.lit(True).alias("m")).distinct()
    at = px.join(inked, ["image_id", "y", "x"], "left")
    pick = lambda n, k: F.when(c("m"), float(k)).otherwise(c(n)).alias(n)
    return at.select(*PIXEL, *(pick(n, k) for n, k in zip("rgb", colour, strict=True)))


def inside_hull(edges: Column, y: Column, x: Column) -> Column:
    """Whether (y, x) lies in or on a hull given as an array of edges (y0, x0, y1, x1); false where there is none.

    All turns have one sign; the box settles hulls that are a point or a stretch.
    """
    side = lambda e: (e["x1"] - e["x0"]) * (y - e["y0"]) - (e["y1"] - e["y0"]) * (x - e["x0"])
    ys, xs = (F.transform(edges, lambda e: e["y0"]), F.transform(edges, lambda e: e["x0"]))
    box = y.between(F.array_min(ys), F.array_max(ys)) & x.between(F.array_min(xs), F.array_max(xs))
    return F.coalesce(box & (F.forall(edges, lambda e: side(e) >= 0) | F.forall(edges, lambda e: side(e) <= 0)), F.lit(False))
