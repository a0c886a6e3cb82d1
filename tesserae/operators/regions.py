"""Measurements of regions: bounding boxes, moments, properties, perimeters, co-occurrence. One aggregation each."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.frames import PIXEL, stored
from . import neighbourhood as N
from .labels import fill_holes
from .spatial import convex_hull, hull_contains

c = F.col
REGION = ["image_id", "label"]


def find_objects(labels: DataFrame) -> DataFrame:
    """Inclusive bounding boxes of labels 1, 2, ...: y0, x0, y1, x1."""
    return labels.where("label > 0").groupBy(*REGION).agg(F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))


def boxes(objects: DataFrame) -> DataFrame:
    """Further columns of boxes: centroid, its local form, their rounded points, area and half-open ends."""
    cy, cx = (c("y0") + c("y1")) / 2, (c("x0") + c("x1")) / 2
    ly, lx = (c("y1") - c("y0")) / 2, (c("x1") - c("x0")) / 2
    area = (c("y1") - c("y0") + 1) * (c("x1") - c("x0") + 1)
    more = {"cy": cy, "cx": cx, "ly": ly, "lx": lx, "py": F.floor(cy).cast("int"), "px": F.floor(cx).cast("int"), "box_area": area.cast("long"), "y_end": c("y1") + 1, "x_end": c("x1") + 1}
    return objects.withColumns(more)


def cropped(px: DataFrame, objects: DataFrame) -> DataFrame:
    """The pixels of each object's box, with coordinates local to it."""
    at = px.join(objects, "image_id").where(c("y").between(c("y0"), c("y1")) & c("x").between(c("x0"), c("x1")))
    return at.withColumns({"h": c("y1") - c("y0") + 1, "w": c("x1") - c("x0") + 1, "y": c("y") - c("y0"), "x": c("x") - c("x0")}).drop("y0", "x0", "y1", "x1")


def moments(px: DataFrame, order: int = 3, centre: tuple[float, float] | None = None, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """m_pq = sum v (y - cy)^p (x - cx)^q for p, q up to ``order``, in one pass."""
    cy, cx = centre or (0.0, 0.0)
    power = lambda at, o, k: F.lit(1.0) if k == 0 else F.pow(c(at) - o, F.lit(k))
    return px.groupBy(*by).agg(*(F.sum(c("v") * power("y", cy, p) * power("x", cx, q)).alias(f"m{p}{q}") for p in range(order + 1) for q in range(order + 1)))


#: Weights of the perimeter codes.
PERIMETER = {**dict.fromkeys((5, 7, 15, 17, 25, 27), 1.0), **dict.fromkeys((21, 33), math.sqrt(2)), **dict.fromkeys((13, 23), (1 + math.sqrt(2)) / 2)}
CODES = ((10, 2, 10), (2, 1, 2), (10, 2, 10))


def perimeter(px: DataFrame) -> DataFrame:
    """Perimeter of each image's foreground, from the neighbourhood codes of its inner edge."""
    edge = N.binary_edge(px.withColumn("v", (c("v") != 0).cast("double")), "inner")
    weight = F.create_map(*(F.lit(x) for kv in PERIMETER.items() for x in kv))
    codes = N.convolve(edge, CODES).groupBy("image_id", c("v").cast("int").alias("code")).agg(F.count("*").alias("n"))
    return codes.groupBy("image_id").agg(F.sum(c("n") * F.coalesce(weight[c("code")], F.lit(0.0))).alias("perimeter"))


def region_properties(labels: DataFrame, intensity: DataFrame | None = None) -> DataFrame:
    """One row for each region: area, box, centroid, second moments, and with an image its range and mean. Columns not asked for cost nothing."""
    rows = labels.where("label > 0")
    more = []
    if intensity is not None:
        rows = rows.join(intensity.select("image_id", "y", "x", "v"), ["image_id", "y", "x"])
        more = [F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean")]
    y, x = c("y").cast("double"), c("x").cast("double")
    sums = [F.count("*").alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1")]
    sums += [F.avg(y).alias("cy"), F.avg(x).alias("cx"), F.sum(y * y).alias("syy"), F.sum(y * x).alias("syx"), F.sum(x * x).alias("sxx")]
    out = rows.groupBy(*REGION).agg(*sums, *more)
    central = {"mu20": c("syy") - c("area") * c("cy") * c("cy"), "mu11": c("syx") - c("area") * c("cy") * c("cx"), "mu02": c("sxx") - c("area") * c("cx") * c("cx")}
    box = (c("y1") - c("y0") + 1) * (c("x1") - c("x0") + 1)
    return out.withColumns({**central, "box_area": box.cast("long"), "local_cy": c("cy") - c("y0"), "local_cx": c("cx") - c("x0")}).drop("syy", "syx", "sxx")


def _numbers(labels: DataFrame) -> DataFrame:
    """A number for each region (image_id, label), stored, so that it is the same in every job."""
    return stored(labels.where("label > 0").select("image_id", "label").distinct().withColumn("set_id", F.monotonically_increasing_id()), "regions")


def region_shapes(labels: DataFrame) -> DataFrame:
    """Perimeter, filled area, euler number (area less filled area) and circularity, each within the region's own box."""
    crops = cropped(labels.withColumnRenamed("label", "at"), find_objects(labels))
    # Each region is an image of its own: its cells by themselves, everything else background.
    one = crops.join(_numbers(labels), ["image_id", "label"])
    one = one.select(c("set_id").alias("image_id"), c("image_id").alias("i"), "label", "h", "w", "y", "x", (c("at") == c("label")).cast("double").alias("v"))
    names = one.groupBy("image_id", "i", "label").agg(F.sum("v").cast("long").alias("area"))
    px = one.select(*PIXEL, "v")
    filled = fill_holes(px).groupBy("image_id").agg(F.sum("v").cast("long").alias("area_filled"))
    out = names.join(perimeter(px), "image_id").join(filled, "image_id")
    ratio = F.pow("perimeter", F.lit(2)) / (4 * math.pi * c("area_filled"))
    return out.select(c("i").alias("image_id"), "label", "area", "area_filled", "perimeter", (c("area") - c("area_filled")).alias("euler_number"), ratio.alias("circularity"))


def region_hulls(labels: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Area, convex hull (its number of corners) and cells within the hull (area_convex) of each region, of its cells where
    ``mask`` (image_id, y, x, m) is on; regions without such cells are left out."""
    if mask is not None:
        labels = labels.join(mask.where("m <> 0").select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi")
    numbers = _numbers(labels)
    cells = labels.join(numbers, ["image_id", "label"])
    names = cells.groupBy("set_id", "image_id", "label").agg(F.count("*").alias("area"))
    corners = convex_hull(cells.select("set_id", "y", "x"))
    boxes_ = find_objects(labels).join(numbers, ["image_id", "label"])
    grid_ = boxes_.select("set_id", F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1").select("set_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    inside = hull_contains(corners, grid_).groupBy("set_id").agg(F.sum(c("inside").cast("long")).alias("area_convex"))
    n = corners.groupBy("set_id").agg(F.count("*").alias("n_corners"))
    return names.join(inside, "set_id").join(n, "set_id").select("image_id", "label", "area", "area_convex", "n_corners")


def _half_away(x: float) -> int:
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def glcm(px: DataFrame, distances: Sequence[float], angles: Sequence[float], symmetric: bool = False, normalise: bool = False) -> DataFrame:
    """Counts of value pairs (i, j) at each distance and angle (radians), sparse: a join per cell pair, then a count."""
    shifts = [(d, a, _half_away(r * math.sin(t)), _half_away(r * math.cos(t))) for d, r in enumerate(distances) for a, t in enumerate(angles)]
    taps = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(a).alias("a"), F.lit(sy).alias("sy"), F.lit(sx).alias("sx")) for d, a, sy, sx in shifts))
    v = c("v").cast("int")
    left = px.select("image_id", "y", "x", v.alias("i"), F.explode(taps).alias("s")).select("image_id", (c("y") + c("s.sy")).alias("y"), (c("x") + c("s.sx")).alias("x"), "i", "s.d", "s.a")
    pairs = left.join(px.select("image_id", "y", "x", v.alias("j")), ["image_id", "y", "x"])
    if symmetric:
        pairs = pairs.select("image_id", "d", "a", F.explode(F.array(F.struct("i", "j"), F.struct(c("j").alias("i"), c("i").alias("j")))).alias("e")).select("image_id", "d", "a", "e.*")
    out = pairs.groupBy("image_id", "d", "a", "i", "j").agg(F.count("*").alias("n"))
    if not normalise:
        return out
    total = out.groupBy("image_id", "d", "a").agg(F.sum("n").alias("total"))
    return out.join(total, ["image_id", "d", "a"]).withColumn("p", c("n") / c("total")).drop("total", "n")


def glcm_props(p: DataFrame) -> DataFrame:
    """Contrast, angular second moment, inverse difference moment and correlation of normalised co-occurrences."""
    i, j, q = c("i").cast("double"), c("j").cast("double"), c("p")
    s = p.groupBy("image_id", "d", "a").agg(
        F.sum(F.pow(i - j, F.lit(2)) * q).alias("contrast"), F.sum(q * q).alias("asm"), F.sum(q / (1 + F.pow(i - j, F.lit(2)))).alias("idm"),
        F.sum(i * q).alias("mi"), F.sum(j * q).alias("mj"), F.sum(i * i * q).alias("ii"), F.sum(j * j * q).alias("jj"), F.sum(i * j * q).alias("ij"),
    )
    si, sj = F.sqrt(F.greatest(c("ii") - c("mi") * c("mi"), F.lit(0.0))), F.sqrt(F.greatest(c("jj") - c("mj") * c("mj"), F.lit(0.0)))
    cor = F.when((si < 1e-9) | (sj < 1e-9), 1.0).otherwise((c("ij") - c("mi") * c("mj")) / (si * sj))
    return s.withColumn("cor", cor).select("image_id", "d", "a", "contrast", "asm", "idm", "cor")
