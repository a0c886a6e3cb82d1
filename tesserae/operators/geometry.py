"""Resampling, warps and pyramids: every output cell is a weighted sum of input cells.

Coordinates and interpolation weights are expressions over the output grid; the
input is joined once on the cells they name, and one aggregation sums the taps.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.borders import fit
from ..plans.frames import PIXEL, images_of
from . import neighbourhood as N

c = F.col
Matrix = Sequence[Sequence[float]]


def weights(p: Column, order: int) -> list[tuple[Column, Column]]:
    """(index, weight) of an interpolation at coordinate p along one axis: nearest, linear, quadratic, cubic."""
    if order not in (0, 1, 2, 3):
        raise ValueError("order must be 0, 1, 2 or 3")
    p = F.round(p, 9)
    odd = order % 2 == 1
    near = F.floor(p) if odd else F.floor(p + 0.5)
    base, d = near - order // 2, p - near
    w = {
        0: [F.lit(1.0)],
        1: [1 - d, d],
        2: [(d * d - d) / 2, 1 - d * d, (d * d + d) / 2],
        3: [(-d + 2 * d * d - d * d * d) / 2, (2 - 5 * d * d + 3 * d * d * d) / 2, (d + 4 * d * d - 3 * d * d * d) / 2, (-d * d + d * d * d) / 2],
    }[order]
    return [((base + k).cast("int"), x) for k, x in enumerate(w)]


def sampled(cells: DataFrame, px: DataFrame, order: int, mode: str = "constant", value: float = 0.0) -> DataFrame:
    """Cells (image_id, h, w, y, x, ih, iw, sy, sx) read the image at (sy, sx); ih, iw are its size."""
    taps = lambda at, n, o: F.array(*(F.struct(fit(i, c(n), mode).cast("int").alias("i"), wt.alias("wt")) for i, wt in weights(c(at), o)))
    rows = cells.withColumn("ty", F.explode(taps("sy", "ih", order))).withColumn("tx", F.explode(taps("sx", "iw", order)))
    rows = rows.select(*PIXEL, c("ty.i").alias("iy"), c("tx.i").alias("ix"), (c("ty.wt") * c("tx.wt")).alias("wt")).where("abs(wt) > 1e-12")
    source = px.select("image_id", c("y").alias("iy"), c("x").alias("ix"), "v")
    read = rows.join(source, ["image_id", "iy", "ix"], "left")
    return read.groupBy(*PIXEL).agg(F.sum(c("wt") * F.coalesce("v", F.lit(float(value)))).alias("v"))


def map_coordinates(px: DataFrame, points: DataFrame, order: int = 1, mode: str = "constant", value: float = 0.0) -> DataFrame:
    """``points`` (image_id, y, x and further columns) with v, the image's value interpolated there.

    Points need not be distinct; those of an image that is not there are left out.
    """
    at = points.select(F.struct(*points.columns).alias("point"), "image_id", c("y").cast("double").alias("sy"), c("x").cast("double").alias("sx"))
    taps = lambda n, size: F.array(*(F.struct(fit(i, c(size), mode).cast("int").alias("i"), w.alias("w")) for i, w in weights(c(n), order)))
    places = at.select("image_id", "sy", "sx").distinct().join(images_of(px), "image_id")
    read = places.withColumn("ty", F.explode(taps("sy", "h"))).withColumn("tx", F.explode(taps("sx", "w")))
    read = read.select("image_id", "sy", "sx", c("ty.i").alias("y"), c("tx.i").alias("x"), (c("ty.w") * c("tx.w")).alias("wt"))
    found = read.join(px.select("image_id", "y", "x", "v"), ["image_id", "y", "x"], "left").groupBy("image_id", "sy", "sx")
    found = found.agg(F.sum(c("wt") * F.coalesce("v", F.lit(float(value)))).alias("v"))
    return at.join(found, ["image_id", "sy", "sx"]).select("point.*", "v")


def _canvas(px: DataFrame, h: Column | int, w: Column | int) -> DataFrame:
    h, w = (x if isinstance(x, Column) else F.lit(x) for x in (h, w))
    sizes = images_of(px).select("image_id", h.cast("int").alias("nh"), w.cast("int").alias("nw"), c("h").alias("ih"), c("w").alias("iw")).where("nh > 0 AND nw > 0")
    rows = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), c("nh") - 1)))
    return rows.select("image_id", c("nh").alias("h"), c("nw").alias("w"), "y", F.explode(F.sequence(F.lit(0), c("nw") - 1)).alias("x"), "ih", "iw")


def resize(px: DataFrame, shape: tuple[int, int], order: int = 1, anti_alias: bool | None = None, sigma: float | None = None, mode: str = "constant", value: float = 0.0, size: tuple[int, int] | None = None) -> DataFrame:
    """Corners map to corners. ``size`` is the input's, needed for anti-aliasing (by default on where an axis shrinks and order > 0)."""
    if size and (anti_alias if anti_alias is not None else order > 0 and any(o < i for o, i in zip(shape, size, strict=True))):
        factors = [(i - 1) / max(1, o - 1) for o, i in zip(shape, size, strict=True)]
        spread = max(0.0, max((f - 1) / 2 for f in factors)) if sigma is None else sigma
        for axis, f in enumerate(factors):
            if f > 1 and spread > 0:
                px = N.convolve_line(px, K.gaussian_line(spread), axis, mode, value)
    step = lambda n, o: (c(n) - 1) / (o - 1) if o > 1 else F.lit(0.0)
    cells = _canvas(px, *shape).withColumns({"sy": c("y") * step("ih", shape[0]), "sx": c("x") * step("iw", shape[1])})
    return sampled(cells, px, order, mode, value)


# Transforms are 3x3 matrices in (x, y) order, as rows of floats.


def times(a: Matrix, b: Matrix) -> list[list[float]]:
    return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]


def inverse(m: Matrix) -> list[list[float]]:
    (a, b, d), (e, f, g), (h, i, j) = m
    det = a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)
    rows = ((f * j - g * i, d * i - b * j, b * g - d * f), (g * h - e * j, a * j - d * h, d * e - a * g), (e * i - f * h, b * h - a * i, a * f - b * e))
    return [[x / det for x in r] for r in rows]


def rigid(rotation: float = 0.0, translation: tuple[float, float] = (0.0, 0.0)) -> list[list[float]]:
    return similarity(rotation, translation, 1.0)


def similarity(rotation: float = 0.0, translation: tuple[float, float] = (0.0, 0.0), scale: float = 1.0) -> list[list[float]]:
    """Rotation in degrees."""
    t = math.radians(rotation)
    return [[scale * math.cos(t), -scale * math.sin(t), translation[0]], [scale * math.sin(t), scale * math.cos(t), translation[1]], [0.0, 0.0, 1.0]]


def affine(rotation: float = 0.0, translation: tuple[float, float] = (0.0, 0.0), scale: tuple[float, float] = (1.0, 1.0), shear: tuple[float, float] = (0.0, 0.0)) -> list[list[float]]:
    """Rotation in degrees, shear in radians."""
    t = math.radians(rotation)
    (sx, sy), (kx, ky) = scale, shear
    co, si = math.cos(t), math.sin(t)
    return [[sx * (co + math.tan(ky) * -si), sy * (math.tan(kx) * co - si), translation[0]], [sx * (si + math.tan(ky) * co), sy * (math.tan(kx) * si + co), translation[1]], [0.0, 0.0, 1.0]]


def mapped(matrix: Matrix, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a projective matrix; a zero divisor counts as 1e-15."""
    px, py, pw = (F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) for r in matrix)
    pw = F.when(pw == 0, 1e-15).otherwise(pw)
    return px / pw, py / pw


def transform_points(points: DataFrame, matrix: Matrix) -> DataFrame:
    """Points with columns x and y through a matrix."""
    x, y = mapped(matrix, c("x"), c("y"))
    return points.withColumns({"x": x, "y": y})


def warp(px: DataFrame, matrix: Matrix, order: int = 1, shape: tuple[int, int] | None = None, mode: str = "constant", value: float = 0.0) -> DataFrame:
    """Inverse warp: each output cell reads the input where the matrix puts it."""
    cells = _canvas(px, *(shape or (c("h"), c("w"))))
    x, y = mapped(matrix, c("x").cast("double"), c("y").cast("double"))
    return sampled(cells.withColumns({"sx": x, "sy": y}), px, order, mode, value)


def rotation(angle: float, size: tuple[int, int], reshape: bool = True) -> tuple[list[list[float]], tuple[int, int]]:
    """Matrix and canvas that turn images of a size by degrees about their centre; with ``reshape`` the canvas holds all corners."""
    h, w = size
    centre = ((w - 1) / 2, (h - 1) / 2)
    m = times(times(rigid(0, centre), rigid(angle)), rigid(0, (-centre[0], -centre[1])))
    if not reshape:
        return m, (h, w)
    back = inverse(m)
    corners = [(back[0][0] * x + back[0][1] * y + back[0][2], back[1][0] * x + back[1][1] * y + back[1][2]) for x in (0, w - 1) for y in (0, h - 1)]
    low, high = ([f(p[k] for p in corners) for k in (0, 1)] for f in (min, max))
    return times(m, rigid(0, (low[0], low[1]))), (int(high[1] - low[1] + 0.5), int(high[0] - low[0] + 0.5))


def rotate(px: DataFrame, angle: float, size: tuple[int, int], order: int = 1, reshape: bool = True, mode: str = "constant", value: float = 0.0) -> DataFrame:
    m, shape = rotation(angle, size, reshape)
    return warp(px, m, order, shape, mode, value)


# Pyramids.


def _halved(px: DataFrame, size: tuple[int, int], factor: float, order: int, mode: str, value: float) -> tuple[DataFrame, tuple[int, int]]:
    shape = tuple(max(1, int(n * factor + 0.5)) for n in size)
    if order > 0 and factor < 1:
        px = _blurred(px, (1 / factor - 1) / 2, mode, value)
    return resize(px, shape, order, anti_alias=False, mode=mode, value=value), shape


def _blurred(px: DataFrame, sigma: float, mode: str, value: float) -> DataFrame:
    return N.gaussian_filter(px, sigma, mode=mode, value=value) if sigma > 0 else px


def _layers(n: int, size: tuple[int, int], factor: float) -> int:
    return n if n > 0 else 1 if factor >= 1 else max(1, min(int(math.log2(s * factor / 16 + 1)) for s in size))


@dataclass
class Layer:
    """The steps of pyramids by themselves, with what they depend on as attributes that can be set between them.

    ``size`` is that of the images that come next; ``rescale`` and ``reduce`` move it on.
    """

    size: tuple[int, int]
    factor: float = 0.5
    sigma: float = 1.0
    order: int = 0
    mode: str = "symmetric"
    value: float = 0.0

    def scale(self, px: DataFrame) -> DataFrame:
        """Smooth by ``sigma``."""
        return _blurred(px, self.sigma, self.mode, self.value)

    def rescale(self, px: DataFrame) -> DataFrame:
        """Resample by ``factor``, smoothed first if that shrinks and interpolates."""
        px, self.size = _halved(px, self.size, self.factor, self.order, self.mode, self.value)
        return px

    def reduce(self, px: DataFrame) -> DataFrame:
        """The next level of a Gaussian pyramid: resample, then smooth."""
        return self.scale(self.rescale(px))


def _stacked(levels: Iterable[DataFrame]) -> DataFrame:
    out = None
    for k, px in enumerate(levels):
        px = px.withColumn("level", F.lit(k))
        out = px if out is None else out.unionByName(px)
    return out


def gaussian_pyramid(px: DataFrame, size: tuple[int, int], sigma: float = 1.0, n_layers: int = -1, factor: float = 0.5, order: int = 0, mode: str = "symmetric", value: float = 0.0) -> DataFrame:
    """Levels of smoothed, then rescaled and smoothed images, with a column level."""
    out = [_blurred(px, sigma, mode, value)]
    for _ in range(_layers(n_layers, size, factor) - 1):
        px, size = _halved(out[-1], size, factor, order, mode, value)
        out.append(_blurred(px, sigma, mode, value))
    return _stacked(out)


def laplacian_pyramid(px: DataFrame, size: tuple[int, int], sigma: float = 1.0, n_layers: int = -1, factor: float = 0.5, order: int = 0, mode: str = "symmetric", value: float = 0.0) -> DataFrame:
    """Each level less its own smoothed form."""
    smooth = _blurred(px, sigma, mode, value)
    out = [N._minus(px, smooth)]
    for _ in range(_layers(n_layers, size, factor) - 1):
        px, size = _halved(smooth, size, factor, order, mode, value)
        smooth = _blurred(px, sigma, mode, value)
        out.append(N._minus(px, smooth))
    return _stacked(out)


def scale_space(px: DataFrame, size: tuple[int, int], scales: Sequence[float], n_layers: int = -1, factor: float = 0.5, order: int = 0, rescale_index: int = -1, mode: str = "symmetric", value: float = 0.0) -> DataFrame:
    """Octaves (level) of images blurred step by step (scale_ix, 0 is the octave's input)."""
    octaves = []
    for k in range(_layers(n_layers, size, factor)):
        stack = [px]
        for s in scales:
            stack.append(_blurred(stack[-1], s, mode, value))
        octaves += [p.withColumns({"level": F.lit(k), "scale_ix": F.lit(i)}) for i, p in enumerate(stack)]
        if k + 1 < _layers(n_layers, size, factor):
            px, size = _halved(stack[rescale_index], size, factor, order, mode, value)
    out = octaves[0]
    for p in octaves[1:]:
        out = out.unionByName(p)
    return out


def dog_pyramid(px: DataFrame, size: tuple[int, int], scales: Sequence[float], n_layers: int = -1, **options) -> DataFrame:
    """Differences of neighbouring scales; one octave more than the scale space."""
    n = _layers(n_layers, size, options.get("factor", 0.5)) + 1
    s = scale_space(px, size, scales, n, **options)
    both = s.unionByName(s.withColumns({"scale_ix": c("scale_ix") + 1, "v": -c("v")}))
    out = both.groupBy(*PIXEL, "level", "scale_ix").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    return out.where("n = 2").withColumn("scale_ix", c("scale_ix") - 1).drop("n")


def mosaic(levels: DataFrame) -> DataFrame:
    """Levels side by side on one canvas: shifts by the widths before, from an aggregate of one row for each level."""
    sizes = levels.groupBy("image_id", "level").agg(F.first("w").alias("lw"), F.first("h").alias("lh"))
    by = sizes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("level", "lw"))).alias("ls"), F.sum("lw").cast("int").alias("cw"), F.max("lh").alias("ch"))
    at = levels.join(by, "image_id")
    shift = F.aggregate(F.filter("ls", lambda e: e["level"] < c("level")), F.lit(0), lambda a, e: a + e["lw"])
    return at.select("image_id", c("ch").alias("h"), c("cw").alias("w"), "y", (c("x") + shift).alias("x"), "v")
