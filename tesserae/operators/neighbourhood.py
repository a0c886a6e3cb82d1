"""Neighbourhood operators: filters, edges and gray, binary and rank morphology.

Every pixel sends its value to the cells that have it as a neighbour, and each cell
aggregates what it got: one shuffle, with partial aggregation before it, and no
join. Border modes are a padding of the image by copies of its own pixels, made
without a shuffle either.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.borders import MODES, fit
from ..plans import tiles
from ..plans.frames import PIXEL, inside, stored

c = F.col


def _copies(at: str, n: str, low: int, high: int, mode: str) -> Column:
    """Where along an axis a pixel stands: its own place, and border cells that it fills."""
    i, size = c(at), c(n)
    near = F.concat(F.sequence(F.lit(-low), F.lit(-1)) if low else F.array().cast("array<int>"), F.transform(F.sequence(F.lit(0), F.lit(high - 1)), lambda k: k + size) if high else F.array().cast("array<int>"))
    return F.concat(F.array(i), F.filter(near, lambda j: fit(j, size, mode).cast("int") == i))


def pad(px: DataFrame, top: int, bottom: int, left: int, right: int, mode: str = "constant", value: float = 0.0) -> DataFrame:
    """Adds rows outside the image (y, x from -top, -left), as the border mode says."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode == "valid" or not any((top, bottom, left, right)):
        return px
    if mode != "constant":
        rows = px.withColumn("y", F.explode(_copies("y", "h", top, bottom, mode)))
        return rows.withColumn("x", F.explode(_copies("x", "w", left, right, mode)))
    images = px.select("image_id", "h", "w").distinct()
    frame = images.select("*", F.explode(F.sequence(F.lit(-top), c("h") + bottom - 1)).alias("y")).select("*", F.explode(F.sequence(F.lit(-left), c("w") + right - 1)).alias("x"))
    others = [F.lit(float(value)).alias(n) for n in px.columns if n not in PIXEL]
    return px.unionByName(frame.where(~inside()).select(*PIXEL, *others))


def border_mask(px: DataFrame, rows: int, columns: int) -> DataFrame:
    """1 on the frame that kernels of this size reach over (half the size, rounded down), else 0; a side of 1 has none."""
    ry, rx = rows // 2, columns // 2
    framed = (c("y") < ry) | (c("y") >= c("h") - ry) | (c("x") < rx) | (c("x") >= c("w") - rx)
    return px.withColumn("v", framed.cast("double"))


def neighbours(px: DataFrame, taps: Sequence[K.Tap], mode: str = "constant", value: float = 0.0, pad_zeros: bool = True) -> DataFrame:
    """Rows (image_id, h, w, y, x, wt, ... values): for each cell, its taps' weights and what they read.

    In mode ``valid`` the cells whose taps leave the image are not there. With
    ``pad_zeros`` off, constant borders send nothing, which sums do not miss.
    """
    dys, dxs = [t[0] for t in taps] or [0], [t[1] for t in taps] or [0]
    top, bottom, left, right = max(0, -min(dys)), max(0, max(dys)), max(0, -min(dxs)), max(0, max(dxs))
    if mode != "constant" or pad_zeros or value:
        px = pad(px, top, bottom, left, right, mode, value)
    kernel = F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(float(w)).alias("wt")) for a, b, w in taps))
    rows = px.withColumn("tap", F.explode(kernel)).withColumns({"y": c("y") - c("tap.dy"), "x": c("x") - c("tap.dx"), "wt": c("tap.wt")}).drop("tap")
    if mode == "valid":
        return rows.where(c("y").between(top, c("h") - 1 - bottom) & c("x").between(left, c("w") - 1 - right))
    return rows.where(inside())


def gathered(px: DataFrame, taps: Sequence[K.Tap], mode: str, value: float = 0.0, pad_zeros: bool = True, **columns: Column) -> DataFrame:
    return neighbours(px, taps, mode, value, pad_zeros).groupBy(*PIXEL).agg(*(e.alias(n) for n, e in columns.items()))


def convolve(px: DataFrame, kernel: K.Kernel, anchor=None, mode: str = "constant", value: float = 0.0, dilation: int = 1, stride: int | None = None) -> DataFrame:
    """Convolution (the kernel is turned by half a turn); a stride is refused."""
    if stride not in (None, 1):
        raise RuntimeError("stride is not supported")
    taps = K.taps(kernel, anchor, dilation=dilation)
    if not taps:
        return px.withColumn("v", F.lit(0.0))
    return gathered(px, taps, mode, value, pad_zeros=bool(value), v=F.sum(c("wt") * c("v")))


def convolve_line(px: DataFrame, line: Sequence[float], axis: int, mode: str = "constant", value: float = 0.0) -> DataFrame:
    return convolve(px, [[w] for w in line] if axis == 0 else [list(line)], mode=mode, value=value)


image_filter = convolve


def _tiled(px: DataFrame, taps: Sequence[K.Tap], mode: str, value: float, kernel: Callable[[int, int], Callable]) -> DataFrame:
    """A function of the cells that the taps read, over tiles with borders: a pixel is sent a bounded number of times, whatever the footprint."""
    dys, dxs = [t[0] for t in taps], [t[1] for t in taps]
    top, bottom, left, right = max(0, -min(dys)), max(0, *dys), max(0, -min(dxs)), max(0, *dxs)
    return tiles.over_tiles(pad(px, top, bottom, left, right, mode, value), (top, bottom, left, right), kernel(top, left), mode == "valid")


def rank_filter(px: DataFrame, footprint: K.Kernel, rank: int, anchor=None, mode: str = "constant", value: float = 0.0) -> DataFrame:
    """The rank-th smallest (from 1) under the footprint, which is not turned."""
    taps = K.taps(footprint, anchor, flip=False)
    if not 1 <= rank <= len(taps):
        raise ValueError(f"rank must be from 1 to {len(taps)}")
    return _tiled(px, taps, mode, value, lambda top, left: tiles.ranked([t[:2] for t in taps], rank, top, left))


def median_filter(px: DataFrame, footprint: K.Kernel, mode: str = "constant", value: float = 0.0) -> DataFrame:
    """Rank n // 2 of n, counted from 1: one below the middle where n is odd."""
    return rank_filter(px, footprint, len(K.taps(footprint, flip=False)) // 2, mode=mode, value=value)


def gaussian_filter(px: DataFrame, sigma: float | tuple[float, float], truncate: float = 3.0, mode: str = "reflect", value: float = 0.0) -> DataFrame:
    """Two passes of a line: 2(2r+1) rows a pixel instead of (2r+1)^2."""
    sy, sx = sigma if isinstance(sigma, tuple) else (sigma, sigma)
    return convolve_line(convolve_line(px, K.gaussian_line(sy, truncate), 0, mode, value), K.gaussian_line(sx, truncate), 1, mode, value)


def _mean_taps(footprint: K.Kernel) -> list[K.Tap]:
    taps = K.taps(footprint)
    total = sum(t[2] for t in taps)
    return [(a, b, w / total) for a, b, w in taps]


def mean_filter(px: DataFrame, footprint: K.Kernel, mode: str = "constant", value: float = 0.0) -> DataFrame:
    taps = _mean_taps(footprint)
    return _tiled(px, taps, mode, value, lambda top, left: tiles.weighted(taps, top, left))


def variance_filter(px: DataFrame, footprint: K.Kernel, mode: str = "constant", value: float = 0.0) -> DataFrame:
    taps = _mean_taps(footprint)

    def kernel(top: int, left: int):
        mean = tiles.weighted(taps, top, left)
        return lambda a: mean(a * a) - mean(a) ** 2

    return _tiled(px, taps, mode, value, kernel)


def _by_lines(px: DataFrame, footprint: K.Kernel, mode: str, value: float, v: Column) -> DataFrame:
    """Least or greatest value under a footprint; a whole box is two passes over lines, so that a cell sends h + w rows and not h * w."""
    h, w = len(footprint), len(footprint[0])
    if min(h, w) < 2 or not all(all(r) for r in footprint):
        return gathered(px, K.taps(footprint), mode, value, v=v)
    return gathered(gathered(px, K.taps(K.box(h, 1)), mode, value, v=v), K.taps(K.box(1, w)), mode, value, v=v)


def local_min_filter(px: DataFrame, footprint: K.Kernel, mode: str = "reflect", value: float = 0.0) -> DataFrame:
    return _by_lines(px, footprint, mode, value, F.min("v"))


def local_max_filter(px: DataFrame, footprint: K.Kernel, mode: str = "reflect", value: float = 0.0) -> DataFrame:
    return _by_lines(px, footprint, mode, value, F.max("v"))


def _edge_taps(name: str, normalise: bool = True) -> list[tuple[int, int, float, float]]:
    wy, wx = ({(a, b): w for a, b, w in K.taps(K.edge(name, axis, normalise))} for axis in (0, 1))
    return [(*k, wy.get(k, 0.0), wx.get(k, 0.0)) for k in sorted(wy.keys() | wx.keys())]


def gradients(px: DataFrame, name: str = "sobel", mode: str = "symmetric", value: float = 0.0, normalise: bool = True) -> DataFrame:
    """gy and gx of every pixel, from one gather."""
    taps = _edge_taps(name, normalise)
    numbered = [(a, b, i) for i, (a, b, *_) in enumerate(taps)]
    weight = lambda k: F.element_at(F.array(*(F.lit(float(t[k])) for t in taps)), c("wt").cast("int") + 1) * c("v")
    return gathered(px, numbered, mode, value, pad_zeros=bool(value), gy=F.sum(weight(2)), gx=F.sum(weight(3)))


def edge_filter(px: DataFrame, name: str = "sobel", axis: int | None = None, mode: str = "symmetric", value: float = 0.0) -> DataFrame:
    """Derivative along an axis, or the root mean square of both; constant borders set the frame aside."""
    g = gradients(px, name, mode, value)
    v = {0: c("gy"), 1: c("gx"), None: F.sqrt((c("gy") * c("gy") + c("gx") * c("gx")) / 2)}[axis]
    out = g.withColumn("v", v).drop("gy", "gx")
    if mode != "constant":
        return out
    framed = (c("y") == 0) | (c("x") == 0) | (c("y") == c("h") - 1) | (c("x") == c("w") - 1)
    return out.withColumn("v", F.when(framed, 0.0).otherwise(c("v")))


def sobel(px: DataFrame, axis: int | None = None, mode: str = "symmetric", value: float = 0.0) -> DataFrame:
    return edge_filter(px, "sobel", axis, mode, value)


def prewitt(px: DataFrame, axis: int | None = None, mode: str = "symmetric", value: float = 0.0) -> DataFrame:
    return edge_filter(px, "prewitt", axis, mode, value)


def structure_tensor(px: DataFrame, sigma: float = 1.0, mode: str = "constant", value: float = 0.0) -> DataFrame:
    """Smoothed products of the derivatives: ayy, axy, axx."""
    g = gradients(px, "sobel", mode, value, normalise=False)
    out = g.withColumns({"ayy": c("gy") * c("gy"), "axy": c("gy") * c("gx"), "axx": c("gx") * c("gx")}).drop("gy", "gx")
    line = K.gaussian_line(sigma)
    r = len(line) // 2
    for taps in ([(i - r, 0, w) for i, w in enumerate(line)], [(0, i - r, w) for i, w in enumerate(line)]):
        out = gathered(out, taps, mode, value, pad_zeros=bool(value), **{n: F.sum(c("wt") * c(n)) for n in ("ayy", "axy", "axx")})
    return out


def harris_corner(px: DataFrame, nobel: bool = False, k: float = 0.05, epsilon: float = 1e-5, sigma: float = 1.0) -> DataFrame:
    det, trace = c("axx") * c("ayy") - c("axy") * c("axy"), c("axx") + c("ayy")
    return structure_tensor(px, sigma).withColumn("v", 2 * det / (trace + epsilon) if nobel else det - k * trace * trace).drop("ayy", "axy", "axx")


# Morphology.


def _within(out: DataFrame, mask: DataFrame | None, before: DataFrame | None = None) -> DataFrame:
    """``out`` where the mask (image_id, y, x, m) is on; elsewhere, and where it has no row, ``before`` or 0.

    A union and an aggregate, no join.
    """
    if mask is None:
        return out
    key, none = ["image_id", "y", "x"], F.lit(None).cast("double")
    rows = out.select(*PIXEL, "v", none.alias("old")).unionByName(mask.select(*key, c("m").cast("double").alias("m")), allowMissingColumns=True)
    if before is not None:
        rows = rows.unionByName(before.select(*PIXEL, c("v").alias("old")), allowMissingColumns=True)
    both = rows.groupBy(*key).agg(*(F.max(n).alias(n) for n in ("h", "w", "v", "old", "m"))).where("v is not null")
    return both.select(*PIXEL, F.when(c("m") != 0, c("v")).otherwise(F.coalesce("old", F.lit(0.0))).alias("v"))


def binary_erosion(px: DataFrame, element: K.Kernel | None = None, anchor=None, border: int = 0, iterations: int = 1, mask: DataFrame | None = None) -> DataFrame:
    """1 where every cell under the turned element is 1; -1 iterations: until nothing changes.

    Pixels outside ``mask`` (rows with m = 0, or none) keep their value; an empty element changes nothing.
    """
    return _binary(px, element, anchor, border, iterations, mask, F.min)


def binary_dilation(px: DataFrame, element: K.Kernel | None = None, anchor=None, border: int = 0, iterations: int = 1, mask: DataFrame | None = None) -> DataFrame:
    return _binary(px, element, anchor, border, iterations, mask, F.max)


def _binary(px, element, anchor, border, iterations, mask, how) -> DataFrame:
    taps = K.taps(element or K.default_element(), anchor)
    if not taps:
        return px
    key, round_ = ["image_id", "y", "x"], 0
    before = px if iterations == 1 else stored(px.select(*PIXEL, "v"), "binary")
    while True:
        after = _within(gathered(before, taps, "constant", float(border), v=how("v")), mask, before)
        round_ += 1
        if iterations == 1:
            return after
        after = stored(after, "binary")
        if round_ == iterations or (iterations < 0 and after.join(before.withColumnRenamed("v", "old"), key).where("v <> old").isEmpty()):
            return after
        before = after


def binary_opening(px: DataFrame, element: K.Kernel | None = None, anchor=None, border: int = 0, mask: DataFrame | None = None) -> DataFrame:
    return binary_dilation(binary_erosion(px, element, anchor, border, mask=mask), element, anchor, border, mask=mask)


def binary_closing(px: DataFrame, element: K.Kernel | None = None, anchor=None, border: int = 0, mask: DataFrame | None = None) -> DataFrame:
    return binary_erosion(binary_dilation(px, element, anchor, border, mask=mask), element, anchor, border, mask=mask)


def binary_edge(px: DataFrame, how: str = "inner", element: K.Kernel | None = None, anchor=None, border: int = 0, mask: DataFrame | None = None) -> DataFrame:
    """Pixels that erosion takes (inner), that dilation adds (outer), or both (double); none outside ``mask``."""
    taps = K.taps(element or K.default_element(), anchor)
    numbered = [*((a, b, 0) for a, b, _ in taps), (0, 0, 1)]
    own = F.max(F.when(c("wt") == 1, c("v")))
    least, most = (f(F.when(c("wt") == 0, c("v"))) for f in (F.min, F.max))
    out = gathered(px, numbered, "constant", float(border), own=own, lo=least, hi=most)
    pair = {"inner": ("own", "lo"), "outer": ("hi", "own"), "double": ("hi", "lo")}[how]
    return _within(out.withColumn("v", (c(pair[0]) != c(pair[1])).cast("double")).drop("own", "lo", "hi"), mask)


def gray_erosion(px: DataFrame, element: K.Kernel | None = None, anchor=None, border: float = 0.0, flat: bool = True, mask: DataFrame | None = None) -> DataFrame:
    """Least v - height under the turned element; outside the image v is ``border``. Pixels outside ``mask`` keep their value."""
    taps = K.taps(element or K.default_element(), anchor, keep_zeros=not flat)
    return _within(gathered(px, taps, "constant", float(border), v=F.min(c("v") if flat else c("v") - c("wt"))), mask, px)


def gray_dilation(px: DataFrame, element: K.Kernel | None = None, anchor=None, border: float = 0.0, flat: bool = True, mask: DataFrame | None = None) -> DataFrame:
    taps = K.taps(element or K.default_element(), anchor, keep_zeros=not flat)
    return _within(gathered(px, taps, "constant", float(border), v=F.max(c("v") if flat else c("v") + c("wt"))), mask, px)


def gray_opening(px: DataFrame, element: K.Kernel | None = None, anchor=None, border: float = 0.0, flat: bool = True, mask: DataFrame | None = None) -> DataFrame:
    return gray_dilation(gray_erosion(px, element, anchor, border, flat, mask), element, anchor, border, flat, mask)


def gray_closing(px: DataFrame, element: K.Kernel | None = None, anchor=None, border: float = 0.0, flat: bool = True, mask: DataFrame | None = None) -> DataFrame:
    return gray_erosion(gray_dilation(px, element, anchor, border, flat, mask), element, anchor, border, flat, mask)


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b per pixel, as a union and a sum: no join."""
    both = a.select(*PIXEL, "v").unionByName(b.select(*PIXEL, (-c("v")).alias("v")))
    return both.groupBy(*PIXEL).agg(F.sum("v").alias("v"))


def white_top(px: DataFrame, element: K.Kernel | None = None, anchor=None, border: float = 0.0, flat: bool = True, mask: DataFrame | None = None) -> DataFrame:
    return _minus(px, gray_opening(px, element, anchor, border, flat, mask))


def black_top(px: DataFrame, element: K.Kernel | None = None, anchor=None, border: float = 0.0, flat: bool = True, mask: DataFrame | None = None) -> DataFrame:
    return _minus(gray_closing(px, element, anchor, border, flat, mask), px)


def hit_or_miss(px: DataFrame, hit: K.Kernel, miss: K.Kernel | None = None, anchor=None, border: int = 0, strict: bool = False, miss_anchor=None, mask: DataFrame | None = None) -> DataFrame:
    """Erosion by ``hit`` and no erosion by ``miss`` (its complement by default); ``strict``: the image's complement eroded by ``miss``.

    ``miss_anchor`` is the anchor by default. Nothing is found outside ``mask``.
    """
    miss = miss or [[float(not w) for w in r] for r in hit]
    taps = [*((a, b, 1) for a, b, _ in K.taps(hit, anchor)), *((a, b, 2) for a, b, _ in K.taps(miss, miss_anchor or anchor))]
    first, second = (F.coalesce(F.min(F.when(c("wt") == k, (1 - c("v")) if strict and k == 2 else c("v"))), F.lit(1.0)) for k in (1, 2))
    out = gathered(px, taps, "constant", float(border), a=first, b=second)
    return _within(out.withColumn("v", ((c("a") == 1) & ((c("b") == 1) if strict else (c("b") == 0))).cast("double")).drop("a", "b"), mask)


def adaptive_threshold(px: DataFrame, block: int, method: str = "gaussian", offset: float = 0.0, mode: str = "reflect", value: float = 0.0, sigma: float | None = None) -> DataFrame:
    """A threshold for every pixel (th): its neighbourhood's Gaussian mean, mean or median, less an offset."""
    if method == "gaussian":
        sigma = sigma or (block - 1) / 6
        line = K.gaussian_line(sigma, radius=block // 2)
        out = convolve_line(convolve_line(px, line, 0, mode, value), line, 1, mode, value)
    else:
        out = {"mean": mean_filter, "median": median_filter}[method](px, K.box(block, block), mode, value)
    return out.select(*PIXEL, (c("v") - offset).alias("th"))


def canny_suppression(px: DataFrame, low: float) -> DataFrame:
    """Rows (.., mag, gy, gx) to v: 1 where mag >= low and no smaller than either neighbour along the gradient.

    The neighbours are interpolated between the two cells next to the gradient's line; the image's frame is 0.
    """
    taps = [(dy, dx, (dy + 1) * 3 + dx + 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    rows = neighbours(px.select(*PIXEL, "mag", "gy", "gx"), taps, "constant", 0.0, pad_zeros=False)
    at = lambda dy, dx: F.coalesce(F.max(F.when(c("wt") == (dy + 1) * 3 + dx + 1, c("mag"))), F.lit(0.0))
    own = lambda n: F.max(F.when(c("wt") == 4, c(n)))
    names = {(dy, dx): f"m{(dy + 1) * 3 + dx + 1}" for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    wide = rows.groupBy(*PIXEL).agg(*(at(*k).alias(n) for k, n in names.items()), own("gy").alias("gy"), own("gx").alias("gx"))
    m = lambda dy, dx: c(names[dy, dx])
    ay, ax = F.abs("gy"), F.abs("gx")
    falling = (c("gy") >= 0) & (c("gx") >= 0) | (c("gy") <= 0) & (c("gx") <= 0)
    d = F.when(ay > ax, ax / ay).when(ax > 0, ay / ax)  # null, and so no edge, where there is no gradient
    mix = lambda a, b: a * d + b * (1 - d)
    first = F.when(falling & (ax > ay), mix(m(1, 0), m(1, 1))).when(falling, mix(m(0, 1), m(1, 1))).when(ay < ax, mix(m(1, 0), m(1, -1))).otherwise(mix(m(0, -1), m(1, -1)))
    other = F.when(falling & (ax > ay), mix(m(-1, -1), m(-1, 0))).when(falling, mix(m(-1, -1), m(0, -1))).when(ay < ax, mix(m(-1, 1), m(-1, 0))).otherwise(mix(m(-1, 1), m(0, 1)))
    within = c("y").between(1, c("h") - 2) & c("x").between(1, c("w") - 2)
    keep = within & (m(0, 0) >= low) & (m(0, 0) + 1e-9 >= first) & (m(0, 0) + 1e-9 >= other)
    return wide.select(*PIXEL, F.coalesce(keep, F.lit(False)).cast("double").alias("v"), m(0, 0).alias("mag"))
