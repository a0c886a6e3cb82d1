"""Connected components of images and what rests on them.

Tiles find their components by themselves; these are the nodes, and those of neighbouring
tiles that touch are the edges. Rounds of large and small stars pull every node to the
component's first one, so neither an image nor a component has to fit a task. Each
round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import tiles
from ..plans.frames import PIXEL, discard, images_of, numbered, stored
from . import neighbourhood as N
from .pointwise import quantise
from .trees import steps

c = F.col


def rooted(edges: DataFrame) -> DataFrame:
    """(image_id, a, root) for edges (image_id, a, b): root is the least node of a's component."""
    key, before = ["image_id", "a"], None
    edges = stored(edges.distinct(), "edges")
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("image_id", "a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return edges.select("image_id", "a", c("b").alias("root"))
        before = mark
        both = edges.unionByName(edges.select("image_id", c("b").alias("a"), c("a").alias("b")))
        least = both.groupBy(*key).agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, key).where("b > a").select("image_id", c("b").alias("a"), c("m").alias("b")).distinct()
        least = large.groupBy(*key).agg(F.min("b").alias("m"))
        pairs = F.array(F.struct("a", c("m").alias("b")), F.struct(c("b").alias("a"), c("m").alias("b")))
        old, edges = edges, stored(large.join(least, key).select("image_id", F.explode(pairs).alias("e")).select("image_id", "e.*").where("a <> b").distinct(), "edges")
        discard(old)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of n nodes' components under the edges a - b: edges pull roots down, pointers are halved, until all agree."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        least = np.minimum(x, y)
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        while (root[root] != root).any():
            root = root[root]


def _tile(connectivity: int):
    """Components within a tile: each set cell's root, the raster number of the component's first cell there."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y, x, v = (rows[n].to_numpy() for n in ("y", "x", "v"))
        order = np.lexsort((x, y))
        y, x, v = y[order].astype(np.int64), x[order].astype(np.int64), v[order]
        place = np.full((y.max() - y.min() + 3, x.max() - x.min() + 3), -1)
        at = y - y.min() + 1, x - x.min() + 1
        place[at] = np.arange(len(y))
        pairs = [(np.arange(len(y)), place[at[0] + dy, at[1] + dx]) for dy, dx in steps(connectivity)]
        a, b = (np.concatenate(e) for e in zip(*pairs, strict=True))
        touch = (b >= 0) & (v[a] == v[b])
        first = joined(len(y), a[touch], b[touch])
        return pd.DataFrame({"image_id": key[0], "y": y, "x": x, "v": v, "part": (y * int(rows["w"].iloc[0]) + x)[first]})

    return run


def components(px: DataFrame, connectivity: int = 1, side: int | None = None) -> DataFrame:
    """Adds root to the foreground's pixels (those with v <> 0): the raster number of their component's first cell.

    Tiles find their components by themselves; what touches across tiles are the edges of a graph of those.
    """
    side = side or tiles.TILE
    rows = px.where("v <> 0").select("image_id", "w", "y", "x", c("v").cast("double").alias("v"), F.floor(c("y") / side).alias("gy"), F.floor(c("x") / side).alias("gx"))
    cells = stored(rows.groupBy("image_id", "gy", "gx").applyInPandas(_tile(connectivity), "image_id long, y int, x int, v double, part long"), "cells")
    edge = (c("y") % side).isin(0, side - 1) | (c("x") % side).isin(0, side - 1)
    seam = cells.where(edge)
    moves = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps(connectivity)))
    out = seam.select("*", F.explode(moves).alias("m")).select("image_id", "v", c("part").alias("a"), c("y").alias("y0"), c("x").alias("x0"), (c("y") + c("m.dy")).alias("y"), (c("x") + c("m.dx")).alias("x"))
    other = (F.floor(c("y0") / side) != F.floor(c("y") / side)) | (F.floor(c("x0") / side) != F.floor(c("x") / side))
    meet = out.where(other).join(seam.withColumnRenamed("part", "b"), ["image_id", "y", "x", "v"])
    roots = rooted(meet.select("image_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    named = cells.join(roots.withColumnRenamed("a", "part"), ["image_id", "part"], "left").select("image_id", "y", "x", F.coalesce("root", "part").alias("root"))
    return px.join(named, ["image_id", "y", "x"], "left")


def label(px: DataFrame, connectivity: int = 1, method: str | None = None, mod: int = 16) -> DataFrame:
    """label: 0 for background, else 1, 2, ... by each component's first cell in raster order.

    Pixels are of one component if equal values (classes of ``quantise`` with a ``method``) touch.
    """
    at = components(quantise(px, method, mod) if method else px, connectivity)
    names = numbered(at.where("root is not null").select("image_id", "root").distinct(), "image_id", [c("root")], "label")
    return at.join(names, ["image_id", "root"], "left").select(*PIXEL, F.coalesce("label", F.lit(0)).cast("long").alias("label"))


def _by_area(px: DataFrame, threshold: int, connectivity: int) -> DataFrame:
    at = components(px, connectivity)
    area = at.where("root is not null").groupBy("image_id", "root").agg(F.count("*").alias("area"))
    kept = area.where(c("area") > threshold).select("image_id", "root", F.lit(1.0).alias("k"))
    return at.join(kept, ["image_id", "root"], "left").select(*PIXEL, F.coalesce("k", F.lit(0.0)).alias("v"))


def remove_small_objects(px: DataFrame, threshold: int = 32, connectivity: int = 1) -> DataFrame:
    """Keeps components of more than ``threshold`` cells."""
    return _by_area(px, threshold, connectivity)


def inverted(px: DataFrame) -> DataFrame:
    return px.withColumn("v", (c("v") == 0).cast("double"))


def remove_small_holes(px: DataFrame, threshold: int = 32, connectivity: int = 1) -> DataFrame:
    return inverted(_by_area(inverted(px), threshold, connectivity))


def fill_holes(px: DataFrame, connectivity: int = 1) -> DataFrame:
    """Background that does not reach the image's border becomes foreground."""
    at = components(inverted(px), connectivity)
    edge = (c("y") == 0) | (c("x") == 0) | (c("y") == c("h") - 1) | (c("x") == c("w") - 1)
    open_ = at.where(edge & c("root").isNotNull()).select("image_id", "root").distinct().withColumn("o", F.lit(1))
    return at.join(open_, ["image_id", "root"], "left").select(*PIXEL, c("o").isNull().cast("double").alias("v"))


def region_fill(px: DataFrame, seed: tuple[int, int], tolerance: float = 0, connectivity: int = 1, binary: bool = True, value: float = 1.0) -> DataFrame:
    """Flood fill. Binary: the zeros connected to the seed join the ones. Numeric: cells connected to the seed within
    ``tolerance`` of its value are filled, as is every cell outside the tolerance."""
    at_seed = (c("y") == seed[0]) & (c("x") == seed[1])
    if binary:
        open_ = inverted(px)
    else:
        level = px.where(at_seed).select("image_id", c("v").alias("level"))
        open_ = px.join(level, "image_id").withColumn("v", (F.abs(c("v") - c("level")) <= tolerance).cast("double")).drop("level")
    at = components(open_, connectivity)
    start = at.where(at_seed & c("root").isNotNull()).select("image_id", "root", F.lit(1).alias("s"))
    filled = c("s").isNotNull() | (c("v") == 0)
    return at.join(start, ["image_id", "root"], "left").select(*PIXEL, F.when(filled, value).otherwise(0.0).alias("v"))


def canny(px: DataFrame, sigma: float = 1.0, low: float | None = None, high: float | None = None, top: float = 255.0, percentile: bool = False, mode: str = "constant", value: float = 0.0, mask: DataFrame | None = None) -> DataFrame:
    """Edges: blur, gradients, suppression along the gradient, and components that hold a strong pixel.

    ``top`` is the type's greatest value: pixels and given thresholds are divided by it (defaults 0.1 and 0.2);
    with ``percentile`` the thresholds are shares of the magnitudes' distribution. Cells outside ``mask`` (image_id,
    y, x, m; m = 0 or no row) count as 0, the blur is divided by what the mask, a cell thinner, holds of its
    weights, and edges are only where it holds all of them.
    """
    from ..functions import kernels as K

    if mode == "valid":
        raise ValueError("canny needs a border mode that keeps the size")
    scale = 1.0 if percentile else top
    low = 0.1 if low is None else low / scale
    high = 0.2 if high is None else high / scale
    taps = K.taps(K.gaussian(sigma, radius=2))
    unit = px.withColumn("v", c("v") / top)
    inner = c("y").between(1, c("h") - 2) & c("x").between(1, c("w") - 2)
    full = None
    if mask is not None:
        held = unit.join(mask.select("image_id", "y", "x", (c("m") != 0).alias("m")), ["image_id", "y", "x"], "left").withColumn("m", F.coalesce(c("m").cast("double"), F.lit(0.0)))
        thin = N.binary_erosion(held.select(*PIXEL, c("m").alias("v")), K.box(3, 3)).select("image_id", "y", "x", c("v").alias("t"))
        unit = held.join(thin, ["image_id", "y", "x"]).select(*PIXEL, (c("v") * c("m")).alias("v"), c("t").alias("m"))
        blurred = N.gathered(unit, taps, mode, value, pad_zeros=bool(value) or mode != "constant", v=F.sum(c("wt") * c("v")), m=F.sum(c("wt") * c("m")))
        blurred = stored(blurred, "blurred")
        full, whole = blurred.select("image_id", "y", "x", (c("m") >= 1 - 1e-9).alias("full")), c("full")
        blurred = blurred.withColumn("v", c("v") / (c("m") + K.EPSILON)).drop("m")
    elif mode == "constant":
        blurred = N.gathered(unit.withColumn("m", inner.cast("double")), taps, mode, value, pad_zeros=bool(value), v=F.sum(c("wt") * c("v")), m=F.sum(c("wt") * c("m")))
        blurred = blurred.withColumn("v", c("v") / (c("m") + K.EPSILON)).drop("m")
        whole = c("y").between(3, c("h") - 4) & c("x").between(3, c("w") - 4)
    else:
        blurred, whole = N.gathered(unit, taps, mode, value, v=F.sum(c("wt") * c("v"))), F.lit(True)
    g = N.gradients(blurred, "sobel", "symmetric", normalise=False).withColumn("mag", F.sqrt(c("gy") * c("gy") + c("gx") * c("gx")))
    if percentile:
        g = stored(g, "magnitude")
        ends = g.groupBy("image_id").agg(F.percentile("mag", F.lit(low)).alias("lo"), F.percentile("mag", F.lit(high)).alias("hi"))
    else:
        ends = images_of(g).select("image_id", F.lit(low).alias("lo"), F.lit(high).alias("hi"))
    thin = N.canny_suppression(g, 0.0).join(ends, "image_id")
    if full is not None:
        thin = thin.join(full, ["image_id", "y", "x"])
    thin = thin.withColumn("v", ((c("v") > 0) & whole & (c("mag") >= c("lo"))).cast("double"))
    at = components(stored(thin, "thin"), 2)
    strong = at.where((c("mag") >= c("hi")) & c("root").isNotNull()).select("image_id", "root").distinct().withColumn("s", F.lit(1.0))
    return at.join(strong, ["image_id", "root"], "left").select(*PIXEL, F.coalesce("s", F.lit(0.0)).alias("v"))
