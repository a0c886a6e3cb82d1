"""Point sets: nearest neighbours, range joins, clustering and convex hulls."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.frames import PIXEL, grid
from .clusters import KMeans
from .drawing import inside_hull, lines
from .metric import PivotIndex

c = F.col


def distance(a: Column, b: Column, p: float = 2) -> Column:
    """Minkowski distance of two arrays."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if math.isinf(p):
        return F.array_max(gaps)
    total = F.aggregate(F.transform(gaps, lambda g: F.pow(g, F.lit(float(p)))), F.lit(0.0), lambda s, g: s + g)
    return F.pow(total, F.lit(1.0 / p))


def knn(points: DataFrame, queries: DataFrame, k: int | str, p: float = 2, within: float = math.inf, epsilon: float = 0) -> DataFrame:
    """The k nearest points (point_id, p) of each query (query_id, q), closer than ``within``: query_id, point_id, dist, rank.

    ``k`` is a number or a column of ``queries``; ties go by point_id. To search the same points again, keep a ``PivotIndex``.
    """
    return PivotIndex(points, p).knn(queries, k, within, epsilon)


def ball(points: DataFrame, queries: DataFrame, radius: float | str, p: float = 2, epsilon: float = 0) -> DataFrame:
    """Pairs with distance <= radius (a number or a column of ``queries``): query_id, point_id, dist."""
    return PivotIndex(points, p).ball(queries, radius, epsilon)


def assign(points: DataFrame, centres: list[list[float]], p: float = 2) -> DataFrame:
    """Adds cluster: the nearest of the centres, of equal ones the first."""
    d = F.array(*(F.round(distance(c("p"), F.array(*map(F.lit, map(float, k))), p), 9) for k in centres))
    return points.withColumn("cluster", (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def kmeans(points: DataFrame, k: int = 4, iterations: int = 100, tol: float = 0.0, first: int | None = None, p: float = 2, start: str = "farthest", seed: int = 0) -> list[list[float]]:
    """Lloyd's centres, as ``KMeans`` finds them: those of so many rounds, or of fewer if they stay. Only k centres and sums of tasks reach the driver."""
    return KMeans(k, iterations, tol, start, p, first, seed).fit(points).centers.tolist()


def chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull by monotone chain: corners in order round the hull, from the least point."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    half = []
    for way in (points, points[::-1]):
        side: list[tuple[float, float]] = []
        for q in way:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (q[1] - side[-2][1]) - (side[-1][1] - side[-2][1]) * (q[0] - side[-2][0]) <= 0:
                side.pop()
            side.append(q)
        half += side[:-1]
    return half


def convex_hull(points: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Corners (set_id, i, y, x) of the hull of each set's points (set_id, y, x), of those where ``mask`` (set_id, y, x, m) is on.

    Only the ends of each row can be corners: an aggregation leaves two points a row before a set is put together.
    """
    if mask is not None:
        points = points.join(mask.where("m <> 0").select("set_id", "y", "x"), ["set_id", "y", "x"], "left_semi")
    ends = points.groupBy("set_id", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    ends = ends.select("set_id", "y", F.explode(F.array_distinct(F.array("a", "b"))).alias("x"))

    def hull(rows: pd.DataFrame) -> pd.DataFrame:
        got = chain(list(zip(rows["y"].astype(float), rows["x"].astype(float), strict=True)))
        return pd.DataFrame({"set_id": rows["set_id"].iloc[0], "i": range(len(got)), "y": [q[0] for q in got], "x": [q[1] for q in got]})

    return ends.groupBy("set_id").applyInPandas(hull, "set_id long, i int, y double, x double")


def hull_edges(corners: DataFrame) -> DataFrame:
    """One row for each set: its hull as an array of edges (y0, x0, y1, x1)."""
    all_ = corners.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("i", "y", "x"))).alias("k"))
    edge = lambda q, i: F.struct(q["y"].alias("y0"), q["x"].alias("x0"), c("k")[(i + 1) % F.size("k")]["y"].alias("y1"), c("k")[(i + 1) % F.size("k")]["x"].alias("x1"))
    return all_.select("set_id", F.transform("k", edge).alias("edges"))


def hull_contains(corners: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries (set_id, y, x) with inside: in or on the hull of their set."""
    return queries.join(hull_edges(corners), "set_id", "left").withColumn("inside", inside_hull(c("edges"), c("y"), c("x"))).drop("edges")


def hull_image(corners: DataFrame, images: DataFrame) -> DataFrame:
    """Filled hulls on grids (image_id, h, w); set_id is the image."""
    cells = grid(images).join(hull_edges(corners).withColumnRenamed("set_id", "image_id"), "image_id", "left")
    return cells.select(*PIXEL, inside_hull(c("edges"), c("y"), c("x")).cast("double").alias("v"))


def hull_outline(corners: DataFrame) -> DataFrame:
    """Cells (set_id, y, x) of the hulls' edges."""
    e = hull_edges(corners).select("set_id", F.explode("edges").alias("e")).select("set_id", *(c(f"e.{n}").cast("int").alias(m) for n, m in (("y0", "y1"), ("x0", "x1"), ("y1", "y2"), ("x1", "x2"))))
    return lines(e).select("set_id", "y", "x").distinct()


