"""Histograms, their transforms and histogram thresholds: one aggregation, then windows over bins only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def by_bin():
    return Window.partitionBy("image_id").orderBy("bin")


def upto():
    return by_bin().rowsBetween(Window.unboundedPreceding, 0)


def onward():
    return by_bin().rowsBetween(0, Window.unboundedFollowing)


def every():
    """All bins of an image."""
    return Window.partitionBy("image_id")


def bin_count(px: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Counts of whole values, a row for each from the image's least to its greatest, or of a given range."""
    rows = px if low is None else px.where(c("v").between(low, high))
    counts = rows.groupBy("image_id", F.col("v").alias("bin")).agg(F.count("*").alias("cnt"))
    ends = px.groupBy("image_id").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    first, last = (F.lit(low), F.lit(high)) if low is not None else (c("a").cast("int"), c("b").cast("int"))
    empty = ends.select("image_id", F.explode(F.sequence(first, last)).alias("bin")).select("image_id", c("bin").cast("double"), F.lit(0).cast("long").alias("cnt"))
    return counts.unionByName(empty).groupBy("image_id", "bin").agg(F.sum("cnt").alias("cnt"))


def histogram(px: DataFrame, bins: int | list[float] = 10) -> DataFrame:
    """Counts in equal bins over each image's range, or between given edges; bin is the centre. The last bin is closed.

    A constant image's range is widened by a half on each side; with edges, values outside are not counted.
    """
    if isinstance(bins, int):
        ends = px.groupBy("image_id").agg(F.min("v").alias("a"), F.max("v").alias("b"))
        ends = ends.select("image_id", F.when(c("a") == c("b"), c("a") - 0.5).otherwise(c("a")).alias("a"), F.when(c("a") == c("b"), c("b") + 0.5).otherwise(c("b")).alias("b"))
        k = F.least(F.floor((c("v") - c("a")) * bins / (c("b") - c("a"))), F.lit(bins - 1)).cast("int")
        counts = px.join(ends, "image_id").groupBy("image_id", k.alias("k")).agg(F.count("*").alias("cnt"))
        every = ends.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("k"), F.lit(0).cast("long").alias("cnt"))
        out = counts.unionByName(every).groupBy("image_id", "k").agg(F.sum("cnt").alias("cnt")).join(ends, "image_id")
        return out.select("image_id", (c("a") + (c("k") + 0.5) * (c("b") - c("a")) / bins).alias("bin"), "cnt")
    edges = sorted(bins)
    if edges != list(bins) or len(set(edges)) != len(edges):
        raise ValueError("edges must increase")
    k = sum((c("v") >= e).cast("int") for e in edges) - 1
    k = F.when(c("v") == edges[-1], len(edges) - 2).otherwise(k)
    centres = F.array(*(F.lit((a + b) / 2.0) for a, b in zip(edges, edges[1:], strict=False)))
    counts = px.withColumn("k", k).where(c("k").between(0, len(edges) - 2)).groupBy("image_id", "k").agg(F.count("*").alias("cnt"))
    every = px.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))).alias("k"), F.lit(0).cast("long").alias("cnt"))
    out = counts.unionByName(every).groupBy("image_id", "k").agg(F.sum("cnt").alias("cnt"))
    return out.select("image_id", F.element_at(centres, c("k") + 1).alias("bin"), "cnt")


def normalised(hist: DataFrame) -> DataFrame:
    return hist.withColumn("p", c("cnt") / F.sum("cnt").over(every()))


def cdf(hist: DataFrame) -> DataFrame:
    return hist.withColumn("cdf", F.sum("cnt").over(upto()) / F.sum("cnt").over(every()))


def interpolated(queries: DataFrame, nodes: DataFrame, by: list[str], left: float | None = None) -> DataFrame:
    """Piecewise linear values f of queries (by, xn) through nodes (by, xp, fp).

    An exact hit gives its node; below the first node ``left`` or that node's value; above the last the last
    node's. Nodes and queries are merged in one sorted window, so neither is multiplied by the other.
    """
    spare = [(n, t) for n, t in queries.dtypes if n not in (*by, "xn")]
    rows = nodes.select(*by, c("xp").alias("_x"), c("fp").alias("_f"), F.lit(0).alias("_kind"), *(F.lit(None).cast(t).alias(n) for n, t in spare))
    asked = queries.select(*by, c("xn").alias("_x"), F.lit(None).cast("double").alias("_f"), F.lit(1).alias("_kind"), *(n for n, _ in spare))
    w = Window.partitionBy(*by).orderBy("_x", "_kind")
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    node = F.when(c("_kind") == 0, F.struct(c("_x").alias("x"), c("_f").alias("f")))
    both = rows.unionByName(asked).withColumns({"_a": F.last(node, True).over(back), "_b": F.first(node, True).over(on)})
    first = c("_b.f") if left is None else F.lit(float(left))
    between = c("_a.f") + (c("_b.f") - c("_a.f")) * (c("_x") - c("_a.x")) / (c("_b.x") - c("_a.x"))
    f = F.when(c("_a").isNull(), first).when((c("_a.x") == c("_x")) | c("_b").isNull(), c("_a.f")).otherwise(between)
    return both.where("_kind = 1").select(*by, c("_x").alias("xn"), *(n for n, _ in spare), f.alias("f"))


def equalise(px: DataFrame, bins: int = 256, top: float = 255.0) -> DataFrame:
    """Histogram equalisation: the cumulative share at each pixel's value, interpolated between bin centres."""
    nodes = cdf(histogram(px, bins)).select("image_id", c("bin").alias("xp"), c("cdf").alias("fp"))
    values = px.select("image_id", c("v").alias("xn")).distinct()  # a row for each value, not for each pixel
    mapped = interpolated(values, nodes, ["image_id"]).select("image_id", c("xn").alias("v"), F.round(c("f") * top).alias("new"))
    return px.join(mapped, ["image_id", "v"]).withColumn("v", c("new")).drop("new")


def _trimmed(px: DataFrame, bins: int | None) -> DataFrame:
    """The histogram without empty bins at its ends."""
    hist = bin_count(px) if bins is None else histogram(px, bins)
    filled = F.when(c("cnt") > 0, c("bin"))
    return hist.withColumns({"a": F.min(filled).over(every()), "b": F.max(filled).over(every())}).where(c("bin").between(c("a"), c("b"))).drop("a", "b")


def _sums(hist: DataFrame) -> DataFrame:
    s = c("cnt") * c("bin")
    return hist.withColumns({"n1": F.sum("cnt").over(upto()), "n2": F.sum("cnt").over(onward()), "m1": F.sum(s).over(upto()) / F.sum("cnt").over(upto()), "m2": F.sum(s).over(onward()) / F.sum("cnt").over(onward())})


def _best(hist: DataFrame, value: Column, shift: int = 0, least: bool = False) -> DataFrame:
    """The bin (or the one ``shift`` after it) with the greatest or least criterion; of equal ones the first."""
    rows = hist.withColumn("crit", F.round(value, 9)).withColumn("at", F.lead("bin", shift).over(by_bin()) if shift else c("bin")).where("crit is not null")
    order = c("crit") if least else -c("crit")
    return rows.groupBy("image_id").agg(F.min_by("at", F.struct(order, c("bin"))).alias("th"))


def _ln(x: Column) -> Column:
    return F.log(F.when(x == 0, 1.0).otherwise(x))


def otsu(px: DataFrame, bins: int | None = None) -> DataFrame:
    n2, m2 = F.lead("n2").over(by_bin()), F.lead("m2").over(by_bin())
    return _lone(px, _best(_sums(_trimmed(px, bins)), c("n1") * n2 * F.pow(c("m1") - m2, 2)))


def li_and_lee(px: DataFrame, bins: int | None = None) -> DataFrame:
    n2, m2 = F.lead("n2").over(by_bin()), F.lead("m2").over(by_bin())
    return _lone(px, _best(_sums(_trimmed(px, bins)), c("n1") * c("m1") * _ln(c("m1")) + n2 * m2 * _ln(m2), 1))


def kapur(px: DataFrame, bins: int | None = None) -> DataFrame:
    h = normalised(_trimmed(px, bins))
    h = h.withColumn("e", c("p") * F.log(F.when(c("p") <= 0, 1.0).otherwise(c("p"))))
    h = h.withColumns({"p1": F.sum("p").over(upto()), "p2": F.sum("p").over(onward()), "e1": F.sum("e").over(upto()), "all": F.sum("e").over(every())})
    return _best(h, -(c("e1") / c("p1")) + F.log("p1") - (c("all") - c("e1")) / c("p2") + F.log("p2"))


def minimum_error(px: DataFrame, bins: int | None = None) -> DataFrame:
    """The spreads add up (bin - mean)^2 bin by bin, without the counts."""
    h = _sums(_trimmed(px, bins))
    h = h.withColumns({"q1": F.pow(c("bin") - c("m1"), 2), "q2": F.pow(c("bin") - c("m2"), 2)})
    h = h.withColumns({"s1": F.sqrt(F.sum("q1").over(upto()) / c("n1")), "s2": F.sqrt(F.sum("q2").over(onward()) / c("n2"))})
    one = lambda x: F.when(x == 0, 1.0).otherwise(x)
    n1, s1 = F.lead("n1").over(by_bin()), one(F.lead("s1").over(by_bin()))
    s2 = one(c("s2"))
    return _lone(px, _best(h, 1 + 2 * (n1 * F.log(s1 / s2) + c("n2") * F.log(s2 / s1)), 1, least=True))


def _lone(px: DataFrame, found: DataFrame) -> DataFrame:
    """Images of one value have no pair of bins: their value is the threshold."""
    only = px.groupBy("image_id").agg(F.min("v").alias("th"), F.max("v").alias("b")).where("th = b").select("image_id", "th")
    return found.unionByName(only.join(found, "image_id", "left_anti"))


def mean_threshold(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg(F.avg("v").alias("th"))


def minimum(px: DataFrame, bins: int | None = None, iterations: int = 10000) -> DataFrame:
    """Smooths each histogram until two peaks are left; the valley between them. Null if there are not two."""

    def valley(batch: pd.DataFrame) -> pd.DataFrame:
        h = batch.sort_values("bin")
        n = h["cnt"].to_numpy(float)
        peaks: list[int] = []
        for _ in range(iterations):
            peaks = [i for i in range(len(n)) if n[i] > (n[i - 1] if i else -1) and n[i] > (n[i + 1] if i + 1 < len(n) else -1)]
            if len(peaks) <= 2:
                break
            wide = np.pad(n, 1)
            n = (wide[:-2] + wide[1:-1] + wide[2:]) / 3
        th = float(h["bin"].iloc[peaks[0] + int(n[peaks[0] : peaks[1] + 1].argmin())]) if len(peaks) == 2 else None
        return pd.DataFrame({"image_id": [h["image_id"].iloc[0]], "th": [th]})

    return _trimmed(px, bins).groupBy("image_id").applyInPandas(valley, "image_id long, th double")


#: Registry of thresholds: name to function of pixels; users add their own with ``register``.
THRESHOLDS: dict[str, Callable[..., DataFrame]] = {"OTSU": otsu, "LI_AND_LEE": li_and_lee, "KAPUR": kapur, "MINIMUM_ERROR": minimum_error, "MEAN": mean_threshold, "MINIMUM": minimum}


def register(name: str, function: Callable[..., DataFrame], registry: dict = THRESHOLDS) -> None:
    if name in registry:
        raise ValueError(f"{name} is taken")
    registry[name] = function


def threshold(px: DataFrame, how: str | Callable[..., DataFrame], **options) -> DataFrame:
    """v > th, with the threshold in a column: by name or function; one row of threshold for each image or pixel."""
    th = (THRESHOLDS[how.upper()] if isinstance(how, str) else how)(px, **options)
    out = px.join(th, [k for k in ("image_id", "y", "x") if k in th.columns])
    return out.withColumn("v", (c("v") > c("th")).cast("double"))
