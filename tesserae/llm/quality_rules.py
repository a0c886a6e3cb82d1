"""Quality rules: plain limits, then robust multivariate outliers for each language and source.

What the limits leave is held against the others of its language and source: a minimum
(regularised) covariance determinant estimate over the half of them that lies closest
together, found by concentration steps from three fixed starts, and a Mahalanobis
distance from it. Statistics are counted over all rows; each step is two aggregates
whose sums are integers, so that no order of summation shows in a verdict. The query
takes every row of a language and source into its estimate; the operator can also count
equal vectors once and pool small groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import discard, stored
from tesserae.llm.text_statistics import Counts, counts

#: Limits: fewest words, greatest share (percent) of words in repeated windows.
FEWEST, REPEATED = 20, 30
#: Statistics of a vector by name, and the tolerance that is added to each one's scale; vectors lie on a grid of 1 / GRID.
TOLERANCE = {"length": 0.05, "symbols": 0.1, "lines": 0.1, "repeats": 0.15}
NAMES = list(TOLERANCE)
P, GRID = len(NAMES), 4096
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Fewest different vectors that have an estimate of their own.
LEAST = 100
#: Steps from each start, further steps from the best, buckets for each doubling of a squared distance.
FIRST, FURTHER, FINE = 2, 6, 16
#: A normal vector is rejected with this probability.
TAIL = 1e-6


def chi_square(x: float, freedom: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, freedom // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, freedom) < share else (low, mid)
    return high


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest ``share`` of normal vectors that of all."""
    return share / chi_square(quantile(share, P), P + 2)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counts(t or b"") for t in (x.as_py() for x in batch.column("text").cast(pa.binary()))]
        columns = np.array(found, np.int64).reshape(-1, len(Counts._fields)).T
        yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c) for c in columns)], names=["row", *Counts._fields])


def vector() -> list[Column]:
    """Logarithm of the mean length of words; roots of symbols, repeated lines and repeated words for each word."""
    share = lambda c: F.sqrt(F.col(c) / F.col("n_words"))
    values = [F.log(F.col("word_chars") / F.col("n_words")), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words")]
    return [F.when(F.col("n_words") > 0, F.floor(v * GRID + 0.5)).cast("int").alias(n) for n, v in zip(NAMES, values, strict=True)]


def distance() -> Column:
    """Squared distance of a vector from ``mean`` under ``inverse`` (pairs i <= j, those of i < j doubled)."""
    off = [F.col(n) - F.col("mean")[i] for i, n in enumerate(NAMES)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        total += F.col("inverse")[k] * off[i] * off[j]
    return total


def ridge() -> np.ndarray:
    return np.diag([(t * GRID) ** 2 for t in TOLERANCE.values()])


SHAPE = "g string, start int, mean array<double>, inverse array<double>, size double"


def _row(g: str, start: int, mean: np.ndarray, cov: np.ndarray) -> tuple:
    """One estimate; ``size`` is the logarithm of its determinant."""
    cov = cov + ridge()
    inverse = np.linalg.inv(cov)
    return g, int(start), mean.tolist(), [float(inverse[i, j] * (1 if i == j else 2)) for i, j in PAIRS], float(np.linalg.slogdet(cov)[1])


def _square(pairs) -> np.ndarray:
    out = np.zeros((P, P))
    for (i, j), v in zip(PAIRS, pairs, strict=True):
        out[i, j] = out[j, i] = v
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["g", "start", "mean", "inverse", "size"])


def _shapes(factor: float):
    """Estimates of weighted sums: rows (g, start, inner and edge sums, share of the edge's weight)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                s = np.asarray(r.inner, float) + r.share * np.asarray(r.edge, float)
                mean = s[1 : P + 1] / s[0]
                rows.append(_row(r.g, r.start, mean, factor * (_square(s[P + 1 :] / s[0]) - np.outer(mean, mean))))
            yield _frame(rows)

    return run


def _starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Three starts of a group: apart, and correlated as squashed vectors and as their directions are."""
    for frame in frames:
        rows = []
        for r in frame.itertuples():
            centre, scale = np.asarray(r.centre, float), np.asarray(r.scale, float)
            for start, sums in enumerate((None, r.squashed, r.directions)):
                c = np.eye(P)
                if sums is not None:
                    m = _square(np.asarray(sums, float)) + np.eye(P) * 1e-9
                    c = m / np.sqrt(np.outer(np.diag(m), np.diag(m)))
                rows.append(_row(r.g, start, centre, c * np.outer(scale, scale)))
        yield _frame(rows)


def moments(y: list[Column]) -> Column:
    """Sums of products of all pairs, as one array, of ``weight`` equal rows each."""
    return F.array(*(F.sum(F.col("weight") * y[i] * y[j]) for i, j in PAIRS))


def sums() -> Column:
    """Count, sums and sums of products of the vectors, ``weight`` times each, exact in integers."""
    w, x = F.col("weight"), [F.col(n).cast("long") for n in NAMES]
    return F.array(F.sum(w), *(F.sum(w * c) for c in x), *(F.sum(w * x[i] * x[j]) for i, j in PAIRS))


def first_estimates(cells: DataFrame) -> DataFrame:
    """Starts from the medians and median deviations of each statistic, which histograms of the grid give exactly."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(n).alias("v")) for i, n in enumerate(NAMES))))
    bars = stored(cells.select("g", "weight", each.alias("e")).groupBy("g", "e.i", "e.v").agg(F.sum("weight").alias("n")), "bars")

    def median(rows: DataFrame, name: str) -> DataFrame:
        of = Window.partitionBy("g", "i")
        upto = rows.withColumn("upto", F.sum("n").over(of.orderBy("v"))).withColumn("all", F.sum("n").over(of))
        return upto.where(F.col("upto") * 2 >= F.col("all")).groupBy("g", "i").agg(F.min("v").alias(name))

    centre = median(bars, "centre")
    off = bars.join(centre, ["g", "i"]).groupBy("g", "i", "centre", F.abs(F.col("v") - F.col("centre")).alias("v")).agg(F.sum("n").alias("n"))
    spread = median(off, "spread").join(centre, ["g", "i"])
    tolerance = F.array(*(F.lit(t * GRID) for t in TOLERANCE.values()))
    spread = spread.withColumn("scale", 1.4826 * F.col("spread") + tolerance[F.col("i")])
    listed = F.sort_array(F.collect_list(F.struct("i", "centre", "scale")))  # one entry for each statistic
    centres = spread.groupBy("g").agg(listed.alias("s")).select("g", F.col("s.centre").alias("centre"), F.col("s.scale").alias("scale"))
    centres = stored(centres, "centres")
    z = [(F.col(n) - F.col("centre")[i]) / F.col("scale")[i] for i, n in enumerate(NAMES)]
    rows = cells.join(centres, "g").select("g", "weight", *(c.alias(n) for n, c in zip(NAMES, z, strict=True)))
    length = F.sqrt(sum((F.col(n) * F.col(n) for n in NAMES), F.lit(0.0)))
    whole = lambda v: F.floor(v * 10_000 + 0.5)  # noqa: E731 - integers add up alike in any order
    squashed = [whole(F.tanh(n)) for n in NAMES]
    directions = [whole(F.when(length > 0, F.col(n) / length).otherwise(0.0)) for n in NAMES]
    both = rows.groupBy("g").agg(moments(squashed).alias("squashed"), moments(directions).alias("directions"))
    out = stored(both.join(centres, "g").mapInPandas(_starts, SHAPE), "estimates")
    discard(bars, centres)
    return out


def nearest_half(cells: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimates of the half of each group that lies nearest to ``estimates``: one concentration step.

    Distances are dealt to buckets; the vectors of the bucket where the half ends share what
    is left of its weight, so that equal vectors are treated alike.
    """
    near = cells.join(estimates.select("g", "start", "mean", "inverse"), "g")
    near = near.select("g", "start", "weight", *NAMES, F.floor(F.log2(distance() + 2.0**-20) * FINE).cast("int").alias("bucket"))
    of = Window.partitionBy("g", "start")
    bars = near.groupBy("g", "start", "bucket").agg(F.sum("weight").alias("n"))
    whole = F.sum("n").over(of)
    bars = bars.withColumn("upto", F.sum("n").over(of.orderBy("bucket"))).withColumn("half", F.least(F.floor((whole + P + 1) / 2), whole))
    ends = bars.where((F.col("upto") >= F.col("half")) & (F.col("upto") - F.col("n") < F.col("half")))
    ends = ends.select("g", "start", F.col("bucket").alias("last"), ((F.col("half") - F.col("upto") + F.col("n")) / F.col("n")).alias("share"))
    ends = stored(ends, "ends")
    held = near.join(ends, ["g", "start"]).where(F.col("bucket") <= F.col("last"))
    parts = held.groupBy("g", "start", "share", (F.col("bucket") == F.col("last")).alias("is_edge")).agg(sums().alias("s"))
    none = F.array_repeat(F.lit(0).cast("long"), 1 + P + len(PAIRS))
    side = lambda edge: F.coalesce(F.max(F.when(F.col("is_edge") == edge, F.col("s"))), none)
    both = parts.groupBy("g", "start", "share").agg(side(False).alias("inner"), side(True).alias("edge"))
    out = stored(both.mapInPandas(_shapes(1.0), SHAPE), "estimates")
    discard(ends)
    return out


def scaled(estimates: DataFrame, factor: float) -> DataFrame:
    """Estimates whose covariances, tolerance and all, are ``factor`` times as large."""
    return estimates.withColumn("inverse", F.transform("inverse", lambda v: v / factor))


def grouped(rows: DataFrame, copies: bool = False, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Different vectors (g, statistics, weight) and the group ``g`` of each ``own``; ``weight`` is the number of rows with ``copies``, else 1.

    A language and source of fewer than ``least`` vectors joins the others such of its language, and
    these the others such of all languages where they are too few together; with ``least`` 1 each is a group of its own.
    """
    weight = (F.count("*") if copies else F.lit(1).cast("long")).alias("weight")
    cells = stored(rows.groupBy("own", "wide", *NAMES).agg(weight), "cells")
    few = cells.groupBy("own", "wide").agg(F.count("*").alias("n"))
    pooled = F.sum(F.when(F.col("n") < least, F.col("n")).otherwise(0)).over(Window.partitionBy("wide"))
    named = F.when(F.col("n") >= least, F.col("own")).when(pooled >= least, F.col("wide")).otherwise("all")
    groups = stored(few.select("own", named.alias("g")), "groups")
    out = stored(cells.join(groups, "own").select("g", *NAMES, "weight"), "vectors")
    discard(cells)
    return out, groups


def estimated(cells: DataFrame, least: int = LEAST) -> DataFrame:
    """(g, mean, inverse) of each group of at least ``least`` vectors."""
    estimates = first_estimates(cells)
    for step in range(FIRST + FURTHER):
        old, estimates = estimates, nearest_half(cells, estimates)
        discard(old)
        if step == FIRST - 1:
            old = estimates
            best = old.groupBy("g").agg(F.min_by(F.struct("start", "mean", "inverse", "size"), F.struct("size", "start")).alias("e"))
            estimates = stored(best.select("g", "e.*"), "estimates")
            discard(old)
    near = cells.join(scaled(estimates, consistency(0.5)), "g").where(distance() <= quantile(0.975, P))
    kept = near.groupBy("g", "start").agg(sums().alias("inner"))
    enough = cells.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = kept.join(enough, "g").select("g", "start", "inner", F.col("inner").alias("edge"), F.lit(0.0).alias("share"))
    out = stored(kept.mapInPandas(_shapes(consistency(0.975)), SHAPE).select("g", "mean", "inverse"), "estimates")
    discard(estimates)
    return out


def quality_rules(docs: DataFrame, by: tuple[str, str] = ("lang", "source"), copies: bool = False, least: int = LEAST) -> DataFrame:
    """Counts of every whole text of ``docs``, and whether the rules keep it.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and ``distance``, the squared Mahalanobis distance from
    the row's language and source (null where base limits fail or nothing is estimated). A
    vector has the mean length of words, and symbols, repeated lines and repeated words for each word;
    very long texts are judged by the same shares as short ones. With ``copies`` every row counts, and a group
    more than half of which are copies is judged by these; without, equal vectors of a group count once, so
    that copies have no weight of their own. Groups of fewer than ``least``
    vectors are pooled; where even the pool is that small, the limits alone decide. With ``least`` 1
    every language and source has its own estimate, however few its rows.

    Null and empty texts have no words and fail. Null languages and sources are groups of their
    own. One row per row of ``docs``, repeated rows alike; an empty table gives an
    empty result; further columns are left alone. Only counts are shuffled, no texts.
    """
    own = [F.col(c).cast("string").alias(n) for c, n in zip(by, ("wide", "narrow"), strict=True)]
    keys = F.struct(F.col("doc_id").alias("doc_id"), F.to_json(F.struct(*own)).alias("own"), F.to_json(F.struct(own[0])).alias("wide"))
    rows = docs.select(keys.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    found = rows.mapInArrow(_count, ", ".join([f"row {kind}", *(f"{c} long" for c in Counts._fields)])).select("row.*", *Counts._fields)
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    table = stored(found.withColumn("base_failed", failed).select("*", *vector()), "counts")
    cells, groups = grouped(table.where("not base_failed"), copies, least)
    places = stored(groups.join(estimated(cells, least), "g").select("own", "mean", "inverse"), "places")
    far = F.when(~F.col("base_failed"), distance()).alias("distance")
    out = table.join(places, "own", "left").select("doc_id", *Counts._fields, "base_failed", far)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= quantile(1 - TAIL, P), F.lit(True))
    return out.withColumn("kept", kept)


def query(spark, sf_dir: str) -> DataFrame:
    """Every row counts in the estimate of its own language and source."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), copies=True, least=1)
