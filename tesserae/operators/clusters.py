"""K-means in a Minkowski space: seeding in a few passes, then Lloyd's rounds under distance bounds.

Points are stored once with the centre that they are nearest to, how far it is and how far the second
nearest is. While centres move, these two numbers and the way that the centres have gone since tell for
most points that nothing changes; the rest are looked at again. A round is one pass that gives
k sums for each task; the table is written anew only when too many points are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.frames import discard, stored
from .metric import exact, matrix, packed

STATE = "point_id long, x binary, at int, upper double, lower double, k int, n long, looked long, sums array<double>"
#: Share of the points that may be looked at again before their bounds are written anew.
STALE = 0.25
#: Distances that differ by less count as equal; the first centre then has the point.
DIGITS = 9
#: Rounds of oversampling and expected samples of each, in multiples of k (at most eight times as many are fetched).
ROUNDS, OVER = 4, 2


def distances(x: np.ndarray, centres: np.ndarray, p: float) -> np.ndarray:
    return np.round(np.stack([exact(x, c, p) for c in centres], axis=1), DIGITS)


def rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1)


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array([packed(r) for r in matrix(batch.column("p"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("point_id"), rows], names=["point_id", "x"])


def _farthest(centres: np.ndarray, p: float):
    """Of each task's points, the one farthest from its nearest centre (of equal ones that of the least id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if len(batch):
                x, ids = rows_of(batch.column("x")), batch.column("point_id").to_numpy()
                d = distances(x, centres, p).min(1)
                i = np.lexsort((ids, -d))[0]
                if best is None or (-d[i], ids[i]) < best[:2]:
                    best = -d[i], ids[i], packed(x[i])
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([int(best[1])]), pa.array([best[2]], pa.binary())], names=["d", "point_id", "x"])

    return run


def _spread(centres: np.ndarray, p: float):
    """Squared distance of each point from its nearest centre, and which that is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                d = distances(rows_of(batch.column("x")), centres, p)
                yield pa.RecordBatch.from_arrays([batch.column("point_id"), batch.column("x"), pa.array(d.min(1) ** 2), pa.array(d.argmin(1).astype(np.int32))], names=["point_id", "x", "d", "at"])

    return run


def _round(centres: np.ndarray, gone: np.ndarray | None, p: float, write: bool):
    """Sums of each centre's points; ``gone`` is how far centres are from where the bounds were written (None: no bounds yet)."""
    k = len(centres)
    if gone is not None:
        others = np.array([np.delete(gone, j).max(initial=0) for j in range(k)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, looked = np.zeros(k, np.int64), np.zeros((k, centres.shape[1])), 0
        kinds = pa.schema(
            [("point_id", pa.int64()), ("x", pa.binary()), ("at", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("k", pa.int32()), ("n", pa.int64()), ("looked", pa.int64()), ("sums", pa.list_(pa.float64()))]
        )
        for batch in batches:
            if not len(batch):
                continue
            x = rows_of(batch.column("x"))
            if gone is None:
                at, upper, lower, again = np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros(len(x)), np.arange(len(x))
            else:
                at, upper, lower = (batch.column(name).to_numpy().copy() for name in ("at", "upper", "lower"))
                upper += gone[at]
                lower -= others[at]
                again = np.flatnonzero(~(upper * (1 + 1e-12) + 10.0**-DIGITS < lower * (1 - 1e-12) - 10.0**-DIGITS))
            if len(again):
                d = distances(x[again], centres, p)
                at[again] = d.argmin(1)
                least = np.sort(d, axis=1)
                upper[again] = least[:, 0]
                lower[again] = least[:, 1] if k > 1 else np.inf
            looked += len(again)
            n += np.bincount(at, minlength=k)
            np.add.at(sums, at, x)
            if write:
                given = [batch.column("point_id"), batch.column("x"), pa.array(at), pa.array(upper), pa.array(lower)]
                yield pa.RecordBatch.from_arrays([*given, *(pa.nulls(len(x), f.type) for f in list(kinds)[5:])], schema=kinds)
        rows = [pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(np.full(k, looked)), pa.array(sums.tolist(), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(k, f.type) for f in list(kinds)[:5]), *rows], schema=kinds)

    return run


def _chance(seed: int) -> Column:
    """A number in [0, 1) that follows from the id and the seed."""
    return F.pmod(F.xxhash64(F.col("point_id"), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def _among(rows: list, k: int, p: float, seed: int) -> np.ndarray:
    """k of the weighted candidates, each next one by its weighted squared distance from those chosen."""
    x, w = np.array([np.frombuffer(r["x"]) for r in rows]), np.array([r["n"] for r in rows], float)
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(x), p=w / w.sum()))]
    while len(chosen) < k:
        d = w * distances(x, x[chosen], p).min(1) ** 2
        chosen.append(int(rng.choice(len(x), p=d / d.sum())) if d.sum() > 0 else next(i for i in range(len(x)) if i not in chosen))
    return x[chosen]


class KMeans:
    """Clusters of points (point_id, p): ``fit``, then ``centers``, ``n_samples``, ``ndim`` and ``predict``.

    ``start`` is "farthest" (the point ``first``, by default the one of the least id, then each time the point
    farthest from those chosen), "random" (k points that ``seed`` chooses) or "oversampled" (some passes that
    sample points by their squared distance from those there are, and a weighted choice among
    the few sampled). Ties go to the first centre, an empty cluster keeps its centre. Rounds end
    when no centre moves by more than ``tol``. A table of fewer than k points is refused.
    """

    def __init__(self, k: int = 4, iterations: int = 300, tol: float = 1e-5, start: str = "farthest", p: float = 2, first: int | None = None, seed: int = 0):
        if start not in ("farthest", "random", "oversampled"):
            raise ValueError("start is farthest, random or oversampled")
        self.k, self.iterations, self.tol, self.start, self.p, self.first, self.seed = k, iterations, tol, start, p, first, seed
        self.centers: np.ndarray | None = None
        self.rounds = self.looked = 0

    def _seeds(self, rows: DataFrame) -> np.ndarray:
        k, p = self.k, self.p
        if self.start == "random":
            return np.array([np.frombuffer(r["x"]) for r in rows.orderBy(_chance(self.seed), "point_id").limit(k).collect()])
        order = [_chance(self.seed)] if self.start == "oversampled" else [] if self.first is None else [F.col("point_id") != self.first]
        seeds = [np.frombuffer(rows.orderBy(*order, "point_id").limit(1).first()["x"])]
        if self.start == "farthest":
            while len(seeds) < k:
                best = rows.mapInArrow(_farthest(np.array(seeds), p), "d double, point_id long, x binary").agg(F.min(F.struct("d", "point_id", "x")).alias("b")).first()["b"]
                seeds.append(np.frombuffer(best["x"]))
            return np.array(seeds)
        for i in range(ROUNDS):
            near = rows.mapInArrow(_spread(np.array(seeds), p), "point_id long, x binary, d double, at int")
            total = near.agg(F.sum("d")).first()[0]
            if not total:
                break
            taken = near.where(_chance(self.seed + 1 + i) < F.lit(float(OVER * k)) * F.col("d") / F.lit(total))
            seeds += [np.frombuffer(r["x"]) for r in taken.orderBy(_chance(self.seed + 1 + i)).limit(8 * OVER * k).collect()]
        near = rows.mapInArrow(_spread(np.array(seeds), p), "point_id long, x binary, d double, at int")
        counts = {r["at"]: r["n"] for r in near.groupBy("at").agg(F.count("*").alias("n")).collect()}
        candidates = [{"x": packed(s), "n": counts[i]} for i, s in enumerate(seeds) if i in counts]
        if len(candidates) < k:  # fewer different points than k: any further ones do
            candidates += [{"x": r["x"], "n": 0} for r in rows.orderBy("point_id").limit(k).collect()]
        return _among(candidates, k, p, self.seed)

    def fit(self, points: DataFrame) -> KMeans:
        rows = points.select(F.col("point_id").cast("long").alias("point_id"), F.col("p").cast("array<double>").alias("p"))
        table = stored(rows.mapInArrow(_plain, "point_id long, x binary"), "points")
        self.n_samples = table.count()
        if self.n_samples < self.k:
            raise ValueError(f"{self.n_samples} points for {self.k} centres")
        centres, at_store, write = self._seeds(table), None, True
        self.ndim, self.rounds, self.looked = centres.shape[1], 0, 0
        for _ in range(self.iterations):
            gone = None if at_store is None else exact(centres, at_store, self.p)
            out = table.mapInArrow(_round(centres, gone, self.p, write), STATE)
            if write:
                out = stored(out, "bounds")
                discard(table)
                at_store = centres
                table = out.where("x is not null").select("point_id", "x", "at", "upper", "lower")
                table.stored_at = out.stored_at
            sums = sorted((r["k"], r["sums"], r["n"], r["looked"]) for r in out.where("k is not null").select("k", "sums", "n", "looked").collect())
            new = centres.copy()
            for j in range(self.k):
                mine = [(s, n) for i, s, n, _ in sums if i == j]
                n = sum(n for _, n in mine)
                if n:
                    new[j] = [math.fsum(v) / n for v in zip(*(s for s, _ in mine), strict=True)]
            looked = sum(r[3] for r in sums if r[0] == 0)
            self.rounds, self.looked = self.rounds + 1, self.looked + looked
            write = looked > STALE * self.n_samples and not write
            moved, centres = exact(new, centres, self.p).max(), new
            if moved <= self.tol:
                break
        discard(table)
        self.centers = centres
        return self

    def predict(self, points: DataFrame) -> DataFrame:
        """``points`` with cluster: the nearest of the centres, of equal ones the first."""
        if self.centers is None:
            raise ValueError("fit comes first")
        centres, p = self.centers, self.p
        rows = points.select(F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("row"), F.col("p").cast("array<double>").alias("p"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    at = distances(matrix(batch.column("p")), centres, p).argmin(1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(at)], names=["row", "cluster"])

        return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, cluster int").select("row.*", "cluster")
