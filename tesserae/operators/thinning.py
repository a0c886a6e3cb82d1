"""Thinning of images of any size: rounds over tiles with borders.

A sub-pass looks one cell far, so that a tile with a border of two cells for each round can do several rounds before
its neighbours matter. What the tile gives is stored, borders are exchanged, and so on until nothing changes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import tiles
from ..plans.frames import PIXEL, discard, stored

#: Neighbours from north by east, in the order of their bits.
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
#: Rounds (of two sub-passes) between exchanges of borders.
ROUNDS = 16


def goes(code: int, second: bool) -> bool:
    """Whether a cell goes: 2 to 6 of its neighbours are set, they form one run round it, and there are gaps to the sub-pass's sides."""
    ring = [code >> i & 1 for i in range(8)]
    n, _, e, _, s, _, w, _ = ring
    runs = sum(a < b for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    gaps = not n * e * w and not n * s * w if second else not n * e * s and not e * s * w
    return runs == 1 and 2 <= sum(ring) <= 6 and gaps


TABLES = np.array([[goes(code, second) for code in range(256)] for second in (False, True)])


def _thinned(rounds: int):
    """A tile's set cells after some rounds: 1 those that were set and stay, -1 those that went (so that changes can be counted)."""

    def run(a: np.ndarray) -> np.ndarray:
        a, edge = a > 0, 2 * rounds
        began = a[edge:-edge, edge:-edge]
        for _ in range(rounds):
            before = a
            for table in TABLES:
                p = np.pad(a, 1).astype(np.uint8)
                code = sum(p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] << i for i, (dy, dx) in enumerate(RING))
                a = a & ~table[code]
            if (a == before).all():
                break
        left = a[edge:-edge, edge:-edge]
        return left.astype(float) - (began & ~left)

    return run


def skeletonize(px: DataFrame, rounds: int = ROUNDS, side: int | None = None) -> DataFrame:
    """The skeleton of every image's set cells (v <> 0): rounds of two simultaneous sub-passes until nothing changes."""
    px = px.select(*PIXEL, (F.col("v") != 0).cast("double").alias("v"))
    reach, last = (2 * rounds,) * 4, None
    while True:
        done = stored(tiles.over_tiles(px, reach, _thinned(rounds), side=side), "thinned")
        changed = not done.where("v < 0").isEmpty()
        if last is not None:
            discard(last)
        px, last = done.withColumn("v", F.greatest("v", F.lit(0.0))), done
        if not changed:
            return px
