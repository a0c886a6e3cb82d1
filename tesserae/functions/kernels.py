"""Small kernels and structuring elements, made at plan time, and their taps.

A tap (dy, dx, w) reads the input at (y + dy, x + dx) with weight w.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

Tap = tuple[int, int, float]
Kernel = Sequence[Sequence[float]]
EPSILON = 2.220446049250313e-16


def taps(kernel: Kernel, anchor: tuple[int, int] | None = None, flip: bool = True, dilation: int = 1, keep_zeros: bool = False) -> list[Tap]:
    """Taps of a kernel; convolution turns it by half a turn (``flip``), the anchor stays where it is.

    Kernels of even size need an anchor.
    """
    rows = [list(r) for r in kernel]
    if dilation > 1:
        wide = [[0.0] * ((len(rows[0]) - 1) * dilation + 1) for _ in range((len(rows) - 1) * dilation + 1)]
        for i, r in enumerate(rows):
            for j, w in enumerate(r):
                wide[i * dilation][j * dilation] = w
        rows = wide
    h, w = len(rows), len(rows[0])
    if anchor is None:
        if h % 2 == 0 or w % 2 == 0:
            raise ValueError("a kernel of even size needs an anchor")
        anchor = (h // 2, w // 2)
    if flip:
        rows = [r[::-1] for r in rows[::-1]]
    out = [(i - anchor[0], j - anchor[1], float(rows[i][j])) for i in range(h) for j in range(w)]
    return out if keep_zeros else [t for t in out if abs(t[2]) > EPSILON]


def box(h: int, w: int) -> list[list[float]]:
    return [[1.0] * w for _ in range(h)]


def cross(h: int, w: int | None = None) -> list[list[float]]:
    w = w or h
    middle = lambda n: {(n - 1) // 2, n // 2}
    return [[float(i in middle(h) or j in middle(w)) for j in range(w)] for i in range(h)]


def diamond(r: int) -> list[list[float]]:
    return [[float(abs(i) + abs(j) <= r) for j in range(-r, r + 1)] for i in range(-r, r + 1)]


def disk(r: int) -> list[list[float]]:
    return [[float(i * i + j * j <= r * r) for j in range(-r, r + 1)] for i in range(-r, r + 1)]


def circle(r: int) -> list[list[float]]:
    return [[float(i * i + j * j <= (r + 0.5) ** 2) for j in range(-r, r + 1)] for i in range(-r, r + 1)]


def solid(r: int, height: int = 0, shape: str = "sphere") -> list[list[list[float]]]:
    """Three-dimensional elements: sphere, octahedron, cylinder (with ``height``), cube (side r)."""
    span = range(-r, r + 1)
    if shape == "cube":
        return [box(r, r) for _ in range(r)]
    if shape == "cylinder":
        return [circle(r) for _ in range(height)]
    within = {"sphere": lambda a, b, c: a * a + b * b + c * c <= (r + 0.5) ** 2, "octahedron": lambda a, b, c: abs(a) + abs(b) + abs(c) <= r}[shape]
    return [[[float(within(a, b, c)) for c in span] for b in span] for a in span]


def cuboid(d: int, h: int, w: int) -> list[list[list[float]]]:
    return [box(h, w) for _ in range(d)]


def binary_table(rank: int) -> list[list[int]]:
    """All rows of ``rank`` bits in order."""
    return [[i >> k & 1 for k in reversed(range(rank))] for i in range(2**rank)]


def default_element(connectivity: int = 1, hole: bool = False) -> list[list[float]]:
    """The 3x3 cells with an L1 offset up to ``connectivity``, without the centre if ``hole``."""
    return [[float(abs(i) + abs(j) <= connectivity and not (hole and i == j == 0)) for j in (-1, 0, 1)] for i in (-1, 0, 1)]


ELEMENTS = {"rectangle": box, "square": lambda n: box(n, n), "cross": cross, "diamond": diamond, "disk": disk, "circle": circle, "default": default_element}


def gaussian_line(sigma: float, truncate: float = 3.0, radius: int | None = None) -> list[float]:
    r = math.floor(truncate * sigma + 0.5) if radius is None else radius
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    w = [x if x >= EPSILON * max(w) else 0.0 for x in w]
    return [x / sum(w) for x in w]


def gaussian(sigma: float, truncate: float = 3.0, radius: int | None = None) -> list[list[float]]:
    line = gaussian_line(sigma, truncate, radius)
    return [[a * b for b in line] for a in line]


def sigma_of_size(size: int) -> float:
    return 0.3 * (size / 2 - 1) + 0.8


#: Smoothing across and difference along the axis of the two edge kernels.
EDGES = {"sobel": (1.0, 2.0, 1.0), "prewitt": (1.0, 1.0, 1.0)}
DIFFERENCE = (1.0, 0.0, -1.0)


def edge(name: str, axis: int, normalise: bool = True) -> list[list[float]]:
    s = EDGES[name]
    total = sum(s) if normalise else 1.0
    rows = [[d * a / total for a in s] for d in DIFFERENCE]
    return rows if axis == 0 else [list(r) for r in zip(*rows, strict=True)]
