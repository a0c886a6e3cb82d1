"""Points of lines, circles and ellipses, in closed form."""

from __future__ import annotations

from math import isqrt

Point = tuple[int, int]


def circle_points(r: int) -> list[Point]:
    """Cells (dy, dx) of a circle about the origin.

    In the octant y > x the cell in column x has the greatest y with y^2 + (y - 1)^2 < 2 (r^2 - x^2): the one
    whose midpoint with the cell below lies outside. The octants' meeting point is there once for each sign.
    """
    out: list[Point] = []
    x, y = 0, r
    while y > x:
        out += _mirrored(y, x) + (_mirrored(x, y) if x else [(0, y), (0, -y)])
        x += 1
        room = 2 * (r * r - x * x)
        y = max(0, (1 + isqrt(max(0, 2 * room - 2))) // 2) if room > 1 else 0
    return [*out, *_corners(y, x)]


def _corners(y: int, x: int) -> list[Point]:
    return [(y, x), (-y, -x), (-y, x), (y, -x)]


def _mirrored(y: int, x: int) -> list[Point]:
    return _corners(y, x) if x and y else [(y, x), (-y, -x)]


def ellipse_points(a: int, b: int) -> list[Point]:
    """Cells of an ellipse with half axes a along x and b along y, by the sign of its equation at midpoints.

    Where it is flat the next column's cell steps down if the midpoint lies outside, where it is steep the next
    row's cell steps out if the midpoint lies inside. The equation's fractions at the start are cut off.
    """
    aa, bb = a * a, b * b
    x, y = 0, b
    out = [(b, 0), (-b, 0)]
    flat = int(bb - aa * b + 0.25 * aa) - (bb - aa * b)
    while bb * x < aa * y:
        outside = bb * (x + 1) ** 2 + aa * (y * y - y) - aa * bb + flat >= 0
        x, y = x + 1, y - outside
        out += _corners(y, x)
    steep = int(bb * (x + 0.5) ** 2 + aa * (y - 1) ** 2 - aa * bb) - (bb * (x * x + x) + aa * (y - 1) ** 2 - aa * bb)
    while y > 0:
        inside = bb * (x * x + x) + aa * (y - 1) ** 2 - aa * bb + steep <= 0
        x, y = x + inside, y - 1
        out += _corners(y, x) if y else [(0, x), (0, -x)]
    return out


def line_points(start: Point, end: Point) -> list[Point]:
    """Cells from start to end: along the longer way the other coordinate is rounded, halves forwards."""
    (y1, x1), (y2, x2) = start, end
    dy, dx = abs(y2 - y1), abs(x2 - x1)
    sy, sx = (1 if y2 > y1 else -1), (1 if x2 > x1 else -1)
    n = max(dy, dx)
    short = lambda i, d: (2 * d * i + n) // (2 * n) if n else 0
    return [(y1 + sy * (i if dy > dx else short(i, dy)), x1 + sx * (short(i, dx) if dy > dx else i)) for i in range(n + 1)]
