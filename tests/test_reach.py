import numpy as np
import pytest

from tesserae.functions import kernels as K
from tesserae.operators import reach
from tesserae.plans import tiles

from .test_trees import arrays, pixels

UNEVEN = [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
KNIGHT = [[0.0, 1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0, 1.0], [0.0] * 5, [1.0, 0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0, 0.0]]


def flooded(open_, seeds, moves):
    out, todo = set(seeds), list(seeds)
    while todo:
        y, x = todo.pop()
        for dy, dx in moves:
            q = (y + dy, x + dx)
            if 0 <= q[0] < open_.shape[0] and 0 <= q[1] < open_.shape[1] and open_[q] and q not in out:
                out.add(q)
                todo.append(q)
    return out


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(2)
    y, x = np.mgrid[:33, :38]
    maze = ((y % 4 == 1) & (x % 37 != (y // 4 % 2) * 36)).astype(float)
    return [maze, (rng.random((30, 21)) < 0.35).astype(float), np.zeros((5, 4)), np.ones((6, 6))]


@pytest.mark.parametrize(("element", "anchor"), [(None, None), (UNEVEN, None), (KNIGHT, None), (K.box(3, 3), None), ([[1.0, 1.0], [1.0, 1.0]], (0, 1)), ([[0.0, 0.0, 1.0]], None)])
def test_fills(spark, images, element, anchor, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 8)
    px = pixels(spark, images)
    holes, filled = arrays(reach.fill_holes(px, element, anchor), images), arrays(reach.region_fill(px, (3, 2), element, anchor), images)
    near = arrays(reach.region_fill(pixels(spark, [a * 5 + 2 for a in images]), (3, 2), element, anchor, 1.0, binary=False, value=7.0), images)
    taps = [t[:2] for t in K.taps(element or K.default_element(), anchor)]
    moves = [t[:2] for t in K.taps(element or K.default_element(), anchor, flip=False)]
    for a, hole, fill, gray in zip(images, holes, filled, near, strict=True):
        inside = lambda y, x: 0 <= y < a.shape[0] and 0 <= x < a.shape[1]  # noqa: E731, B023
        seeds = [(y, x) for y, x in zip(*np.nonzero(a == 0), strict=True) if any(not inside(y + dy, x + dx) for dy, dx in taps)]
        out = flooded(a == 0, seeds, [(-dy, -dx) for dy, dx in taps])
        assert hole.tolist() == [[float((y, x) not in out) for x in range(a.shape[1])] for y in range(a.shape[0])]
        got = flooded(a == 0, [(3, 2)] if a[3, 2] == 0 else [], moves)
        assert fill.tolist() == [[float(a[y, x] != 0 or (y, x) in got) for x in range(a.shape[1])] for y in range(a.shape[0])]
        same = flooded(a == a[3, 2], [(3, 2)], moves)
        assert gray.tolist() == [[7.0 if a[y, x] != a[3, 2] or (y, x) in same else 0.0 for x in range(a.shape[1])] for y in range(a.shape[0])]
