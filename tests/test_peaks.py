import numpy as np
import pytest

from tesserae.operators import peaks

from .test_trees import pixels


def greedy(a, reach, threshold, plateau, near=None, footprint=None):
    """Candidates popped by falling value, then raster number; cells of any rank."""
    near = near or (lambda gap: all(abs(g) <= r for g, r in zip(gap, reach, strict=True)))
    boxed = footprint or (lambda gap: all(abs(g) <= r for g, r in zip(gap, reach, strict=True)))
    span = [range(-r, r + 1) for r in reach]
    gaps = [g for g in np.ndindex(*(len(s) for s in span))]
    gaps = [tuple(s[i] for s, i in zip(span, g, strict=True)) for g in gaps]
    value = lambda at: a[at] if all(0 <= i < n for i, n in zip(at, a.shape, strict=True)) else 0.0
    left = [at for at in np.ndindex(*a.shape) if a[at] > threshold and all(value(tuple(i + g for i, g in zip(at, gap, strict=True))) <= a[at] for gap in gaps if boxed(gap))]
    left, out, rank = sorted(left, key=lambda at: (-a[at], at)), {}, 0
    while left:
        rank, first = rank + 1, left[0]
        taken, todo = {first}, [first]
        while todo and plateau:
            here = todo.pop()
            for q in left:
                if q not in taken and a[q] == a[here] and all(abs(i - j) <= 1 for i, j in zip(q, here, strict=True)):
                    taken.add(q)
                    todo.append(q)
        out |= dict.fromkeys(taken, rank)
        left = [q for q in left if q not in taken and not near(tuple(i - j for i, j in zip(q, first, strict=True)))]
    return out


def images():
    rng = np.random.default_rng(6)
    y, x = np.mgrid[:26, :31]
    return [rng.integers(0, 6, (24, 29)).astype(float), np.round(4 + 3 * np.sin(y / 3) * np.sin(x / 4)), np.full((12, 9), 3.0), rng.integers(0, 200, (20, 18)).astype(float), np.zeros((3, 3))]


@pytest.mark.parametrize("reach", [(1, 1), (2, 1), (3, 4)])
def test_suppression_with_plateaus(spark, reach):
    grids = images()
    got = {(r.image_id, r.y, r.x): r["rank"] for r in peaks.peak_suppression(pixels(spark, grids), reach).collect()}
    want = {(k, *at): n for k, a in enumerate(grids) for at, n in greedy(a, reach, 0.5 * a.max(), True).items()}
    assert got == want
    few = peaks.peak_suppression(pixels(spark, grids), reach, threshold=1.0, n_peaks=3).collect()
    assert {(r.image_id, r.y, r.x): r["rank"] for r in few} == {(k, *at): n for k, a in enumerate(grids) for at, n in greedy(a, reach, 1.0, True).items() if n <= 3}


@pytest.mark.parametrize(("distance", "p"), [(1, 2), (3, 2), (2, 1), (2, np.inf)])
def test_find_peaks(spark, distance, p):
    grids = images()
    ball = lambda gap: np.linalg.norm(gap, p) <= distance + 1e-9
    got = {(r.image_id, r.y, r.x): r["rank"] for r in peaks.find_peaks(pixels(spark, grids), distance, p=p).collect()}
    assert got == {(k, *at): n for k, a in enumerate(grids) for at, n in greedy(a, (distance,) * 2, 0.5 * a.max(), False, ball).items()}
    cross = lambda gap: sum(map(abs, gap)) <= 1
    # A narrow footprint leaves rivals of other values near each other.
    low = peaks.find_peaks(pixels(spark, grids), distance, threshold=4.0, p=p, footprint=[[0.0, 1.0, 0.0], [1.0, 1.0, 1.0], [0.0, 1.0, 0.0]], invert=True, value=0.0).collect()
    want = {(k, *at): n for k, a in enumerate(grids) for at, n in greedy(-a, (distance,) * 2, -4.0, False, ball, cross).items()}
    assert {(r.image_id, r.y, r.x): r["rank"] for r in low} == want
    assert all(r.v == grids[r.image_id][r.y, r.x] for r in low)


def test_accumulators(spark):
    rng = np.random.default_rng(7)
    lines, circles = rng.integers(0, 9, (40, 25)), rng.integers(0, 7, (3, 16, 18))
    votes = spark.createDataFrame([(1, y - 20, x, int(v)) for (y, x), v in np.ndenumerate(lines) if v], "image_id long, rho int, theta_ix int, votes long")
    got = {(r.rho + 20, r.theta_ix): r["rank"] for r in peaks.hough_line_peak(votes, distance=3, theta=2).collect()}
    assert got == greedy(lines.astype(float), (3, 2), lines.max() / 2, True)
    votes = spark.createDataFrame([(1, *map(int, at), int(v)) for at, v in np.ndenumerate(circles) if v], "image_id long, radius_ix int, y int, x int, votes long")
    got = sorted((r.radius_ix, r.y, r.x) for r in peaks.hough_circle_peak(votes, dy=2, dx=3).collect())
    want = sorted(greedy(circles.astype(float), (1, 2, 3), circles.max() / 2, True))
    assert got == want
    assert sorted((r.radius_ix, r.y, r.x) for r in peaks.hough_circle_peak(votes, 4, 2, 3).collect()) == want[:4]
    one = votes.where("radius_ix = 0")
    assert sorted((r.y, r.x) for r in peaks.hough_circle_peak(one, dy=2, dx=3).collect()) == sorted(greedy(circles[0].astype(float), (2, 3), circles[0].max() / 2, True))
