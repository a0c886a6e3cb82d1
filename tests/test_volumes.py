import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import kernels as K
from tesserae.operators.volumes import Space, element, offsets


def cells(spark, grids):
    rows = [(k, *g.shape, *at, float(v)) for k, g in enumerate(grids) for at, v in np.ndenumerate(g)]
    return spark.createDataFrame(rows, "image_id long, d int, h int, w int, z int, y int, x int, v double").repartition(3)


def arrays(out, grids, column="v"):
    got = [np.full(g.shape, np.nan) for g in grids]
    for r in out.collect():
        got[r.image_id][r.z, r.y, r.x] = r[column]
    return got


def read(g, taps, mode="constant", value=0.0):
    """What each tap reads of every cell."""
    m = max(max(map(abs, o)) for o, _ in taps)
    p = np.pad(g, m, mode, **({"constant_values": value} if mode == "constant" else {}))
    return np.stack([p[tuple(slice(m + o, m + o + n) for o, n in zip(at, g.shape, strict=True))] for at, _ in taps], axis=-1)


@pytest.fixture(scope="module")
def grids():
    rng = np.random.default_rng(8)
    return [rng.integers(0, 9, (7, 10, 9)).astype(float), rng.integers(0, 9, (4, 3, 12)).astype(float)]


@pytest.mark.parametrize("mode", ["constant", "edge", "wrap", "symmetric", "reflect"])
def test_filters(spark, grids, mode):
    space, px, rng = Space(side=4), cells(spark, grids), np.random.default_rng(1)
    kernel = np.round(rng.normal(size=(3, 3, 5)), 2)
    ball = np.array(K.solid(1))
    outs = [space.convolve(px, kernel, mode=mode), space.median_filter(px, ball, mode=mode), space.mean_filter(px, ball, mode=mode), space.variance_filter(px, ball, mode=mode), space.rank_filter(px, kernel > 0, 3, mode=mode)]
    for k, g in enumerate(grids):
        near, flat, some = read(g, offsets(kernel), mode), read(g, offsets(ball), mode), np.sort(read(g, offsets(kernel > 0, flip=False), mode), axis=-1)
        wants = [near @ [w for _, w in offsets(kernel)], np.sort(flat, axis=-1)[..., flat.shape[-1] // 2 - 1], flat.mean(-1), flat.var(-1), some[..., 2]]
        for out, want in zip(outs, wants, strict=True):
            np.testing.assert_allclose(arrays(out, grids)[k], want, atol=1e-9)


def test_morphology(spark, grids):
    space, px = Space(side=4), cells(spark, grids)
    shape = np.array(K.solid(1, shape="octahedron"))
    taps = offsets(shape)
    for out, f, border in ((space.erosion(px, shape), np.min, 0.0), (space.dilation(px, shape), np.max, 0.0), (space.erosion(px, shape, border=9.0), np.min, 9.0)):
        assert all((a == f(read(g, taps, value=border), axis=-1)).all() for a, g in zip(arrays(out, grids), grids, strict=True))
    opened = [read(read(g, taps).min(-1), taps).max(-1) for g in grids]
    assert all((a == b).all() for a, b in zip(arrays(space.opening(px), grids), opened, strict=True))


def flooded(g, connectivity):
    near = [tuple(o - 1) for o in np.argwhere(element(3, connectivity, hole=True))]
    out, todo = np.zeros(g.shape, int), 0
    for at in np.ndindex(*g.shape):
        if g[at] and not out[at]:
            todo += 1
            out[at], stack = todo, [at]
            while stack:
                here = stack.pop()
                for o in near:
                    q = tuple(i + j for i, j in zip(here, o, strict=True))
                    if all(0 <= i < n for i, n in zip(q, g.shape, strict=True)) and not out[q] and g[q] == g[at]:
                        out[q] = todo
                        stack.append(q)
    return out


@pytest.mark.parametrize("connectivity", [1, 2, 3])
def test_components(spark, connectivity):
    rng = np.random.default_rng(connectivity)
    grids = [(rng.random((9, 8, 11)) < 0.3) * rng.integers(1, 3, (9, 8, 11)).astype(float), (rng.random((5, 6, 7)) < 0.6).astype(float), np.zeros((2, 2, 2))]
    space, px = Space(side=3), cells(spark, grids)
    want = [flooded(g, connectivity) for g in grids]
    assert all((a == b).all() for a, b in zip(arrays(space.label(px, connectivity), grids, "label"), want, strict=True))
    kept = [np.isin(w, np.flatnonzero(np.bincount(w.ravel()) > 4)) & (w > 0) for w in want]
    assert all((a == b).all() for a, b in zip(arrays(space.remove_small_objects(px, 4, connectivity), grids), kept, strict=True))
    for a, g in zip(arrays(space.fill_holes(px), grids), grids, strict=True):
        holes = flooded((g == 0).astype(float), 1)
        edge = np.ones(g.shape, bool)
        edge[1:-1, 1:-1, 1:-1] = False
        assert (a == ((g != 0) | ~np.isin(holes, np.unique(holes[edge & (holes > 0)])))).all()


def test_lower_rank_over_leading_axes(spark, grids):
    """The same cells as stacks of planes: z is a key, and so each plane is on its own."""
    px = cells(spark, grids)
    plane = Space((("y", "h"), ("x", "w")), keys=("image_id", "d", "z"), side=4)
    blurred, named = plane.mean_filter(px, np.ones((3, 3))), plane.label(px.withColumn("v", (F.col("v") > 4).cast("double")))
    whole = Space().mean_filter(px, np.ones((1, 3, 3)))
    for k, g in enumerate(grids):
        np.testing.assert_allclose(arrays(blurred, grids)[k], arrays(whole, grids)[k], atol=1e-12)
        labels = arrays(named, grids, "label")[k]
        for z in range(g.shape[0]):
            assert (labels[z] == flooded((g[z] > 4)[None].astype(float), 1)[0]).all()
    line = Space((("x", "w"),), keys=("image_id", "d", "h", "z", "y"))
    np.testing.assert_allclose(arrays(line.convolve(px, [1.0, 2.0, 0.0]), grids)[0], np.pad(grids[0], ((0, 0), (0, 0), (0, 1)))[..., 1:] + 2 * grids[0], atol=1e-12)
