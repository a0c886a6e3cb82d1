import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import kernels as K
from tesserae.operators import neighbourhood as N
from tesserae.operators import thinning
from tesserae.plans import tiles

from .test_trees import arrays, pixels

PAD = {"constant": "constant", "edge": "edge", "wrap": "wrap", "symmetric": "symmetric", "reflect": "reflect"}


def windows(a, footprint, mode, value):
    h, w = len(footprint), len(footprint[0])
    more = {"constant_values": value} if mode == "constant" else {}
    p = np.pad(a, ((h // 2, h - 1 - h // 2), (w // 2, w - 1 - w // 2)), PAD[mode], **more)
    return np.lib.stride_tricks.sliding_window_view(p, (h, w))[..., np.array(footprint) != 0]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 8)
    monkeypatch.setattr(tiles, "TOGETHER", 500)


@pytest.mark.parametrize("mode", list(PAD))
@pytest.mark.parametrize("footprint", [K.box(3, 3), K.box(7, 11), K.cross(5), [[1.0, 0.0, 1.0], [0.0, 1.0, 1.0], [1.0, 1.0, 1.0]]])
def test_filters_over_tiles(spark, small, mode, footprint):
    rng = np.random.default_rng(len(footprint))
    images = [rng.integers(0, 50, (19, 23)).astype(float), rng.normal(size=(12, 9))]
    px, n = pixels(spark, images), int(sum(map(sum, footprint)))
    got = [arrays(f(px, footprint, *more, mode=mode, value=3.0), images) for f, more in ((N.rank_filter, (2,)), (N.median_filter, ()), (N.mean_filter, ()), (N.variance_filter, ()))]
    for k, a in enumerate(images):
        # Means turn their kernel, ranks do not.
        v, turned = np.sort(windows(a, footprint, mode, 3.0), axis=-1), windows(a, [r[::-1] for r in footprint[::-1]], mode, 3.0)
        for out, want in zip(got, (v[..., 1], v[..., n // 2 - 1], turned.mean(-1), turned.var(-1)), strict=True):
            np.testing.assert_allclose(out[k], want, atol=1e-9)


def test_valid_mode_keeps_whole_windows(spark, small):
    a = np.random.default_rng(3).integers(0, 9, (17, 20)).astype(float)
    out = N.median_filter(pixels(spark, [a]), K.box(5, 3), "valid")
    got = {(r.y, r.x): r.v for r in out.collect()}
    want = np.sort(np.lib.stride_tricks.sliding_window_view(a, (5, 3)).reshape(13, 18, 15), axis=-1)[..., 6]
    assert got == {(y + 2, x + 1): v for (y, x), v in np.ndenumerate(want)}


def test_a_pixel_is_sent_a_bounded_number_of_times(spark):
    px = pixels(spark, [np.zeros((64, 64))])
    for side, reach in ((16, 7), (32, 7), (16, 16)):
        sent = tiles.windows(px, reach, reach, reach, reach, side).groupBy("y", "x").count().agg(F.max("count")).first()[0]
        assert sent <= 9 and (sent <= 4 or 2 * reach >= side)
    plan = N.median_filter(px, K.box(15, 15), "valid")._jdf.queryExecution().toString()
    assert "tap" not in plan and plan.count("Generate explode") <= 4 * 2


def plain_thinning(a):
    a, rounds = a != 0, 0
    while True:
        before, rounds = a.copy(), rounds + 1
        for second in (False, True):
            gone = []
            for y, x in zip(*np.nonzero(a), strict=True):
                code = sum(int(0 <= y + dy < a.shape[0] and 0 <= x + dx < a.shape[1] and a[y + dy, x + dx]) << i for i, (dy, dx) in enumerate(thinning.RING))
                if thinning.goes(code, second):
                    gone.append((y, x))
            for g in gone:
                a[g] = False
        if (a == before).all():
            return a.astype(float), rounds


@pytest.mark.parametrize(("rounds", "side"), [(1, 5), (3, 16), (16, None)])
def test_thinning_over_tiles(spark, rounds, side):
    y, x = np.mgrid[:64, :64]
    images = [((y - 30) ** 2 + (x - 25) ** 2 < 500).astype(float), (np.random.default_rng(1).random((40, 31)) < 0.7).astype(float), np.zeros((4, 4)), np.ones((33, 6))]
    want = [plain_thinning(a) for a in images]
    assert max(n for _, n in want) > 8
    assert all((g == w).all() for g, (w, _) in zip(arrays(thinning.skeletonize(pixels(spark, images), rounds, side), images), want, strict=True))
