import numpy as np
import pytest

from tesserae.operators import labels

from .test_trees import components, pixels


@pytest.mark.parametrize("connectivity", [1, 2])
def test_components_across_tiles(spark, connectivity):
    rng = np.random.default_rng(connectivity)
    y, x = np.mgrid[:45, :52]
    spiral = (((y // 3 + x // 4) % 2 == 0) | (x == 7) | (y % 11 == 3)).astype(float)
    images = [rng.integers(0, 3, (30, 37)).astype(float), spiral, (rng.random((60, 20)) < 0.6).astype(float), np.zeros((3, 3)), np.ones((1, 40))]
    out = labels.components(pixels(spark, images), connectivity, side=7).collect()
    named = labels.label(pixels(spark, images), connectivity).collect()
    for k, a in enumerate(images):
        want = np.zeros(a.shape, int)
        for v in np.unique(a[a > 0]):
            want += np.where(a == v, components(a == v, connectivity), 0)
        got, numbers = np.zeros(a.shape, int), np.zeros(a.shape, int)
        for r in out:
            if r.image_id == k and r.root is not None:
                got[r.y, r.x] = r.root + 1
        for r in named:
            if r.image_id == k:
                numbers[r.y, r.x] = r.label
        assert (got == want).all()
        order = {v: i for i, v in enumerate(sorted(set(want.ravel()) | {0}))}
        assert (numbers == np.vectorize(order.get)(want)).all()


def test_edges_join():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 300):
        a, b = rng.integers(0, n, (2, n // 2 + 1))
        root = labels.joined(n, a, b)
        graph = {i: {i} for i in range(n)}
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            both = graph[i] | graph[j]
            for m in both:
                graph[m] = both
        assert root.tolist() == [min(graph[i]) for i in range(n)]
