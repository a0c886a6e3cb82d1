import inspect

import numpy as np
import pytest

from tesserae import registry
from tesserae.operators import clusters, spatial


def lloyd(x, centres, p, tol=1e-5):
    for n in range(1, 301):
        at = clusters.distances(x, centres, p).argmin(1)
        new = np.array([x[at == j].mean(0) if (at == j).any() else centres[j] for j in range(len(centres))])
        moved = clusters.exact(new, centres, p).max()
        centres = new
        if moved < tol:
            break
    return centres, n


def farthest(x, k, p, first=0):
    seeds = [x[first]]
    while len(seeds) < k:
        d = clusters.distances(x, np.array(seeds), p).min(1)
        seeds.append(x[min(range(len(x)), key=lambda i: (-d[i], i))])
    return np.array(seeds)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = np.round(np.vstack([rng.normal(size=(500, 5)) * 3 + rng.normal(size=5) * 4 for _ in range(3)] + [np.full((300, 5), 1.0)]), 1)
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "point_id long, p array<double>").repartition(3)


@pytest.mark.parametrize("p", [1, 2, np.inf])
def test_equal_to_plain_lloyd(data, p):
    x, points = data
    model = clusters.KMeans(6, p=p).fit(points)
    want, rounds = lloyd(x, farthest(x, 6, p), p)
    np.testing.assert_allclose(model.centers, want, atol=1e-9)
    assert model.rounds == rounds and model.ndim == 5 and model.n_samples == len(x)
    assert model.looked < 0.7 * rounds * len(x)  # bounds rule out the rest
    got = {r.point_id: r.cluster for r in model.predict(points).collect()}
    assert [got[i] for i in range(len(x))] == clusters.distances(x, want, p).argmin(1).tolist()


def test_bounds_are_written_again_when_stale(data, monkeypatch):
    x, points = data
    monkeypatch.setattr(clusters, "STALE", 0.01)
    np.testing.assert_allclose(clusters.KMeans(5, first=7).fit(points).centers, lloyd(x, farthest(x, 5, 2, 7), 2)[0], atol=1e-9)


@pytest.mark.parametrize("start", ["random", "oversampled"])
def test_other_starts(data, start):
    x, points = data
    loss = lambda c: (clusters.distances(x, c, 2).min(1) ** 2).sum()
    models = [clusters.KMeans(4, start=start, seed=s).fit(points) for s in (1, 1, 2)]
    assert (models[0].centers == models[1].centers).all() and not np.array_equal(models[0].centers, models[2].centers[: len(models[0].centers)])
    for m in models:
        np.testing.assert_allclose(m.centers, lloyd(x, m.centers, 2, 1e-3)[0], atol=1e-2)  # they rest there
        assert loss(m.centers) < 1.5 * loss(lloyd(x, farthest(x, 4, 2), 2)[0])


def test_few_points_and_equal_ones(spark):
    points = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "point_id long, p array<double>")
    for start in ("farthest", "random", "oversampled"):
        assert clusters.KMeans(3, start=start).fit(points).centers.tolist() == [[1.0, 2.0]] * 3
    with pytest.raises(ValueError):
        clusters.KMeans(6).fit(points)
    with pytest.raises(ValueError):
        clusters.KMeans(start="other")
    with pytest.raises(ValueError):
        clusters.KMeans().predict(points)
    assert spatial.kmeans(points, 1) == [[1.0, 2.0]]


def test_as_many_rounds_as_the_sql(monkeypatch):
    """Large tables need more than the SQL's rounds until the centres stay; the query must end where the SQL does."""
    asked = []

    class Stub:
        def __init__(self, k, iterations, tol, *_):
            asked.append((k, iterations, tol))

        def fit(self, points):
            self.centers = np.zeros((4, 1))
            return self

    monkeypatch.setattr(spatial, "KMeans", Stub)
    spatial.kmeans(None, 4)
    sql = inspect.signature(registry._kmeans_sql).parameters
    assert asked == [(sql["k"].default, sql["rounds"].default, 0.0)]
