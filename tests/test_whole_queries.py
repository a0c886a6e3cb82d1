"""Queries without SQL take all of their input."""

from tesserae import registry
from tesserae.operators import spatial
from tesserae.plans import rasters as R

DATA = "/root/testdata/sf0.001"


def test_outline_of_all_foreground(spark):
    sets = {}
    for r in R.mask(spark, DATA).where("v = 1").collect():
        sets.setdefault(r.image_id, []).append((r.y, r.x))
    got = {(r.set_id, r.y, r.x) for r in registry.queries()["hull_outline"](spark, DATA).collect()}
    for k, pixels in sets.items():
        assert {(k, int(y), int(x)) for y, x in spatial.chain(pixels)} <= got
        assert {i for i, *_ in got} == set(sets)


def test_clusters_until_the_centres_stay(spark, monkeypatch):
    asked = []
    plain = spatial.kmeans
    monkeypatch.setattr(spatial, "kmeans", lambda points, k, **more: asked.append((points, more)) or plain(points, k, **more))
    registry.queries()["kmeans_fit"](spark, DATA)
    assert asked[0][1] == {}


def test_clusters_of_whole_embeddings(spark):
    size = len(R.table(spark, DATA, "embeddings").first()["embedding"])
    out = registry.queries()["kmeans_fit"](spark, DATA)
    assert size > 3 and out.columns == ["cluster", "n", *(f"m{i}" for i in range(size))]
    points = R.points(spark, DATA)
    own = spatial.assign(points, [list(r[2:]) for r in out.orderBy("cluster").collect()]).groupBy("cluster").count().collect()
    assert {r.cluster: r["count"] for r in own} == {r.cluster: r.n for r in out.collect()}
