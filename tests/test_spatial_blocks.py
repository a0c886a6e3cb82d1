import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from tesserae.operators import metric, spatial


@pytest.mark.parametrize("p", [1, 2, np.inf])
def test_no_point_passes_through_the_driver(spark, monkeypatch, p):
    data = np.random.default_rng(5).integers(0, 9, (120, 5)).astype(float)
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "point_id long, p array<double>")

    taken = []

    def counted(whole, rows):
        taken.append(len(rows))
        return rows

    with monkeypatch.context() as m:  # pivots, rings and cells alone are fetched, by ``collect``
        for name in ("toPandas", "toLocalIterator", "toArrow"):
            m.delattr(DataFrame, name)
        collect = DataFrame.collect
        m.setattr(DataFrame, "collect", lambda df: counted(df, collect(df)))
        near = spatial.knn(points, points.selectExpr("point_id AS query_id", "p AS q"), 3, p)
    assert max(taken) <= max(10 * 10, 10 * metric.RINGS)
    got = {(r.query_id, r["rank"]): (r.point_id, r.dist) for r in near.collect()}
    for q, x in enumerate(data):
        d = np.linalg.norm(data - x, p, axis=1)
        for k, i in enumerate(sorted(range(len(d)), key=lambda i: (d[i], i))[:3]):
            assert got[q, k + 1] == (i, pytest.approx(d[i]))
    assert len(got) == 360
