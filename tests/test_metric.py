import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from tesserae.operators import metric

POINTS, QUERIES = "point_id long, p array<double>", "query_id long, q array<double>, k int, r double"


def spread(rng, n, dims, clusters=6, width=1.0):
    centres = rng.normal(size=(clusters, dims)) * 40
    return np.round(centres[rng.integers(clusters, size=n)] + width * rng.normal(size=(n, dims)), 2)


def frames(spark, points, queries, ks, rs):
    ask = [(1000 + i, q.tolist(), int(k), float(r)) for i, (q, k, r) in enumerate(zip(queries, ks, rs, strict=True))]
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], POINTS).repartition(3), spark.createDataFrame(ask, QUERIES)


def plain(points, queries, p):
    gap = np.abs(points[None] - queries[:, None])
    return gap.max(2) if np.isinf(p) else (gap**p).sum(2) ** (1 / p)


@pytest.fixture(params=[1, 2, 3, np.inf])
def setting(request, spark, monkeypatch):
    monkeypatch.setattr(metric, "PACK", 20)
    monkeypatch.setattr(metric, "ASKED", 16)
    rng = np.random.default_rng(int(min(request.param, 9)))
    points = np.vstack([spread(rng, 260, 7), np.tile(np.full(7, 3.0), (120, 1)), rng.integers(0, 2, (60, 7))])  # a third are copies, and ties
    queries = np.vstack([points[::23], rng.normal(size=(10, 7)) * 30, points[:2] + 1e5])
    ks, rs = rng.integers(0, 30, len(queries)), rng.uniform(0, 60, len(queries))
    ks[:3] = 1, 200, 5000
    return (*frames(spark, points, queries, ks, rs), points, queries, ks, rs, request.param)


def test_neighbours_with_a_k_of_each_point(setting):
    points, asks, data, queries, ks, _, p = setting
    index = metric.PivotIndex(points, p)
    assert index.shape.blocks.max() > 1
    got = {}
    for r in index.knn(asks, "k").collect():
        got.setdefault(r.query_id - 1000, []).append((r["rank"], r.point_id, r.dist))
    for i, row in enumerate(plain(data, queries, p)):
        order = sorted(range(len(row)), key=lambda j: (row[j], j))[: ks[i]]
        found = sorted(got.get(i, []))
        assert [(a, b) for a, b, _ in found] == [(a + 1, b) for a, b in enumerate(order)]
        np.testing.assert_allclose([d for *_, d in found], row[order], rtol=1e-9)
    limited = {(r.query_id - 1000, r.point_id) for r in index.knn(asks, 4, within=20.0).collect()}
    assert limited == {(i, j) for i, row in enumerate(plain(data, queries, p)) for j in sorted(range(len(row)), key=lambda j: (row[j], j))[:4] if row[j] < 20}


def test_pairs_within_a_radius_of_each_point(setting):
    points, asks, data, queries, _, rs, p = setting
    index = metric.PivotIndex(points, p)
    want = plain(data, queries, p)
    assert {(r.query_id - 1000, r.point_id) for r in index.ball(asks, "r").collect()} == {(i, j) for i, j in zip(*np.nonzero(want <= rs[:, None]), strict=True)}
    assert {(r.query_id - 1000, r.point_id) for r in index.ball(asks, 0.0).collect()} == {(i, j) for i, j in zip(*np.nonzero(want == 0), strict=True)}


def test_epsilon_bounds_the_error(setting):
    points, asks, data, queries, _, _, p = setting
    index = metric.PivotIndex(points, p)
    want, far = np.sort(plain(data, queries, p), axis=1), {}
    for r in index.knn(asks, 5, epsilon=0.5).collect():
        far.setdefault(r.query_id - 1000, []).append((r.point_id, r.dist))
    for i, row in enumerate(want):
        assert len({j for j, _ in far[i]}) == 5 and max(d for _, d in far[i]) <= 1.5 * row[4] + 1e-9
    full, part = (index.visited(asks, 30.0, e).groupBy().sum("n").first()[0] for e in (0, 2.0))
    assert part < full


def test_clustered_points_meet_few_others(spark):
    rng = np.random.default_rng(11)
    data = spread(rng, 3000, 64, clusters=40, width=0.5)
    points, asks = frames(spark, data, data[::10], [5] * 300, [0.0] * 300)
    index = metric.PivotIndex(points)
    got = index.knn(asks, 5)
    kth = got.where("rank = 5").select("query_id", "dist")
    known = asks.join(kth, "query_id").select("query_id", "q", "dist")
    assert known.count() == 300
    assert index.visited(known, "dist").groupBy().sum("n").first()[0] < 300 * 3000 / 10
    want = np.sort(plain(data, data[::10], 2), axis=1)[:, :5]
    np.testing.assert_allclose(np.array([r.dist for r in got.orderBy("query_id", "rank").collect()]).reshape(300, 5), want, atol=1e-9)


def test_no_points_no_queries_one_point(spark, monkeypatch):
    points, asks = frames(spark, np.zeros((1, 3)), np.ones((2, 3)), [1, 2], [1.0, 9.0])
    assert metric.PivotIndex(points.limit(0)).knn(asks, 3).collect() == [] and metric.PivotIndex(points.limit(0)).ball(asks, 3.0).collect() == []
    index = metric.PivotIndex(points)
    assert index.knn(asks.limit(0), 3).collect() == [] and len(index.knn(asks, 3).collect()) == 2 and len(index.ball(asks, "r").collect()) == 1

    def refused(*_):
        raise AssertionError("rows go to the driver")

    with monkeypatch.context() as m:  # an index is there: a search sends nothing to the driver
        for name in ("toPandas", "collect", "toLocalIterator", "toArrow"):
            m.setattr(DataFrame, name, refused)
        near = index.knn(asks, 1)
    assert near.count() == 2


def test_queries_that_go_everywhere_are_sent_once_to_each_block(spark):
    rng = np.random.default_rng(3)
    data = np.round(rng.normal(size=(6000, 64)) * 20)  # without clusters: no ring is ruled out
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], POINTS).repartition(3)
    index = metric.PivotIndex(points)
    asked = pa.RecordBatch.from_arrays([pa.array(np.arange(6000)), pa.array(data.tolist()), pa.array(np.full(6000, 5)), pa.array(np.full(6000, np.inf))], names=["query_id", "q", "k", "bound"])
    sent = list(metric._asks(index.sent, 0, False)(iter([asked])))
    assert max(b.nbytes for b in sent) < 20e6  # each query was held once for every ring before
    assert max(len(r) for b in sent for r in b.column(2).to_pylist()) <= 2**13
    assert sum(len(r) for b in sent for r in b.column(1).to_pylist()) == 8 * 6000 * len(index.shape.spans)
    assert len(index.shape.spans) * index.shape.shares > 8


@pytest.mark.parametrize("p", [1, np.inf])
def test_single_precision_is_off_by_no_more_than_it_says(p):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(70, 64)) * 50, rng.normal(size=(1100, 64)) * 1e4
    d, off = metric.near(a, b, p)
    want = np.array([np.linalg.norm(b - x, p, axis=1) for x in a])
    assert d.dtype == np.float32 and 0 < np.abs(d - want).max() <= off
    np.testing.assert_allclose(metric.far(a, b, p)[0], want, rtol=1e-12)


@pytest.mark.parametrize("p", [1, np.inf])
@pytest.mark.parametrize(("low", "high", "kinds"), [(-63, 63, (np.int16, np.int8)), (-127, -1, (np.int16, np.int8)), (-64, 64, (np.int16, np.int16)), (0, 511, (np.int16, np.int16)), (0, 512, (np.float32, np.int16)), (0, 2**15, (np.float32, np.float32))])
def test_whole_numbers_are_exact_in_few_bits(p, low, high, kinds):
    rng = np.random.default_rng(9)
    a, b = rng.integers(low, high, (70, 64), endpoint=True).astype(float), rng.integers(low, high, (2100, 64), endpoint=True).astype(float)
    a[0], b[0] = low, high
    d, off = metric.near(a, b, p)
    want = np.array([np.linalg.norm(b - x, p, axis=1) for x in a])
    kind = kinds[0 if p == 1 else 1]
    assert d.dtype == kind and (off == 0) == (kind != np.float32)
    assert (d == want).all()
    for bounds in (np.full(70, np.inf), np.full(70, -5.0), np.sort(want, axis=1)[:, 4], np.sort(want, axis=1)[:, 4] - 1e-9):
        assert (metric.within(d, bounds) == (want <= bounds[:, None])).all() or kind == np.float32
    assert metric.near(a + 0.5, b, p)[0].dtype == np.float32


def test_squares_of_whole_numbers_are_exact_in_one_product():
    rng = np.random.default_rng(10)
    a, b = rng.integers(-58, 52, (70, 64), endpoint=True).astype(float), rng.integers(-58, 52, (900, 64), endpoint=True).astype(float)
    b[:70] = a  # distances of 0
    want = ((a[:, None] - b) ** 2).sum(-1)
    d = metric.squares(a, b)
    assert d.dtype == np.float32 and (d == want).all()
    assert metric.squares(a + 0.5, b) is None and metric.squares(a * 5, b) is None and metric.squares(a * np.nan, b) is None
    kth = np.sqrt(np.sort(want, axis=1)[:, 4])
    for bounds in (kth, np.full(70, np.inf), np.full(70, -5.0), kth - 1e-3):
        for ks in (None, np.full(70, 7)):
            i, j, e = metric._answers(a, ks, bounds, b, np.arange(900), 2)
            close = np.sqrt(want) <= bounds[:, None]
            if ks is not None:
                rank = np.argsort(np.argsort(want, axis=1, kind="stable"), axis=1)
                close &= rank < 7
            assert sorted(map(list, zip(i.tolist(), j.tolist(), strict=True))) == np.argwhere(close).tolist()
            assert (e == np.sqrt(want[i, j])).all()


@pytest.mark.parametrize("p", [1, 2, np.inf])
def test_whole_numbers_are_not_measured_twice(p, monkeypatch):
    rng = np.random.default_rng(11)
    a, b = rng.integers(-9, 9, (40, 8)).astype(float), rng.integers(-9, 9, (500, 8)).astype(float)
    want = np.array([metric.exact(b, x, p) for x in a])
    bound = np.full(40, np.median(want))
    monkeypatch.setattr(metric, "exact", lambda *_: pytest.fail("each answer was worked out again"))
    i, j, e = metric._answers(a, None, bound, b, np.arange(500), p)
    assert (np.stack([i, j], 1) == np.argwhere(want <= bound[:, None])).all() and (e == want[i, j]).all()


def test_queries_travel_in_few_bytes():
    rng = np.random.default_rng(12)
    for low, high, size in ((-58, 52, 1), (-128, 127, 2), (-9000, 9000, 2), (-90_000, 90_000, 8)):
        rows = rng.integers(low, high, (16, 64), endpoint=True).astype(float)
        rows[0, :2] = low, high
        data = metric.narrowed(rows)
        assert len(data) == 16 * 64 * size  # eight bytes a value before
        assert (metric.widened(data, 16 * 64) == rows.ravel()).all()
    odd = np.array([[0.5, np.nan, np.inf, -0.25]])
    assert np.array_equal(metric.widened(metric.narrowed(odd), 4), odd[0], equal_nan=True)
    assert len(metric.widened(metric.narrowed(np.empty((3, 0))), 0)) == 0


def test_waves_are_never_above_a_gap():
    t = np.linspace(0, 3, 300_001)  # farther on the waves, at most 2 * STEEP * (1 + THIRD), are less than the gap
    assert (metric.Waves(1.0, 1).least(t) <= t).all() and 2 * metric.STEEP * (1 + metric.THIRD) < 3
    rng = np.random.default_rng(13)
    for a, b in ((rng.normal(size=(60, 64)) * 9, rng.normal(size=(300, 64)) * 9), (np.round(rng.normal(size=(60, 5)) * 13), np.round(rng.normal(size=(300, 5)) * 40) - 900)):
        b[:60] = a
        waves = metric.Waves.fitted(a, b)
        want = np.abs(a[:, None] - b).sum(2)
        for e in want.T[:90]:  # each pair of distance e is found by the bound e
            assert (waves.of(a) @ waves.of(b).T >= waves.floor(e)[:, None])[want <= e[:, None]].all()
    a, b = np.round(rng.normal(size=(60, 64)) * 13), np.round(rng.normal(size=(300, 64)) * 13)
    waves = metric.Waves.fitted(a, b)
    most = waves.floor(np.zeros(60)).max()
    assert np.mean((most - waves.of(a) @ waves.of(b).T) / np.abs(a[:, None] - b).sum(2)) > 0.85
    assert metric.Waves.fitted(a, b * np.nan) is None and metric.Waves.fitted(a[:0], b) is None and waves.of(b * 1e9) is None


def block_of(points, p, rings=4):
    shape = metric.Shape(*[None] * 14)
    shape.p, shape.spans = p, [(0, rings - 1)]
    ids = np.array_split(np.arange(len(points)) * 7, rings)
    return metric._Block(shape, 0, list(range(rings)), ids, np.array_split(points, rings))


def asked_of(queries, ks, bounds, rings=4):
    bits = np.packbits(np.ones((len(queries), rings), bool), axis=1)
    return [(np.arange(len(queries)), queries, ks, bounds, bits.ravel())]


@pytest.mark.parametrize("scale", [1, 90, 0.37, 1e7])
@pytest.mark.parametrize("nearest", [True, False])
def test_sums_of_gaps_are_worked_out_where_waves_leave_them(scale, nearest, monkeypatch):
    rng = np.random.default_rng(14)
    data, queries = np.round(rng.normal(size=(900, 64)) * 13) * scale, np.round(rng.normal(size=(40, 64)) * 13) * scale
    data[100:140], data[700:740] = data[:40], queries  # ties and copies
    want = np.abs(queries[:, None] - data).sum(2)
    kth = np.sort(want, axis=1)[:, 9]
    measured, near = [], metric.near
    monkeypatch.setattr(metric, "near", lambda a, b, p: measured.append(len(a) * len(b)) or near(a, b, p))
    got = [r for b in block_of(data, 1).meet(asked_of(queries, np.full(40, 6), kth), nearest) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert not measured  # every pair was before
    order = np.argsort(want, axis=1, kind="stable")[:, : 6 if nearest else None]
    assert sorted(g[:2] for g in got) == sorted((i, int(j) * 7) for i in range(40) for j in order[i] if want[i, j] <= kth[i])
    np.testing.assert_allclose([e for *_, e in got], [want[i, j // 7] for i, j, _ in got], rtol=1e-12)


@pytest.mark.parametrize("p", [1, 2, np.inf])
def test_bounds_tighten_within_a_block(p, monkeypatch):
    monkeypatch.setattr(metric, "PACK", 100)
    rng = np.random.default_rng(15)
    data, queries = rng.integers(-9, 9, (600, 6)).astype(float), rng.integers(-9, 9, (30, 6)).astype(float)
    ks = rng.integers(1, 40, 30)
    ks[0] = 1000
    seen, answers = [], metric._answers
    monkeypatch.setattr(metric, "_answers", lambda q, k, bounds, *rest: seen.append(np.isinf(bounds).sum()) or answers(q, k, bounds, *rest))
    got = [r for b in block_of(data, p).meet(asked_of(queries, ks, np.full(30, np.inf)), True) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    want = plain(data, queries, p)
    assert seen[0] == 30 and seen[-1] == 1  # all 30 before
    assert sorted(g[:2] for g in got) == sorted((i, int(j) * 7) for i in range(30) for j in np.argsort(want[i], kind="stable")[: ks[i]])


def test_queries_of_one_file_are_dealt_to_tasks_of_their_own(spark):
    rng = np.random.default_rng(16)
    data = np.round(rng.normal(size=(6000, 16)) * 20)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], POINTS).coalesce(1)
    index = metric.PivotIndex(rows, 1)
    slots = len(index.shape.spans) * index.shape.shares
    asked = index._asked(rows.selectExpr("point_id AS query_id", "p AS q"), 5, np.inf)
    met = index._met(asked, 0, False, True)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "hashpartitioning(query_id" in plan  # a file's queries were one task before
    assert met.rdd.getNumPartitions() == slots > 4
    assert min(len(part) for part in met.rdd.glom().collect()) > 0  # some tasks had several slots before, and others none


def test_a_first_round_takes_up_to_a_pack_of_the_own_cell(monkeypatch):
    monkeypatch.setattr(metric, "PACK", 50)
    shape = metric.Shape(*[None] * 14)
    shape.pivots, shape.cell, shape.count = np.zeros((2, 3)), np.array([0, 0, 0, 1, 1]), np.array([20, 20, 40, 9, 9])
    shape.low, shape.high = np.array([0.0, 2, 4, 0, 2]), np.array([2.0, 4, 6, 2, 4])
    chosen = shape.nearest(np.array([[1.0, 9], [5, 9], [9, 3], [9, 1]]), np.array([1, 50, 5, 30]))
    assert chosen.tolist() == [[True] * 3 + [False] * 2, [False, True, True, False, False], [False] * 3 + [True] * 2, [False] + [True] * 4]  # one ring for k = 1 before
